"""Multi-resolution proximity graph: supporting and semantic edges, pruning to a fixed degree, and beam search."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.ids import order_key
from tessera.functions.vector import cosine
from tessera.operators.components import cut
from tessera.operators.knn import knn, matrix, numbered_rows, stored_batches

DEGREE = 64
MAX_GRAPH_BYTES = 256 << 20


def supporting_edges(nodes: DataFrame, mode: str = "reference", keys: tuple[str, ...] = ("wsi_id",)) -> DataFrame:
    """src, dst both ways between adjacent levels; a larger level is finer.

    mode "reference": a coarse node and the fine node at exactly 2**gap times its place. "pyramid": and all others below it.
    """
    levels = nodes.select(*keys, "level").distinct().withColumn("_next", F.lead("level").over(Window.partitionBy(*keys).orderBy("level")))
    coarse = nodes.join(levels, [*keys, "level"]).filter("_next is not null").select(*keys, F.col("_next").alias("level"), F.col("node").alias("up"), F.col("gx").alias("cx"), F.col("gy").alias("cy"), (F.col("_next") - F.col("level")).alias("_gap"))
    fine = nodes.select(*keys, "level", F.col("node").alias("down"), "gx", "gy")
    before = levels.filter("_next is not null").select(*keys, F.col("_next").alias("level"), (F.col("_next") - F.col("level")).alias("_fg"))
    step = F.pow(F.lit(2.0), F.col("_fg"))
    fine = fine.join(before, [*keys, "level"]).withColumn("cx", F.floor(F.col("gx") / step).cast("int")).withColumn("cy", F.floor(F.col("gy") / step).cast("int"))
    if mode == "reference":
        fine = fine.filter((F.col("gx") == F.col("cx") * step) & (F.col("gy") == F.col("cy") * step))
    elif mode != "pyramid":
        raise ValueError(f"mode is {mode!r}")
    pairs = coarse.withColumn("cx", F.col("cx").cast("int")).withColumn("cy", F.col("cy").cast("int")).join(fine, [*keys, "level", "cx", "cy"]).select("up", "down")
    return pairs.select(F.col("up").alias("src"), F.col("down").alias("dst")).union(pairs.select(F.col("down").alias("src"), F.col("up").alias("dst")))


def semantic_edges(nodes: DataFrame, k: int = DEGREE, metric: str = "cosine") -> DataFrame:
    """src, dst, score: the k nearest nodes of each node on its own level (itself among them, as the search finds it)."""
    out = None
    for (level,) in nodes.select("level").distinct().orderBy("level").collect():  # a handful of levels
        one = nodes.filter(F.col("level") == level).select(F.col("node").alias("vec_id"), "embedding")
        part = knn(one, one, k, metric).select(F.col("query_id").alias("src"), F.col("neighbor_id").alias("dst"), "score")
        out = part if out is None else out.unionByName(part)
    return out


def pruned(nodes: DataFrame, supporting: DataFrame, semantic: DataFrame, degree: int = DEGREE, seed: int = 42) -> DataFrame:
    """src, dst, kind, rank: at most ``degree`` edges a node.

    Supporting edges come first, then semantic ones by cosine; nodes with fewer are filled up with other nodes of their
    level in a seeded order, as far as there are any. To fill, each node looks at places after its own in that order:
    no more than are missing and taken, so nothing is paired with all.
    """
    # The search's scores are reused; cosines are computed for the few supporting edges alone.
    v = nodes.select(F.col("node").alias("src"), F.col("embedding").alias("_a"))
    u = nodes.select(F.col("node").alias("dst"), F.col("embedding").alias("_b"))
    upright = supporting.join(v, "src").join(u, "dst").select("src", "dst", F.lit(0).alias("kind"), cosine(F.col("_a"), F.col("_b"), "epsilon").alias("score"))
    both = upright.unionByName(semantic.select("src", "dst", F.lit(1).alias("kind"), "score")).filter("src <> dst")
    near = both.groupBy("src", "dst").agg(F.min("kind").alias("kind"), F.round(F.max("score"), 9).alias("_s"))
    first = Window.partitionBy("src").orderBy("kind", F.desc("_s"), "dst")
    # Read three times below: cut here, so the search behind the edges runs once.
    kept = cut(near.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= degree).drop("_s"))
    # Every level's nodes on a ring, in seeded order.
    ring = nodes.select("node", "level", order_key(F.col("node"), seed=seed).alias("_k"))
    placed = numbered_rows(ring, "level", "_k", "node")
    span = placed.groupBy("level").agg(F.min("_row").alias("_from"), F.count("*").alias("_n"))
    placed = placed.join(F.broadcast(span), "level").withColumn("_at", F.col("_row") - F.col("_from")).select("node", "level", "_at", "_n")
    have = kept.groupBy("src").agg(F.count("*").alias("_have"))
    short = placed.join(have.withColumnRenamed("src", "node"), "node", "left").withColumn("_have", F.coalesce("_have", F.lit(0))).filter(F.col("_have") < degree)
    reach = F.least(F.lit(2 * degree) + 2, F.col("_n") - 1).cast("int")
    tries = short.filter("_n > 1").select(F.col("node").alias("src"), "level", "_have", F.explode(F.sequence(F.lit(1), reach)).alias("_o"), "_at", "_n")
    tries = tries.withColumn("_to", F.pmod(F.col("_at") + F.col("_o"), F.col("_n")))
    found = tries.join(placed.select("level", F.col("_at").alias("_to"), F.col("node").alias("dst")), ["level", "_to"])
    fresh = found.join(kept.select("src", "dst"), ["src", "dst"], "left_anti")
    fill = fresh.withColumn("_f", F.row_number().over(Window.partitionBy("src").orderBy("_o"))).filter(F.col("_f") + F.col("_have") <= degree)
    padding = fill.select("src", "dst", F.lit(2).alias("kind"), (F.col("_f") + F.col("_have")).cast("int").alias("rank"))
    return kept.select("src", "dst", "kind", "rank").unionByName(padding)


def degree_stats(edges: DataFrame) -> DataFrame:
    """One row: nodes, average, largest and smallest degree, and whether all are equal."""
    d = edges.groupBy("src").agg(F.count("*").alias("d"))
    return d.agg(F.count("*").alias("nodes"), F.avg("d").alias("avg_degree"), F.max("d").alias("max_degree"), F.min("d").alias("min_degree"), (F.max("d") == F.min("d")).alias("uniform"))


def global_index(nodes: DataFrame) -> DataFrame:
    """nodes with global_idx: dense, by ascending level and node."""
    return numbered_rows(nodes, "level", "node").withColumnRenamed("_row", "global_idx")


def flattened(edges: DataFrame, degree: int = DEGREE) -> DataFrame:
    """src, adj: neighbours by rank, filled up with -1. A list is no longer than the degree."""
    lists = edges.groupBy("src").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "dst"))), lambda e: e["dst"]).alias("_a"))
    return lists.select("src", F.slice(F.concat("_a", F.array_repeat(F.lit(-1).cast("long"), degree)), 1, degree).alias("adj"))


def beam_search(index: DataFrame, queries: DataFrame, k: int = 10, buffer: int = 200, expand: int = 2, max_iters: int = 20, starts: int = 128, seed: int = 42) -> DataFrame:
    """query_id, rank, neighbor_id, score by best-first search over index(node, embedding, adj).

    The tasks read the whole index from the shared folder only if its size, checked first, is under ``MAX_GRAPH_BYTES``; of a
    larger one the same search reads the nodes of each step by joins. Start nodes are a seeded draw for each query; a sorted
    buffer of the best nodes is merged with each step's neighbours; the search ends when a step adds nothing.
    """
    index = cut(index.select("node", "embedding", "adj"))
    size = index.agg(F.sum(F.size("embedding") * 8 + F.size("adj") * 8 + 16)).first()[0] or 0
    if size > MAX_GRAPH_BYTES:
        return _searched_by_joins(index, queries, k, buffer, expand, max_iters, starts, seed)
    files = tuple(sorted(index.inputFiles()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, vectors, norms, adj = _graph(files)
        for pdf in batches:
            out = []
            for query_id, q in zip(pdf["vec_id"], pdf["embedding"], strict=True):
                q = np.asarray(q, np.float64)
                near = lambda at: vectors[at].astype(np.float64) @ q / (norms[at] * np.linalg.norm(q) + 1e-8)  # noqa: B023, E731
                frontier = _drawn(seed, int(query_id), len(ids), starts)
                seen = best = frontier
                score = near(frontier)
                order = np.lexsort((ids[best], -score))[:buffer]
                best, score, opened = best[order], score[order], set()
                for _ in range(max_iters):
                    to_open = [int(b) for b in best if int(b) not in opened][:expand]
                    if not to_open:
                        break
                    opened.update(to_open)
                    fresh = np.unique(adj[to_open])
                    fresh = fresh[(fresh >= 0)]
                    fresh = fresh[~np.isin(fresh, seen)]
                    seen = np.concatenate((seen, fresh))
                    least = score[-1] if len(score) >= buffer else -np.inf
                    s = near(fresh)
                    add = s > least
                    if not add.any() and len(best) >= buffer:
                        break
                    best, score = np.concatenate((best, fresh[add])), np.concatenate((score, s[add]))
                    order = np.lexsort((ids[best], -score))[:buffer]
                    best, score = best[order], score[order]
                out += [(int(query_id), r + 1, int(ids[b]), float(s)) for r, (b, s) in enumerate(zip(best[:k], score[:k], strict=True))]
            yield pd.DataFrame(out, columns=["query_id", "rank", "neighbor_id", "score"])

    return queries.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInPandas(run, "query_id long, rank long, neighbor_id long, score double")


@lru_cache(maxsize=1)
def _graph(files: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes in order, their vectors, norms and neighbours' places (-1: none), kept by a worker for its further tasks."""
    parts = [(b.column(0).to_numpy(), matrix(b.column(1)).astype(np.float32), b.column(2).flatten().to_numpy().reshape(b.num_rows, -1)) for b in stored_batches(files)]
    if not parts:
        return np.zeros(0, np.int64), np.zeros((0, 0), np.float32), np.zeros(0), np.zeros((0, 0), np.int32)
    ids = np.concatenate([p[0] for p in parts])
    order = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    ids = ids[order]
    vectors, adj, norms = np.empty((len(ids), parts[0][1].shape[1]), np.float32), np.empty((len(ids), parts[0][2].shape[1]), np.int32), np.empty(len(ids))
    lo = 0
    for _, rows, near in parts:
        to = place[lo : lo + len(rows)]
        at = np.minimum(np.searchsorted(ids, near), len(ids) - 1)
        vectors[to], adj[to], norms[to] = rows, np.where(ids[at] == near, at, -1), np.linalg.norm(rows.astype(np.float64), axis=1)
        lo += len(rows)
    return ids, vectors, norms, adj


def _drawn(seed: int, query_id: int, n: int, starts: int) -> np.ndarray:
    """Start positions of a query, drawn without a permutation of all n."""
    return np.random.default_rng([seed, query_id]).choice(n, min(n, starts), replace=False, shuffle=False)


_STATE = "query_id long, embedding array<float>, best array<long>, score array<double>, opened array<long>, seen array<long>, over boolean"


def _searched_by_joins(index: DataFrame, queries: DataFrame, k: int, buffer: int, expand: int, max_iters: int, starts: int, seed: int) -> DataFrame:
    """The search of ``beam_search``, with a row of state for each query (bounded by starts and steps) and two joins a step."""
    n = index.count()
    placed = cut(numbered_rows(index.select("node"), "node"))

    def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids = [int(i) for i in pdf["query_id"]]
            at = [_drawn(seed, i, n, starts) for i in ids]
            yield pd.DataFrame({"query_id": np.repeat(ids, [len(a) for a in at]), "_row": np.concatenate([*at, np.zeros(0, np.int64)])})

    def step(first: bool):
        def merge(state: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
            if state.empty:
                return state
            s = state.iloc[0]
            if s["over"]:
                return state
            q = np.asarray(s["embedding"], np.float64)
            best, score, seen = (np.asarray(s[c], t) for c, t in (("best", np.int64), ("score", np.float64), ("seen", np.int64)))
            opened = list(s["opened"]) if first else [*s["opened"], *_to_open(best, s["opened"], expand)]
            near = near[~near["node"].isin(seen)].sort_values("node")
            ids = near["node"].to_numpy(np.int64)
            v = np.stack([np.asarray(x, np.float64) for x in near["embedding"]]) if len(ids) else np.zeros((0, len(q)))
            new = v @ q / (np.linalg.norm(v, axis=1) * np.linalg.norm(q) + 1e-8)
            add = new > (score[-1] if len(score) >= buffer else -np.inf)
            over = not first and not add.any() and len(best) >= buffer
            if not over:
                best, score = np.concatenate((best, ids[add])), np.concatenate((score, new[add]))
                order = np.lexsort((best, -score))[:buffer]
                best, score = best[order], score[order]
                over = not _to_open(best, opened, expand)
            return pd.DataFrame({"query_id": [s["query_id"]], "embedding": [s["embedding"]], "best": [best], "score": [score], "opened": [opened], "seen": [np.concatenate((seen, ids))], "over": [over]})

        return merge

    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(i, o) for i, best, opened in zip(pdf["query_id"], pdf["best"], pdf["opened"], strict=True) for o in _to_open(best, opened, expand)]
            yield pd.DataFrame(out, columns=["query_id", "node"]).astype("int64")

    none = lambda kind: F.array().cast(f"array<{kind}>")
    state = queries.select(F.col("vec_id").cast("long").alias("query_id"), "embedding", none("long").alias("best"), none("double").alias("score"), none("long").alias("opened"), none("long").alias("seen"), F.lit(False).alias("over"))
    fresh = state.select("query_id").mapInPandas(drawn, "query_id long, _row long").join(placed, "_row").select("query_id", "node")
    for i in range(max_iters + 1):
        near = fresh.join(index.select("node", "embedding"), "node")
        state = cut(state.groupBy("query_id").cogroup(near.groupBy("query_id")).applyInPandas(step(i == 0), _STATE))
        left = state.filter("not over")
        if i == max_iters or left.isEmpty():
            break
        opening = left.select("query_id", "best", "opened").mapInPandas(asked, "query_id long, node long")
        fresh = opening.join(index.select("node", "adj"), "node").select("query_id", F.explode("adj").alias("node")).filter("node >= 0").distinct()
    hits = state.select("query_id", F.posexplode(F.slice(F.arrays_zip("best", "score"), 1, k)).alias("_p", "_h"))
    return hits.select("query_id", (F.col("_p") + 1).cast("long").alias("rank"), F.col("_h.best").alias("neighbor_id"), F.col("_h.score").alias("score"))


def _to_open(best, opened, expand: int) -> list[int]:
    done = set(opened)
    return [int(b) for b in best if int(b) not in done][:expand]


def add_level(nodes: DataFrame | None, level: DataFrame, number: int, tissue: Column | None = None) -> DataFrame:
    """nodes and those of one more level(node, wsi_id, gx, gy, embedding), of tissue alone where a filter is given.

    A vector of another length than the level's first is an error where it is read.
    """
    rows = level if tissue is None else level.filter(tissue)
    first = rows.select(F.size("embedding").alias("n")).limit(1).first()
    right = F.size("embedding") == F.lit(first["n"] if first else 0)
    checked = F.when(right, F.col("embedding")).otherwise(F.raise_error(F.lit("vectors of a level differ in length")))
    rows = rows.select("node", "wsi_id", F.lit(number).alias("level"), "gx", "gy", checked.alias("embedding"))
    return rows if nodes is None else nodes.unionByName(rows)


def region_search(index: DataFrame, tiles: DataFrame, k: int = 10, **how) -> DataFrame:
    """region_id, tile, rank, neighbor_id, score: beam_search() of all tiles(region_id, tile, embedding) of query regions at once."""
    key = F.struct("region_id", "tile")
    asked = tiles.select(F.xxhash64(key).alias("vec_id"), "region_id", "tile", "embedding")
    hits = beam_search(index, asked.select("vec_id", "embedding"), k, **how)
    return hits.join(asked.select(F.col("vec_id").alias("query_id"), "region_id", "tile"), "query_id").select("region_id", "tile", "rank", "neighbor_id", "score")
