"""Approximate search: inverted lists (IVF-Flat) and random-projection hashing (LSH)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.knn import _best, matrix, ranked, scores, searched

SAMPLE = 20_000


def train_cells(corpus: DataFrame, cells: int, iterations: int = 12, seed: int = 42, sample: int = SAMPLE) -> np.ndarray:
    """Centroids by Lloyd's iterations on a bounded sample: the ``sample`` rows of smallest seeded hash."""
    rows = corpus.filter("embedding is not null").orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(sample).select("embedding").toArrow()
    x = matrix(rows["embedding"])
    cells = min(cells, len(x))
    centre = x[np.random.default_rng(seed).permutation(len(x))[:cells]].copy()
    for _ in range(iterations):
        own = scores("l2sq", x, centre).argmin(1)
        n = np.bincount(own, minlength=cells)
        sums = np.zeros_like(centre)
        np.add.at(sums, own, x)
        centre = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centre)
    return centre


def assigned(corpus: DataFrame, centroids: np.ndarray, copies: int = 1) -> DataFrame:
    """cell_id, vec_id, embedding of every row: written partitioned by cell_id, the index prunes to the probed cells.

    With ``copies`` a row stands in that many of its nearest cells, so rows near a border are found from either side.
    """
    shared = corpus.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = np.argsort(scores("l2sq", matrix(batch.column("embedding")), shared.value), axis=1, kind="stable")[:, :copies]
                for cell in own.T:
                    yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), batch.column("vec_id"), batch.column("embedding")], names=["cell_id", "vec_id", "embedding"])

    return corpus.filter("embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, "cell_id int, vec_id long, embedding array<float>")


def ivf_search(index: DataFrame, centroids: np.ndarray, queries: DataFrame, k: int, probes: int, metric: str = "l2sq") -> DataFrame:
    """query_id, rank, neighbor_id, score among the rows of each query's nearest cells; a row of several cells counts once."""
    sign = 1.0 if metric == "l2sq" else -1.0

    def probed(vectors: np.ndarray) -> np.ndarray:
        return np.argsort(scores("l2sq", vectors, centroids), axis=1, kind="stable")[:, :probes]

    def run(ids: np.ndarray, vectors: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asks = probed(vectors)
        by_cell = {int(c): np.flatnonzero((asks == c).any(1)) for c in np.unique(asks)}
        held = {}
        for batch in batches:
            cells = batch.column("cell_id").to_numpy()
            for c in np.unique(cells):
                mine = np.flatnonzero(cells == c)
                asked = by_cell.get(int(c))
                if asked is None:
                    continue
                own = batch.column("vec_id").to_numpy()[mine]
                s = sign * scores(metric, vectors[asked], matrix(batch.column("embedding").take(pa.array(mine))))
                for i, row in zip(asked.tolist(), s, strict=True):
                    key, who = held.get(i, (np.zeros(0), np.zeros(0, np.int64)))
                    fresh = ~np.isin(own, who)
                    key, who = np.concatenate((key, row[fresh])), np.concatenate((who, own[fresh]))
                    best = _best(key, who, k)
                    held[i] = key[best], who[best]
        if held:
            n = [len(key) for key, _ in held.values()]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[list(held)], n)), pa.array(np.concatenate([w for _, w in held.values()])), pa.array(sign * np.concatenate([x for x, _ in held.values()]))], names=["query_id", "neighbor_id", "score"])

    found = searched(index, queries.select(F.col("vec_id").cast("long"), "embedding"), run, lambda vectors: F.col("cell_id").isin(np.unique(probed(vectors)).tolist()))
    once = found.groupBy("query_id", "neighbor_id").agg(F.min("score").alias("score"))
    return ranked(once, k, metric == "l2sq").select("query_id", "rank", "neighbor_id", "score")


def lsh_search(corpus: DataFrame, queries: DataFrame, k: int, tables: int = 16, bits: int = 6, seed: int = 42, flips: int = 4) -> DataFrame:
    """query_id, rank, neighbor_id, score (cosine) among rows that share a sign pattern with the query in some table.

    In each table a query asks for its own pattern, and for those with one of its ``flips`` least certain signs (nearest to
    their plane) turned: a near row lies most often just across such a plane. Queries are a stated set: their patterns go to the tasks, which scan the corpus once and score candidates in numpy.
    """
    rows = corpus.filter("embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")

    def heights(x: np.ndarray) -> np.ndarray:
        return (x @ np.random.default_rng(seed).normal(size=(x.shape[1], tables * bits))).reshape(len(x), tables, bits)

    def patterns(h: np.ndarray) -> np.ndarray:
        return ((h > 0) * (1 << np.arange(bits))).sum(2)

    def probes(x: np.ndarray) -> np.ndarray:
        h = heights(x)
        own = patterns(h)[:, :, None]
        return np.concatenate((own, own ^ (1 << np.argsort(np.abs(h), axis=2, kind="stable")[:, :, :flips])), 2)

    def run(ids: np.ndarray, vectors: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = probes(vectors)
        held = [(np.zeros(0), np.zeros(0, np.int64)) for _ in ids]
        table, wanted = np.arange(tables)[:, None], np.zeros((tables, 1 << bits), bool)
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                own, x = batch.column(0).slice(lo, 2048).to_numpy(), matrix(batch.column(1).slice(lo, 2048))
                mine = np.ascontiguousarray(patterns(heights(x)).T)
                for i in range(len(ids)):
                    wanted[table, asked[i]] = True
                    near = np.flatnonzero(wanted[table, mine].any(0))
                    wanted[table, asked[i]] = False
                    if len(near):
                        s = scores("cosine", vectors[i : i + 1], x[near])[0]
                        key, who = np.concatenate((held[i][0], -s)), np.concatenate((held[i][1], own[near]))
                        best = _best(key, who, k)
                        held[i] = key[best], who[best]
        n = [len(key) for key, _ in held]
        if sum(n):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(np.concatenate([w for _, w in held])), pa.array(-np.concatenate([x for x, _ in held]))], names=["query_id", "neighbor_id", "score"])

    found = searched(rows, queries.select(F.col("vec_id").cast("long"), "embedding"), run)
    return ranked(found, k, False).select("query_id", "rank", "neighbor_id", "score")
