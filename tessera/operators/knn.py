"""Exact k-nearest-neighbour search.

Queries of up to ``BLOCK_BYTES`` go to every task as one block: tasks stream the corpus in Arrow batches, score each batch
against the block by matrix products of bounded size, and keep only the k best of each query; a partition sends at most k
rows a query to the merge. For larger sets of queries the rows are written to the shared folder, and the tasks are dealt
the queries: a task holds ``OWN_BYTES`` of them at a time, with their k best, and reads all rows past them, so each query
is told of once and neither side goes through the driver. What may be among the k best is scored again by sums in order
of place, as SQL sums them, so the order is total wherever a row stands: score, then neighbour id.

Other searches (``searched``) broadcast up to ``MAX_QUERY_BYTES``; above, their tasks hold ``CHUNK_BYTES`` of rows at a time
and read the queries past them from the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.vector import TINY
from tessera.session import open_fs, store

MAX_QUERY_BYTES = 64 << 20
CHUNK_BYTES = 256 << 20
BLOCK_BYTES = 4 << 20
OWN_BYTES = 16 << 20
#: Rows that are scored at once, scores of a tile of queries and rows, and pairs that are scored again at once.
ROWS, TILE, PAIRS = 4096, 1 << 20, 1 << 15
_NONE = np.iinfo(np.int64).max
METRICS = ("cosine", "l2sq", "dot")


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list<float> column as doubles; rows must have one length and no nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1) if n else np.zeros((0, 0))


def scores(metric: str, queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """queries x rows; higher is nearer for cosine and dot, lower for l2sq."""
    product = queries @ rows.T
    if metric == "dot":
        return product
    if metric == "cosine":
        a, b = np.linalg.norm(queries, axis=1), np.linalg.norm(rows, axis=1)
        whole = (a[:, None] >= TINY) & (b[None, :] >= TINY)
        return np.where(whole, product / np.where(whole, a[:, None] * b[None, :], 1), 0.0)
    if metric == "l2sq":
        return np.maximum((queries**2).sum(1)[:, None] + (rows**2).sum(1)[None, :] - 2 * product, 0)
    raise ValueError(f"metric is {metric!r}")


def _best(key: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k smallest (key, id)."""
    if len(key) > 4 * k:
        edge = np.partition(key, k - 1)[k - 1]
        near = np.flatnonzero(key <= edge)
    else:
        near = np.arange(len(key))
    return near[np.lexsort((ids[near], key[near]))[:k]]


def _summed(a: np.ndarray, b: np.ndarray | None = None, minus: bool = False) -> np.ndarray:
    """Sums over the places (first axis) of a * b, or of (a - b) ** 2, one after the other."""
    out = np.zeros(a.shape[1])
    for i in range(len(a)):
        x = a[i] - b[i] if minus else a[i]
        out += x * (x if minus or b is None else b[i])
    return out


class _Side:
    """Vectors of one side: by place, their sums of squares, and as they enter the matrix product."""

    def __init__(self, metric: str, vectors: np.ndarray):
        self.by_place = np.ascontiguousarray(vectors.T)
        self.squares = _summed(self.by_place)
        self.norms = np.sqrt(self.squares)
        whole = self.norms >= TINY
        self.near = np.where(whole[:, None], vectors / np.where(whole, self.norms, 1)[:, None], 0.0) if metric == "cosine" else vectors
        self.whole = whole

    def __len__(self) -> int:
        return len(self.near)


def _keys(metric: str, q: _Side, r: _Side, qi: np.ndarray, ri: np.ndarray) -> np.ndarray:
    """Exact keys (the smaller the nearer) of pairs of queries and rows."""
    out = np.empty(len(qi))
    for lo in range(0, len(qi), PAIRS):
        i, j = qi[lo : lo + PAIRS], ri[lo : lo + PAIRS]
        a, b = np.take(q.by_place, i, 1), np.take(r.by_place, j, 1)
        if metric == "l2sq":
            out[lo : lo + PAIRS] = _summed(a, b, True)
            continue
        s = _summed(a, b)
        if metric == "cosine":
            whole = q.whole[i] & r.whole[j]
            s = np.where(whole, np.clip(s / np.sqrt(np.where(whole, q.squares[i] * r.squares[j], 1)), -1, 1), 0.0)
        out[lo : lo + PAIRS] = -s
    return out


def _searcher(metric: str, k: int, threshold: float | None, exclude_self: bool):
    sign = 1.0 if metric == "l2sq" else -1.0
    most = np.inf if threshold is None else sign * threshold

    def tile(q: _Side, r: _Side, lo: int, ids: np.ndarray, own_ids: np.ndarray, key: np.ndarray, own: np.ndarray) -> None:
        """Merge a block of rows into key and own, the k best so far of the queries from lo on, in place."""
        at = slice(lo, lo + len(key))
        s = q.near[at] @ r.near.T
        slack = np.full(len(key), 1e-11)
        if metric == "l2sq":
            s = q.squares[at, None] + r.squares[None, :] - 2 * s
            slack *= q.squares[at] + r.squares.max() + TINY
        else:
            np.negative(s, out=s)
            if metric == "dot":
                slack *= q.norms[at] * r.norms.max() + TINY
        limit = np.minimum(np.where(own[:, -1] == _NONE, np.inf, key[:, -1]), most)
        may = ~(s > (limit + slack)[:, None])  # not-a-number may
        if len(ids) > k and np.count_nonzero(may) > 4 * k * len(key):
            if exclude_self:
                s[own_ids[:, None] == ids[None, :]] = np.inf
            edge = np.partition(s, k - 1, axis=1)[:, k - 1]
            may &= ~(s > (edge + slack)[:, None])
        i, j = np.nonzero(may)
        if exclude_self:
            others = own_ids[i] != ids[j]
            i, j = i[others], j[others]
        new = _keys(metric, q, r, i + lo, j)
        right = ~(new > most)
        i, j, new = i[right], j[right], new[right]
        if not len(i):
            return
        touched, place = np.unique(i, return_inverse=True)
        n = len(touched)
        place = np.concatenate((place, np.repeat(np.arange(n), k)))
        both, who = np.concatenate((new, key[touched].ravel())), np.concatenate((ids[j], own[touched].ravel()))
        order = np.lexsort((who, both, place))
        nth = np.arange(len(order)) - np.searchsorted(place[order], np.arange(n))[place[order]]
        best = order[nth < k]
        key[touched], own[touched] = both[best].reshape(n, k), who[best].reshape(n, k)

    def run(query_ids: np.ndarray, queries: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, step = len(query_ids), max(1, TILE // ROWS)
        q = _Side(metric, queries)
        key, own = np.full((n, k), np.nan), np.full((n, k), _NONE)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                ids, r = batch.column(0).slice(lo, ROWS).to_numpy(), _Side(metric, matrix(batch.column(1).slice(lo, ROWS)))
                for at in range(0, n, step):
                    tile(q, r, at, ids, query_ids[at : at + step], key[at : at + step], own[at : at + step])
        for at in range(0, n, ROWS):
            told = own[at : at + ROWS] != _NONE
            if told.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(query_ids[at : at + ROWS], told.sum(1))), pa.array(own[at : at + ROWS][told]), pa.array(sign * key[at : at + ROWS][told])], names=["query_id", "neighbor_id", "score"])

    return run


def ranked(hits: DataFrame, k: int, ascending: bool, by: tuple[str, ...] = ("query_id",), ties: tuple[str, ...] = ("neighbor_id",), rank: str = "rank") -> DataFrame:
    """The k nearest hits of each query, ranked from 1 under (score, ties)."""
    order = F.col("score").asc() if ascending else F.col("score").desc()
    w = Window.partitionBy(*by).orderBy(order, *[F.col(t) for t in ties])
    return hits.withColumn(rank, F.row_number().over(w).cast("long")).filter(F.col(rank) <= k)


def query_blocks(queries: DataFrame, vector: str, limit: int = MAX_QUERY_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of at most ``limit`` bytes at a time, streamed to the driver partition by partition."""
    ids, rows, held = [], [], 0
    for r in queries.toLocalIterator():
        ids.append(r[0])
        rows.append(np.asarray(r[1], np.float64))
        held += rows[-1].nbytes
        if held >= limit:
            yield np.array(ids, np.int64), np.stack(rows)
            ids, rows, held = [], [], 0
    if ids:
        yield np.array(ids, np.int64), np.stack(rows)


def _chunks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[list[pa.RecordBatch]]:
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def stored_batches(files: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Batches of (id, vector) from files of the shared folder."""
    for uri in files:
        fs, path = open_fs(uri)
        with fs.open_input_file(path) as source:
            yield from pq.ParquetFile(source, buffer_size=1 << 20).iter_batches(batch_size=ROWS)


def _stored_blocks(files: list[str], limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of at most ``limit`` bytes (or one row) at a time from files of the shared folder."""
    for batch in stored_batches(files):
        ids, rows = batch.column(0).to_numpy(), matrix(batch.column(1))
        size = max(1, limit // max(1, 8 * rows.shape[1]))
        for lo in range(0, len(ids), size):
            yield ids[lo : lo + size], rows[lo : lo + size]


def searched(rows: DataFrame, queries: DataFrame, run: Callable, prune: Callable[[np.ndarray], Column] | None = None) -> DataFrame:
    """query_id, neighbor_id, score: run(ids, vectors, batches) for blocks of queries(id, vector) over all rows.

    A set of one block is broadcast (``prune`` of its vectors then filters the rows); a larger one is read by the tasks
    from the shared folder, and a query may then be told of by several chunks of a partition.
    """
    spark, kind = rows.sparkSession, "query_id long, neighbor_id long, score double"
    blocks = query_blocks(queries, queries.columns[1])
    first = next(blocks, None)
    if first is None:
        return spark.createDataFrame([], kind)
    if next(blocks, None) is None:
        shared = spark.sparkContext.broadcast(first)
        mine = rows.filter(prune(first[1])) if prune else rows
        return mine.mapInArrow(lambda batches: run(*shared.value, batches), kind)
    files = sorted(store(queries, "queries").inputFiles())
    limit, chunk = MAX_QUERY_BYTES, CHUNK_BYTES

    def past(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _chunks(batches, chunk):
            for ids, vectors in _stored_blocks(files, limit):
                yield from run(ids, vectors, iter(held))

    return rows.mapInArrow(past, kind)


def _told_once(rows: DataFrame, queries: DataFrame, run: Callable) -> DataFrame:
    """As ``searched``, with each query told of by one task: a block is broadcast, more are dealt to tasks that read all rows."""
    spark, kind = rows.sparkSession, "query_id long, neighbor_id long, score double"
    blocks = query_blocks(queries, queries.columns[1], min(BLOCK_BYTES, MAX_QUERY_BYTES))
    first = next(blocks, None)
    if first is None:
        return spark.createDataFrame([], kind)
    if next(blocks, None) is None:
        shared = spark.sparkContext.broadcast(first)
        return rows.mapInArrow(lambda batches: run(*shared.value, batches), kind)
    files, limit = sorted(store(rows, "rows").inputFiles()), OWN_BYTES

    def past(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _chunks(batches, limit):
            asked = pa.Table.from_batches(held)
            yield from run(asked.column(0).to_numpy(), matrix(asked.column(1)), stored_batches(files))

    return queries.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(past, kind)


def knn(corpus: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", *, id: str = "vec_id", vector: str = "embedding", threshold: float | None = None, exclude_self: bool = False, where: Column | None = None) -> DataFrame:  # noqa: A002
    """query_id, rank, neighbor_id, score of the k nearest corpus rows of each query.

    where filters the corpus before the search, so k matching neighbours are found; threshold is applied before the cut.
    Rows without vector are left out. An empty corpus or query set gives an empty result.
    """
    if metric not in METRICS:
        raise ValueError(f"metric is {metric!r}")
    rows = corpus.filter(where) if where is not None else corpus
    rows, asked = (df.filter(F.col(vector).isNotNull()).select(F.col(id).cast("long"), vector) for df in (rows, queries))
    found = _told_once(rows, asked, _searcher(metric, k, threshold, exclude_self))
    return ranked(found, k, metric == "l2sq").select("query_id", "rank", "neighbor_id", "score")


def merged(hits: DataFrame, k: int, metric: str = "l2sq") -> DataFrame:
    """k nearest of hits from several shards: (score, local id, info or shard) decides, and both ids are told."""
    ties = tuple(c for c in ("local_idx", "info", "shard_id") if c in hits.columns)
    return ranked(hits, k, metric == "l2sq", ties=ties)


def sharded(corpus: DataFrame, queries: DataFrame, k: int, shards: int = 4, metric: str = "l2sq", *, id: str = "vec_id", vector: str = "embedding") -> DataFrame:  # noqa: A002
    """k nearest by shards: query_id, rank, shard_id, local_idx, neighbor_id, score.

    The search runs once over all shards; its rows carry (shard, local index) packed into one id, so the order of ties is
    that of the merge: score, local index, shard.
    """
    place = (F.floor(F.col(id) / shards) * shards + F.pmod(F.col(id), F.lit(shards))).cast("long")
    hits = knn(corpus.withColumn(id, place), queries, k, metric, id=id, vector=vector)
    return hits.select("query_id", "rank", F.pmod("neighbor_id", F.lit(shards)).cast("long").alias("shard_id"), F.floor(F.col("neighbor_id") / shards).cast("long").alias("local_idx"), "neighbor_id", "score")


def shard_batches(names: DataFrame, size: int = 100, force: bool = False, order: str = "wsi_name") -> DataFrame:
    """names with shard_id: batches of ``size`` in order; an incomplete last batch waits unless forced.

    Numbering is by sorted ranges and prefix counts, so no task holds all names.
    """
    numbered = numbered_rows(names, order)
    shard = numbered.withColumn("shard_id", F.floor(F.col("_row") / size).cast("long"))
    if force:
        return shard.drop("_row")
    total = numbered.agg(F.count("*").alias("_n"))  # one row
    return shard.crossJoin(F.broadcast(total)).filter(F.col("shard_id") < F.floor(F.col("_n") / size)).drop("_row", "_n")


def numbered_rows(df: DataFrame, *order: str | Column) -> DataFrame:
    """df with _row, its place from 0 in the total order, by range partitions and a prefix sum of their counts.

    The sorted partitions are stored before they are counted: laid out twice, ranges may be cut at other places, as they
    are drawn from a sample.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # The high bits of the id are the partition, the low 33 the place inside it.
    laid = store(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftrightunsigned("_at", 33).alias("_part")
    counts = laid.groupBy(part).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    # One row for each partition.
    placed = laid.withColumn("_part", F.shiftrightunsigned("_at", 33)).join(F.broadcast(starts), "_part")
    return placed.withColumn("_row", F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_at", "_start")


def positional(hits: DataFrame, infos: DataFrame, keys: tuple[str, ...] = ("shard_id", "local_idx")) -> DataFrame:
    """hits with what stands at their position in the infos of their shard; positions out of range go."""
    return hits.join(infos, list(keys))


def zipped(keys: str, **columns: DataFrame) -> DataFrame:
    """Lists (key, position, value) side by side by position, cut to the shortest of each key."""
    out = None
    for name, rows in columns.items():
        one = rows.select(keys, "position", F.col("value").alias(name))
        out = one if out is None else out.join(one, [keys, "position"])
    return out


def pooled(hits: DataFrame, ascending: bool = False, name: str = "position") -> DataFrame:
    """All hits of all queries in one order by score, then ids, numbered from 1 without a final cut."""
    key = F.col("score") if ascending else -F.col("score")
    return numbered_rows(hits.withColumn("_k", key), "_k", "query_id", "neighbor_id").withColumn(name, F.col("_row") + 1).drop("_k", "_row")
