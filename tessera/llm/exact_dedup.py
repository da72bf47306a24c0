"""Exact deduplication by a tree merge of sorted digest runs.

Every input partition turns its texts into one run: rows (SHA-256, length, best identifier, count), sorted by digest,
one per digest. The runs then meet in binomial rounds, as in a recursive-halving exchange: with 2**d nodes, a round
fixes ``BITS`` more leading bits of a row's node to those of its digest, so 2**BITS nodes exchange parts of their runs
and each merges what it gets. After ceil(d / BITS) rounds node i holds all of digest range i and no more than that;
no node ever holds the whole corpus, and a digest has at most 2**BITS rows in any merge, however many copies exist.
Each merge verifies that rows it joins agree in the whole digest and in length.

Defined cases: a null text is an empty text; a null doc_id never wins over a number, and if a group has only null
ids its keep_id is null; rows repeated with one doc_id are all marked kept, and deduplicate() returns the first;
an empty table gives an empty result; further columns are passed on untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import fresh, lean, repeated, store
from tessera.operators.components import lookup

#: log2 of the number of runs that one merge takes.
BITS = 3
_RUN = "node int, digest binary, length long, best_id long, n long"
_ARROW = pa.schema([("node", pa.int32()), ("digest", pa.binary()), ("length", pa.int64()), ("best_id", pa.int64()), ("n", pa.int64())])


def text_digests(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, digest (SHA-256 of the text in UTF-8), length in bytes, the columns of keep."""
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return docs.select("doc_id", F.unhex(F.sha2(text, 256)).alias("digest"), F.octet_length(text).cast("long").alias("length"), *keep)


def _interleaved(runs: list[np.ndarray]) -> np.ndarray:
    """The order that merges sorted runs, given their keys: neighbours are merged in pairs until one run is left."""
    starts = np.cumsum([0, *(len(r) for r in runs)])
    merged = [(r, np.arange(a, a + len(r))) for r, a in zip(runs, starts, strict=False)]
    while len(merged) > 1:
        nxt = []
        for (x, i), (y, j) in zip(merged[::2], merged[1::2], strict=False):
            at = np.searchsorted(x, y, "right") + np.arange(len(y))  # where the second run's rows go
            rest = np.ones(len(x) + len(y), bool)
            rest[at] = False
            keys, place = np.empty(len(rest), x.dtype), np.empty(len(rest), np.int64)
            keys[at], place[at], keys[rest], place[rest] = y, j, x, i
            nxt.append((keys, place))
        merged = nxt + merged[len(merged) // 2 * 2 :]
    return merged[0][1]


def _merged(node, digest, length, ids, valid, n, largest: bool, runs: bool) -> pa.RecordBatch | None:
    """One sorted run: a row for each (node, digest). runs: the rows are sorted runs one after the other, which are merged."""
    if not len(node):
        return None
    keys = np.frombuffer(b"".join(digest), "S32")
    if runs:
        parts = np.split(np.argsort(node, kind="stable"), np.flatnonzero(np.diff(np.sort(node))) + 1)
        order = np.concatenate([p[_interleaved(np.split(keys[p], np.flatnonzero(keys[p][1:] < keys[p][:-1]) + 1))] for p in parts])
    else:
        order = np.lexsort((keys, node))
    node, words, length, ids, valid, n = node[order], keys[order].view(">u8").reshape(-1, 4), length[order], ids[order], valid[order], n[order]
    new = np.ones(len(node), bool)
    new[1:] = (node[1:] != node[:-1]) | (words[1:] != words[:-1]).any(1)
    if (~new[1:] & (length[1:] != length[:-1])).any():
        raise ValueError("texts of different length share a SHA-256 digest")
    first = np.flatnonzero(new)
    low, high = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    pick = np.maximum if largest else np.minimum
    best = pick.reduceat(np.where(valid, ids, low if largest else high), first)
    known = np.logical_or.reduceat(valid, first)
    raw = words[first].tobytes()
    return pa.record_batch(
        [pa.array(node[first].astype(np.int32)), pa.array([raw[i : i + 32] for i in range(0, len(raw), 32)], pa.binary()), pa.array(length[first]), pa.array(best, mask=~known), pa.array(np.add.reduceat(n, first))],
        schema=_ARROW,
    )


def _merge(largest: bool, runs: bool):
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not got:
            return
        table = pa.Table.from_batches(got)
        ids = table["best_id"].combine_chunks()
        out = _merged(
            table["node"].to_numpy(), table["digest"].to_pylist(), table["length"].to_numpy(),
            ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False), table["n"].to_numpy(), largest, runs,
        )
        if out is not None:
            yield out

    return merge


def tree_merge(digests: DataFrame, keep: str = "largest", bits: int = BITS) -> DataFrame:
    """digest, length, best_id, n: one row per digest, by binomial rounds over sorted runs."""
    if keep not in ("largest", "smallest"):
        raise ValueError(f"keep is {keep!r}")
    merge = _merge(keep == "largest", True)
    depth = max(1, (max(1, digests.rdd.getNumPartitions()) - 1).bit_length())
    lead = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long")
    runs = digests.select(F.pmod(F.spark_partition_id(), F.lit(2**depth)).cast("int").alias("node"), "digest", "length", F.col("doc_id").cast("long").alias("best_id"), F.lit(1).cast("long").alias("n"))
    runs = runs.mapInArrow(lean(_merge(keep == "largest", False)), _RUN)
    for fixed in range(bits, depth + bits, bits):
        fixed = min(fixed, depth)
        rest = 2 ** (depth - fixed)
        to = F.shiftright(lead, 32 - fixed) * F.lit(rest) + F.pmod(F.col("node"), F.lit(rest))
        runs = runs.withColumn("node", to.cast("int")).repartitionById(2**depth, "node").mapInArrow(lean(merge), _RUN)
    return runs.drop("node")


def _marked(digests: DataFrame, keep: str) -> DataFrame:
    """digests with keep_id, group_size, kept."""
    # Only digests with copies are looked up; a hot digest is one row there, and its documents are split by salt.
    groups = store(tree_merge(digests.select("doc_id", "digest", "length"), keep).filter("n > 1").select("digest", F.col("best_id").alias("keep_id"), F.col("n").alias("group_size"), F.lit(True).alias("_several")), "groups")
    out = lookup(digests, "digest", groups, groups.agg(F.max("group_size")).first()[0] or 0, "left")
    out = out.withColumn("keep_id", F.when(F.col("_several"), F.col("keep_id")).otherwise(F.col("doc_id")))
    return out.withColumn("group_size", F.coalesce("group_size", F.lit(1)).cast("long")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def duplicates(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs."""
    digests = store(text_digests(docs), "digests")
    return _marked(digests, keep).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicate(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """The rows of docs that stay, one for each distinct text, with all their columns.

    Rows are numbered as they are read; of rows that share the doc_id that stays, the first stays. Texts are not shuffled.
    """
    row = fresh(docs, "_row")
    numbered = store(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    digests = store(text_digests(numbered, row), "digests")
    marked = store(_marked(digests.withColumnRenamed(row, "row"), keep).filter("group_size > 1").select("row", "digest", "kept"), "copies")
    first = marked.filter("kept").groupBy("digest").agg(F.min("row").alias("row"))
    gone = marked.join(first, "row", "left_anti").select(F.col("row").alias(row), F.lit(0).alias("n"))
    return repeated(numbered, row, gone, 1)
