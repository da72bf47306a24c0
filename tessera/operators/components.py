"""Connected components: union-find inside bounded groups, and a distributed search for graphs of any size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import lean, remove, ship, store

#: Edges that one task may finish by union-find.
FINISH = 200_000
#: Rows of one key that a join may have in one task; keys with more are split.
HUB = 1_000_000


class UnionFind:
    """Disjoint sets of 0..n-1; a set's root is its smallest member."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def union(self, i: int, j: int) -> bool:
        """Join two sets; whether they were apart."""
        i, j = self.find(i), self.find(j)
        self.parent[max(i, j)] = min(i, j)
        return i != j


def cut(df: DataFrame) -> DataFrame:
    """df behind a table in the shared folder."""
    return store(df, "cut")


def lookup(rows: DataFrame, key: str, table: DataFrame, largest: int | None, how: str = "inner") -> DataFrame:
    """rows joined to a table with one row a key. A key has at most ``largest`` rows (None: not known).

    Keys that may have over HUB rows are split: the table's row is first joined to the distinct (key, salt) of the rows,
    at most one for each salt, and these to the rows.
    """
    if largest is not None and largest <= HUB:
        return rows.join(table, key, how)
    salts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int"))
    spread = salted.select(key, "_salt").distinct().join(table, key)
    return salted.join(spread, [key, "_salt"], how).drop("_salt")


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, to) of every node of one task's edges: to is the smallest node of its component."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    got = pa.Table.from_batches(batches)
    both = pa.chunked_array([*got["a"].chunks, *got["b"].chunks])
    nodes = both.unique().sort()
    code = both.dictionary_encode().combine_chunks()
    rank = np.argsort(np.argsort(code.dictionary.to_numpy(zero_copy_only=False), kind="stable"), kind="stable")[code.indices.to_numpy()]
    sets = UnionFind(len(nodes))
    for i, j in zip(rank[: got.num_rows].tolist(), rank[got.num_rows :].tolist(), strict=True):
        sets.union(i, j)
    yield pa.RecordBatch.from_arrays([nodes, nodes.take(pa.array([sets.find(i) for i in range(len(nodes))]))], names=["a", "to"])


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", told: list | None = None) -> DataFrame:
    """node, component (its smallest node) for every node of an undirected edge list. Edges with a null end are left out.

    Each round gives nodes a new random order. Every node hooks to the first of those at most two steps away, hooks are
    followed twice, and edges are drawn anew between the survivors. A node survives only if nothing near it comes before
    it, so at most half of them do in expectation, on chains in any order too, and a star is gone after one round: the
    rounds are logarithmic in the nodes, and their tables shrink. Hubs are split in joins and pre-aggregated elsewhere.
    Once at most FINISH edges are left, one task on an executor ends the search by union-find. Only the number of edges
    and the largest degree leave the tables each round. told: gets these, a pair a round.
    """
    first = store(edges.select(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b")).filter(F.col(src).isNotNull() & F.col(dst).isNotNull()).distinct(), "edges")
    rest, hooks, rounds = first.filter("a <> b"), [], 0
    while True:
        both = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        n, degree = both.groupBy("a").count().agg(F.sum("count"), F.max("count")).first()
        if not n:
            break
        if told is not None:
            told.append((n // 2, degree))
        if n <= 2 * FINISH:
            ship(rest.sparkSession)
            kind = rest.schema["a"].dataType.simpleString()
            hooks.append(store(rest.repartition(1).mapInArrow(lean(_finished), f"a {kind}, to {kind}"), "hooks"))
            break
        order = lambda x: F.struct(F.xxhash64(x, F.lit(rounds)).alias("h"), F.col(x).alias("v"))  # noqa: B023, E731
        near = both.groupBy("a").agg(F.min(order("b")).alias("near")).select("a", F.least(order("a"), "near").alias("near"))
        beyond = lookup(both.select(F.col("a").alias("v"), F.col("b").alias("a")), "a", near, degree).groupBy("v").agg(F.min("near").alias("beyond"))
        hook = near.join(beyond.withColumnRenamed("v", "a"), "a").select("a", F.least("near", "beyond")["v"].alias("to"))
        hook = store(hook, "hooks")
        again = hook.select(F.col("a").alias("to"), F.col("to").alias("on"))
        hooks.append(store(lookup(hook, "to", again, None if degree > HUB else n).select("a", F.col("on").alias("to")), "hooks"))
        left = lookup(rest, "a", hooks[-1], degree).select("b", F.col("to").alias("x"))
        ends = lookup(left, "b", hooks[-1].select(F.col("a").alias("b"), "to"), degree).filter("x <> to")
        drawn = store(ends.select(F.least("x", "to").alias("a"), F.greatest("x", "to").alias("b")).distinct(), "edges")
        remove(hook, *([rest] if rounds else []))
        rest, rounds = drawn, rounds + 1
    nodes = first.select(F.col("a").alias("node")).union(first.select("b")).distinct()
    roots = None
    for hook in reversed(hooks):  # each table is a constant share of the one before it
        hook = hook.select(F.col("a").alias("node"), F.col("to").alias("root"))
        if roots is not None:
            beyond = roots.select(F.col("node").alias("root"), F.col("root").alias("on"))
            hook = lookup(hook, "root", beyond, None, "left").select("node", F.coalesce("on", "root").alias("root"))
        roots = hook
    if roots is None:
        return nodes.withColumn("component", F.col("node"))
    named = roots.withColumnRenamed("root", "component")
    if rounds:  # their hooks end at any node of the component
        roots = store(roots, "roots")
        least = roots.groupBy("root").agg(F.min("node").alias("component"))
        named = store(lookup(roots, "root", least, None).select("node", "component"), "components")
        remove(roots, *hooks, rest)
    return nodes.join(named, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
