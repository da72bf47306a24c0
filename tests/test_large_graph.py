"""A graph over the size that goes to every task is searched by joins, with the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import graph
from tessera.plans import fixtures


def test_a_graph_over_the_bound_is_searched_with_the_same_result(spark, sf, monkeypatch):
    n = fixtures.patches(spark, sf).select(F.col("vec_id").alias("node"), F.col("slide_no").alias("wsi_id"), "level", "gx", "gy", "embedding")
    edges = graph.pruned(n, graph.supporting_edges(n), graph.semantic_edges(n, 8), 8)
    index = n.select("node", "embedding").join(graph.flattened(edges, 8).withColumnRenamed("src", "node"), "node").cache()
    q = fixtures.asked(spark, sf).limit(6)
    search = lambda: {(r["query_id"], r["rank"]): (r["neighbor_id"], round(r["score"], 9)) for r in graph.beam_search(index, q, 5, buffer=20, max_iters=4, starts=16).collect()}
    small = search()
    monkeypatch.setattr(graph, "MAX_GRAPH_BYTES", 1)
    assert search() == small and len(small) == 30
