"""Golden values, properties and recall of the engine's operators."""

from __future__ import annotations

import gzip
import html
import json
import math
import uuid

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import captions, ids, text, vector
from tessera.operators import ann, collection, components, corpus, graph, knn, metrics, quadtree, regions, tiles
from tessera.plans import api, fixtures
from tessera.session import store
from tessera.sources import files, tables
from tessera.streaming import ingest


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


# --- functions ----------------------------------------------------------------------------------------------------


def test_cosine_guards(spark):
    zero, unit = F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(0.0))
    r = one(spark, vector.cosine(zero, unit), vector.cosine(zero, unit, "epsilon"), vector.cosine_distance(zero, unit), vector.cosine_distance(unit, zero))
    assert list(r) == [0.0, 0.0, 1.0, 1.0]
    with pytest.raises(ValueError, match="guard"):
        vector.cosine(zero, unit, "other")


def test_info_strings(spark):
    rows = ["7_a_b.svs_10_20_256_256_1.png", "a_1.png", "", "0_S0_HE.svs_256_0_256_256_0.png"]
    p = captions.parse_info(F.col("s"))
    got = spark.createDataFrame([(r,) for r in rows], "s string").select("s", *[c.alias(k) for k, c in p.items()], captions.is_complete(p).alias("ok")).collect()
    assert (got[0]["slide_id"], got[0]["wsi_name"], got[0]["source_wsi_name"], got[0]["x"], got[0]["y"], got[0]["level"]) == ("7", "a_b.svs", "7_a_b.svs", 10, 20, 1)
    assert [r["ok"] for r in got] == [True, False, False, True]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(0, 10**6), min_size=5, max_size=5))
def test_captions_round_trip(spark, numbers):
    built = captions.caption(*[F.lit(n) for n in numbers])
    assert list(one(spark, *captions.parse_caption(built).values())) == numbers


def test_natural_order(spark):
    rows = ["b10", "b2", "a", "B1"]
    got = spark.createDataFrame([(r,) for r in rows], "s string").orderBy(captions.natural_key(F.col("s"))).collect()
    assert [r["s"] for r in got] == ["a", "B1", "b2", "b10"]


def test_uuid5_and_text(spark):
    names = ["http://x", "", "é"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(ids.uuid5(F.col("n"))).collect()
    assert [r[0] for r in got] == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]
    raw = " a &amp;lt; b\n c_d! "
    r = one(spark, text.basic_clean(F.lit(raw)), text.whitespace_clean(F.lit(raw)), text.canonicalize(F.lit("A_b, c!")), text.canonicalize(F.lit("A, {}!"), keep="{}"), text.clean(F.lit(raw), "lower"))
    assert list(r) == [html.unescape(html.unescape(raw)).strip(" "), "a &amp;lt; b c_d!", "a b c", "a {}", "a < b c_d!"]
    t = one(spark, text.fixed_length(F.array(*[F.lit(i) for i in range(1, 100)]), 10).alias("t"))["t"]
    assert t == [text.START, *range(1, 9), text.END]
    assert one(spark, F.size(text.block_mask(F.array(*[F.lit(str(i)) for i in range(9)]), F.lit(3), 4)))[0] == 4


def test_position_embedding(spark):
    got = one(spark, vector.sincos(F.lit(3), 8).alias("e"))["e"]
    angle = [3 / 10000 ** (i / 4) for i in range(4)]
    assert got == pytest.approx([math.sin(a) for a in angle] + [math.cos(a) for a in angle])


# --- tiles and regions --------------------------------------------------------------------------------------------


def test_reshape_and_mesh(spark):
    r = one(spark, *tiles.reshaped(F.lit(0), F.lit(0), F.lit(100), F.lit(100), F.lit(4.0)))
    assert list(r) == [0, 25, 200, 50]
    r = one(spark, tiles.mesh_step(F.lit(448)), tiles.mesh_step(F.lit(300)), tiles.mesh_step(F.lit(100)))
    assert r[0] in (224, 112) and list(r)[1:] == [148, 224] or list(r) == [112, 76, 224]


def hit_rows(spark, rows):
    return spark.createDataFrame([(1, 1, i, x, y, s) for i, (x, y, s) in enumerate(rows)], "query_id long, level int, patch_id long, gx int, gy int, score double")


def test_region_score_and_duplicates(spark):
    joined = regions.connected(hit_rows(spark, [(0, 0, 0.9), (1, 0, 0.8), (1, 1, 0.7)]), ["query_id", "level"])
    box = regions.region_boxes(joined, ["query_id"]).first()
    assert (box["x0"], box["y0"], box["x1"], box["y1"]) == (0, 0, 1, 1) and box["score"] == pytest.approx(0.6)
    twice = hit_rows(spark, [(5, 5, 1.0), (5, 5, 1.0)])
    assert regions.connected(twice, ["query_id", "level"]).select("region_id").distinct().count() == 2
    assert regions.connected(twice, ["query_id", "level"], singletons=False).count() == 0
    near = hit_rows(spark, [(5, 5, 1.0), (5, 5, 1.0), (6, 6, 1.0)])
    assert regions.connected(near, ["query_id", "level"]).select("region_id").distinct().count() == 1


def test_corner_contact(spark):
    rects = spark.createDataFrame([(1, 1, 0, 0, 256, 256), (1, 2, 256, 256, 256, 256)], "g int, patch_id long, x int, y int, w int, h int")
    assert regions.touching(rects, ["g"]).count() == 0
    assert regions.adjacency(rects, ["g"], x="x", y="y", w="w", h="h").count() == 2


def test_region_score_does_not_change_with_place(spark):
    rows = [(0, 0, 0.5), (1, 1, 0.25), (2, 2, 0.125), (7, 7, 1.0)]
    boxes = [sorted(r["score"] for r in regions.region_boxes(regions.connected(hit_rows(spark, [(x + d, y + 2 * d, s) for x, y, s in rows]), ["query_id", "level"]), ["query_id"]).collect()) for d in (0, 13)]
    assert boxes[0] == boxes[1]


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), min_size=1, max_size=60))
def test_components_are_an_equivalence(spark, pairs):
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    sets = components.UnionFind(41)
    for a, b in pairs:
        sets.union(a, b)
    assert got == {n: sets.find(n) for p in pairs for n in p}


def test_components_of_chains_and_hubs_take_few_rounds(spark, monkeypatch):
    monkeypatch.setattr(components, "FINISH", 0)
    chain = spark.range(9_999).selectExpr("id AS src", "id + 1 AS dst")
    star = spark.range(20_001, 23_000).selectExpr("20500L AS src", "id AS dst")
    told: list = []
    got = components.connected_components(chain.union(star), told=told).groupBy("component").count().collect()
    assert {r["component"]: r["count"] for r in got} == {0: 10_000, 20_001: 2_999}
    assert len(told) <= 20
    monkeypatch.setattr(components, "HUB", 10)  # keys with more rows are split
    got = components.connected_components(star).agg(F.min("component"), F.max("component"), F.count("*")).first()
    assert tuple(got) == (20_001, 20_001, 2_999)


def test_supporting_edges(spark):
    rows = [(1, 1, 2, 4, 1), (2, 1, 3, 4, 1), (3, 1, 1, 2, 0)]
    nodes = spark.createDataFrame(rows, "node long, wsi_id long, gx int, gy int, level int")
    assert {tuple(r) for r in graph.supporting_edges(nodes).collect()} == {(1, 3), (3, 1)}
    assert {tuple(r) for r in graph.supporting_edges(nodes, "pyramid").collect()} == {(1, 3), (3, 1), (2, 3), (3, 2)}


# --- metrics ------------------------------------------------------------------------------------------------------


def test_average_precision(spark):
    rows = [(1, r, r, 99, rel) for r, rel in enumerate([True, False, True, False, False], 1)]
    hits = spark.createDataFrame(rows, "query_id long, rank long, n_sub long, q_sub long, relevant boolean")
    walk = metrics.distinct_walk(hits, "n_sub", "q_sub")
    assert metrics.average_precision(walk, "relevant").first()["ap"] == pytest.approx((1 + 2 / 3) / 5)
    assert metrics.average_precision_legacy(hits, "n_sub", "q_sub", "relevant").first()["ap"] == pytest.approx((1 + 2 / 3) / 2)


def test_votes_and_pairs(spark):
    votes = spark.createDataFrame([(1, c) for c in (1, 1, 0, 0, 2)], "query_id long, code int")
    assert metrics.majority_vote(votes, "code").first()["vote"] == 0
    a = spark.createDataFrame([(1, 1), (1, 2)], "query_id long, neighbor_id long")
    b = spark.createDataFrame([(1, 2), (1, 3), (2, 1), (2, 2)], "query_id long, neighbor_id long")
    assert tuple(metrics.precision_recall(a, b).first()) == (0.5, 0.25)


# --- search -------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vectors(spark, sf):
    return fixtures.embeddings(spark, sf), fixtures.embeddings(spark, sf).filter("vec_id < 50")


def test_query_blocks_and_shards_do_not_change_results(spark, vectors, monkeypatch):
    e, q = vectors
    whole = [tuple(r) for r in knn.knn(e, q, 7, "l2sq").orderBy("query_id", "rank").select("query_id", "neighbor_id").collect()]
    blocks = list(knn.query_blocks(q.select("vec_id", "embedding"), "embedding", 64 * 8 * 9))
    assert len(blocks) == 6 and sum(len(b[0]) for b in blocks) == 50
    monkeypatch.setattr(knn.query_blocks, "__defaults__", (64 * 8 * 9,))
    assert [tuple(r) for r in knn.knn(e.repartition(9), q, 7, "l2sq").orderBy("query_id", "rank").select("query_id", "neighbor_id").collect()] == whole
    assert [tuple(r) for r in knn.sharded(e, q, 7).orderBy("query_id", "rank").select("query_id", "neighbor_id").collect()] == whole


def test_query_sets_over_the_bound_are_read_by_tasks(spark, vectors, monkeypatch):
    e, q = vectors
    cells = ann.train_cells(e, 8)
    index = ann.assigned(e, cells, 2)
    searches = [lambda: knn.knn(e, q, 5, threshold=0.1, exclude_self=True), lambda: ann.ivf_search(index, cells, q, 5, 3), lambda: ann.lsh_search(e, q, 5, tables=4, bits=4)]
    rows = lambda df: sorted((r["query_id"], r["rank"], r["neighbor_id"], round(r["score"], 9)) for r in df.collect())
    whole = [rows(s()) for s in searches]
    monkeypatch.setattr(knn.query_blocks, "__defaults__", (64 * 8 * 9,))
    monkeypatch.setattr(knn, "MAX_QUERY_BYTES", 64 * 8 * 9)
    monkeypatch.setattr(knn, "CHUNK_BYTES", 1)
    monkeypatch.setattr(knn, "store", lambda df, name: store(df.repartition(3), name))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "70")
    try:
        assert [rows(s()) for s in searches] == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_search_of_nothing(spark, vectors):
    e, q = vectors
    assert knn.knn(e, q.limit(0), 3).count() == 0 == knn.knn(e.limit(0), q, 3).count()
    with_null = e.union(spark.createDataFrame([(99_999, None, 1)], e.schema))
    assert knn.knn(with_null, q, 3).count() == 150
    with pytest.raises(ValueError, match="metric"):
        knn.knn(e, q, 3, "other")


def test_recall_of_approximate_searches(spark, sf, vectors):
    e, q = vectors
    exact = {(r["query_id"], r["neighbor_id"]) for r in knn.knn(e, q, 10, "l2sq").collect()}
    share = lambda df: len(exact & {(r["query_id"], r["neighbor_id"]) for r in df.collect()}) / len(exact)
    cells = ann.train_cells(e, 16)
    index = ann.assigned(e, cells)
    at = [share(ann.ivf_search(index, cells, q, 10, n)) for n in (1, 8, 16)]
    assert at == sorted(at) and at[-1] == 1.0
    assert share(ann.lsh_search(e, q, 10, tables=24, bits=4)) > 0.9
    n = fixtures.patches(spark, sf).select(F.col("vec_id").alias("node"), F.col("slide_no").alias("wsi_id"), "level", "gx", "gy", "embedding")
    pruned = graph.pruned(n, graph.supporting_edges(n), graph.semantic_edges(n, 16), 16)
    degrees = {r["src"]: r["count"] for r in pruned.groupBy("src").count().collect()}
    assert len(degrees) == 500 and max(degrees.values()) <= 16
    assert pruned.filter("src = dst").count() == 0 and pruned.groupBy("src", "dst").count().filter("count > 1").count() == 0
    assert pruned.filter("kind = 0").count() == graph.supporting_edges(n).count()
    index = n.select("node", "embedding").join(graph.flattened(pruned, 16).withColumnRenamed("src", "node"), "node")
    assert share(graph.beam_search(index, q, 10)) > 0.9


def test_numbering_is_dense(spark):
    got = knn.numbered_rows(spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(5), "k").collect()
    assert {r["k"]: r["_row"] for r in got} == {i: i for i in range(1000)}


def test_requests(spark, sf, vectors):
    assert [api.top_k(x) for x in ("7", None, -1, "x", 0)] == [7, 20, 20, 20, 20]
    hits, told = api.search(vectors[0], fixtures.infos(spark, sf), vectors[1].filter("vec_id < 3"), 60)
    assert hits.count() == 180 and all(r["tile_count"] == len(r["tiles"]) > 1 for r in told.collect())
    assert json.loads(api.as_json(hits.limit(1)).first()[0])["rank"] >= 1
    boxes = api.region_search(vectors[0], fixtures.patches(spark, sf).drop("embedding"), vectors[1].filter("vec_id < 3"), 40)
    assert boxes.agg(F.sum("n_patches")).first()[0] == 120


# --- collections, corpora, streams, files -------------------------------------------------------------------------


def test_collection(spark, tmp_path):
    c = collection.Collection(spark, str(tmp_path), "c")
    assert not c.exists()
    c.create(2, "l2sq", "subject string")
    rows = [(i, [float(i), 0.0], "history" if i % 2 else "art") for i in range(10)]
    c.upsert(spark.createDataFrame(rows, "id long, vector array<float>, subject string"))
    c.upsert(spark.createDataFrame([(3, [30.0, 0.0], "law"), (11, [11.0, 0.0], "law")], "id long, vector array<float>, subject string"))
    assert c.count() == 11 and c.query(F.col("subject") == "law").count() == 2
    page, cursor = c.scroll(4)
    assert [r["id"] for r in page.collect()] == [0, 1, 2, 3] and [r["id"] for r in c.scroll(4, cursor)[0].collect()] == [4, 5, 6, 7]
    q = spark.createDataFrame([(0, [0.0, 0.0])], "id long, vector array<float>")
    assert [r["id"] for r in c.search(q, 2, where=F.col("subject") == "history", fields=["subject"]).orderBy("rank").collect()] == [1, 5]
    c.delete(F.col("subject") == "history")
    other = collection.Collection(spark, str(tmp_path), "d")
    other.create(2, "l2sq", "subject string")
    c.copy_to(other, 3)
    assert c.count() == 7 and other.count() == 3
    with pytest.raises(Exception, match="wrong size"):
        c.upsert(spark.createDataFrame([(1, [1.0], "x")], "id long, vector array<float>, subject string"))
    assert c.count() == 7


def test_versions_of_a_collection_are_whole(spark, tmp_path):
    c = collection.Collection(spark, str(tmp_path), "c")
    c.create(2, "l2sq", "subject string")
    schema = "id long, vector array<float>, subject string"
    for i in range(3):
        c.upsert(spark.createDataFrame([(i, [1.0, 2.0], "s")], schema))
    left = tmp_path / "c" / "version=9"  # a version whose writing ended early
    left.mkdir()
    (left / "part-0.parquet").write_bytes(b"PAR1")
    assert c.settings()["version"] == 3 and c.count() == 3
    left.joinpath("part-0.parquet").unlink()
    left.rmdir()
    c.insert(spark.createDataFrame([([3.0, 4.0], "t", 7), ([5.0, 6.0], None, None)], "vector array<float>, subject string, extra int"))
    assert sorted((r["id"], r["extra"]) for r in c.rows().filter("id > 2").collect()) in ([(3, 7), (4, None)], [(3, None), (4, 7)])
    assert c.stats()["rows"] == 5 and "extra" in c.stats()["columns"] and collection.collections(spark, str(tmp_path)) == ["c"]
    assert len(list((tmp_path / "c").glob("version=*"))) == 2


def test_exact_search_holds_scores_tile_by_tile():
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(3)
    q, rows = rng.normal(size=(6000, 4)), rng.normal(size=(4096, 4))
    rows[2048:] = rows[:2048]  # copies, the later ones of smaller id
    ids = np.arange(4096)[::-1].copy()
    vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, 4 * 4096 + 1, 4), pa.int32()), pa.array(rows.ravel()))
    batch = pa.RecordBatch.from_arrays([pa.array(ids), vectors], names=["id", "vector"])
    for metric, key in (("cosine", -(q @ rows.T) / np.linalg.norm(q, axis=1)[:, None] / np.linalg.norm(rows, axis=1)), ("l2sq", ((q[:, None, :] - rows[None, :, :]) ** 2).sum(2)), ("dot", -(q @ rows.T))):
        tracemalloc.start()
        got = pa.Table.from_batches(knn._searcher(metric, 4, None, False)(np.arange(6000), q, iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 96 << 20  # scores of all queries and rows at once are 196 MB
        found = got["neighbor_id"].to_numpy().reshape(-1, 4)
        for i in range(0, 6000, 500):
            assert list(found[i]) == [int(ids[j]) for j in np.lexsort((ids, np.round(key[i], 12)))[:4]]


@pytest.mark.parametrize("name", ["knn_self_all", "semantic_edges", "pruned_graph", "graph_stats", "flat_adjacency", "beam_search"])
def test_searches_of_all_rows_are_dealt_to_tasks_with_the_same_result(spark, sf, monkeypatch, name):
    from tessera.plans.catalogue import queries

    rows = lambda: sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in queries()[name](spark, sf).collect())
    whole = rows()
    monkeypatch.setattr(knn, "BLOCK_BYTES", 64 * 8 * 9)
    monkeypatch.setattr(knn, "OWN_BYTES", 1)
    stored = []
    monkeypatch.setattr(knn, "store", lambda df, name: stored.append(name) or store(df.repartition(3), name))
    assert rows() == whole and "rows" in stored


def test_places_are_dense_where_ranges_are_sampled(spark):
    rows = spark.range(300_000, numPartitions=1).select(F.xxhash64("id").alias("key"), F.repeat(F.lit("x"), 9).alias("more"))
    got = knn.numbered_rows(rows, "key").select("_row", "key").orderBy("_row").toPandas()
    assert (got["_row"] == np.arange(300_000)).all() and got["key"].is_monotonic_increasing


def test_thresholds_of_a_running_sum_equal_sql_with_ties_and_nulls(spark):
    import duckdb
    import pandas as pd

    t = pd.DataFrame({"k": [3, 1, 1, 2, None, 2, 5], "n": [4, 1, 2, None, 9, 3, 0]}).astype("Int64")
    con = duckdb.connect()
    con.register("t", t)
    df = spark.createDataFrame([tuple(None if pd.isna(x) else int(x) for x in r) for r in t.itertuples(index=False)], "k long, n int")
    wanted = con.execute("""WITH s AS (SELECT row_number() OVER (ORDER BY k) AS position, sum(n) OVER (ORDER BY k) AS running FROM t), x AS (SELECT unnest([0, 2, 5, 12, 100]) AS threshold)
     SELECT threshold, min(CASE WHEN running > threshold THEN position END), min(CASE WHEN running > threshold THEN running END) FROM s, x GROUP BY threshold""").fetchall()
    rows = lambda df: sorted(tuple(r) for r in metrics.cumulative_thresholds(df, "k", "n", (0, 2, 5, 12, 100)).collect())
    assert rows(df) == sorted((int(a), b, None if c is None else int(c)) for a, b, c in wanted)
    assert rows(df.limit(0)) == []


def test_tile_grid_equals_its_sql_on_a_partly_scanned_slide(spark, sf, tmp_path):
    import duckdb

    from tessera.plans import catalogue

    spark.read.parquet(f"{sf}/embeddings.parquet").filter("vec_id < 125 OR vec_id IN (207, 290)").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = catalogue.queries()["tile_grid"](spark, str(tmp_path)).select("slide_no", "level", "x", "y", "w", "h")
    assert sorted(tuple(r) for r in got.collect()) == sorted(con.execute(catalogue.oracle_sql()["tile_grid"]).fetchall())


def test_byte_pairs_are_encoded_in_slices_of_bounded_bytes(spark, monkeypatch):
    import pyarrow as pa

    texts = pa.array(["ab", None, "x" * 50, "", "é" * 4, "yy"])
    monkeypatch.setattr(text, "ENCODED", 10)
    assert [s.to_pylist() for s in text._slices(texts)] == [["ab", None], ["x" * 50], ["", "é" * 4, "yy"]] and list(text._slices(texts[:0])) == []


def test_mojibake_and_byte_pairs(spark):
    from tessera.plans.more import BYTE_PAIRS, public_tokenizers

    wrong = [w.encode().decode("latin-1") for w in ("café", "naïve – “so”", "日本")]
    assert [text.repaired(t) for t in wrong] == ["café", "naïve – “so”", "日本"]
    twice = "é".encode().decode("latin-1").encode().decode("latin-1")
    assert text.repaired(twice) == "é" and text.repaired("Ünder café £5 Ä") == "Ünder café £5 Ä"
    path = public_tokenizers.path(BYTE_PAIRS)
    rows = ["A cat, sat!", "", None, "naïve 12", "<|endoftext|>", "w " * 200]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").select("i", text.byte_pair_ids(F.col("t"), path).alias("ids"))
    got = df.select("i", "ids", text.fixed_length(F.col("ids")).alias("fixed"), text.byte_pair_text(F.col("ids"), path).alias("back")).orderBy("i").collect()
    assert [r["back"].strip() for r in got[:4]] == ["a cat , sat !", "", "", "naïve 1 2"]
    assert all(len(r["fixed"]) == 77 and r["fixed"][0] == text.START and text.END in r["fixed"] for r in got)
    assert got[5]["fixed"][-1] == text.END and text.END not in got[4]["ids"]


def test_tables_go_through_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'a "q", b\nc', None), (2, "", 1.5)], "i int, t string, x double")
    files.write_csv(rows, str(tmp_path / "csv"))
    assert sorted((r["i"], r["t"] or "", r["x"]) for r in files.read_csv(spark, str(tmp_path / "csv"), "i int, t string, x double").collect()) == [(1, 'a "q", b\nc', None), (2, "", 1.5)]
    assert files.ensured_json_list(spark, str(tmp_path / "list.json")).count() == 0 and (tmp_path / "list.json").read_text() == "[]"
    nodes = spark.range(100).selectExpr("id AS node", "id % 2 AS level")
    edges = spark.range(99).selectExpr("id AS src", "id + 1 AS dst")
    some, kept = files.sampled_index(nodes, edges, 10)
    inside = {r["node"] for r in some.collect()}
    assert len(inside) == 20 and {(r["src"], r["dst"]) for r in kept.collect()} == {(i, i + 1) for i in inside if i + 1 in inside}


def test_greedy_batches_and_samples(spark):
    rows = [(1, 1, ["a", "b"]), (1, 2, ["b", "c"]), (1, 3, ["c"]), (2, 1, ["b"])]
    got = corpus.unique_in_batch(spark.createDataFrame(rows, "batch int, place int, texts array<string>"), "batch", "place").collect()
    assert sorted((r["batch"], r["place"]) for r in got) == [(1, 1), (1, 3), (2, 1)]
    heavy = spark.range(1000).withColumn("w", F.when(F.col("id") < 100, 50.0).otherwise(0.1))
    assert corpus.weighted_sample(heavy, "id", "w", 100).filter("id < 100").count() > 80


def test_quadtree(spark, sf):
    t = quadtree.quadtree(fixtures.patches(spark, sf).filter("level = 1"), "slide_no", 32).collect()
    for s in {r["slide_no"] for r in t}:
        mine = [r for r in t if r["slide_no"] == s]
        assert len(mine) <= 32 and sum(r["n_tiles"] for r in mine if r["is_leaf"]) == 80


def test_files(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "x.svs").write_bytes(b"1" * 100)
    (tmp_path / "a" / "b" / "batch_10.json").write_text('["p", "q"]')
    (tmp_path / "a" / "batch_2.json").write_text("[broken")
    f = files.listing(spark, str(tmp_path))
    assert [r["name"] for r in files.with_prefix(f, "batch").collect()] == ["batch_10.json", "batch_2.json"]
    assert [r["folder"].split("/")[-1] for r in files.leaf_folders(f).collect()] == ["b"]
    assert files.slides(f, 50).count() == 1 and files.slides(f, 500).count() == 0
    assert [(r["pos"], r["value"]) for r in files.json_list(spark, str(tmp_path / "a" / "b" / "batch_10.json")).collect()] == [(0, "p"), (1, "q")]
    assert files.json_list(spark, str(tmp_path / "none.json")).count() == 0 == files.json_list(spark, str(tmp_path / "a" / "batch_2.json")).count()
    m = np.arange(12, dtype=np.float32).reshape(4, 3)
    np.save(tmp_path / "m.npy", m)
    got = files.matrices(spark, str(tmp_path)).orderBy("row").collect()
    assert np.array([r["embedding"] for r in got]).tolist() == m.tolist()
    with gzip.open(tmp_path / "s.jsonl.gz", "wt") as out:
        out.write('["a", "b"]\n{"texts": ["c", "d"]}\n{"context": "x", "response": "y"}\n{"context": "x"}\n')
    assert [r["texts"] for r in files.text_samples(spark, str(tmp_path / "s.jsonl.gz"), 2).collect()] == [["a", "b"], ["c", "d"], ["y", "x"]]
    with pytest.raises(Exception, match="has not 3 texts"):
        files.text_samples(spark, str(tmp_path / "s.jsonl.gz"), 3).collect()


def test_scripts_and_nodes(spark):
    assert tables.run_script(spark, "CREATE OR REPLACE TEMP VIEW v1 AS SELECT 1 AS a; CREATE OR REPLACE TEMP VIEW v2 AS SELECT 2 AS b;") == 2
    assert tables.run_lines(spark, "CREATE OR REPLACE TEMP VIEW v3 AS SELECT '0001-01-01' AS d\n") == 1
    assert spark.table("v3").first()["d"] == "1970-01-01"
    assert {"v1", "v2"} <= {r["table_name"] for r in tables.catalogue(spark).collect()}
    n = tables.text_nodes(spark.createDataFrame([(1, None)], "a int, b string"), "t").first()
    assert n["text"] == '{"a":1,"b":null}' and n["table_name"] == "t"


def test_incremental_ingest(spark, tmp_path):
    rows = spark.range(20).withColumn("ts", F.timestamp_seconds(F.col("id") * 60 + 1_700_000_000))
    rows.write.parquet(str(tmp_path / "in"))
    got = []

    def sink(batch, n):
        got.extend(r["id"] for r in batch.collect())

    for _ in range(2):
        ingest.ingest(ingest.once_each(ingest.file_stream(spark, str(tmp_path / "in"), rows.schema), "id", "ts"), sink, str(tmp_path / "state")).awaitTermination()
        rows.write.mode("append").parquet(str(tmp_path / "in"))
    assert sorted(got) == list(range(20))
    assert ingest.new_slides(rows.withColumnRenamed("id", "wsi_name"), spark.range(15).withColumnRenamed("id", "wsi_name")).count() == 5
