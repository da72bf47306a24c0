"""Every registered query of the engine runs, and equals its oracle SQL in DuckDB."""

from __future__ import annotations

import decimal
import math

import duckdb
import pytest

from tessera.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLE = catalogue.queries(), catalogue.oracle_sql()


def plain(v):
    v = v.item() if hasattr(v, "item") else v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return str(v)[:19] if hasattr(v, "isoformat") else v


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert rows
    if name in ORACLE:
        result = duck.execute(ORACLE[name])
        at = [[d[0] for d in result.description].index(c) for c in columns]
        assert len(at) == len(result.description)
        assert rows == sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=repr)


def test_entry_imports_without_the_subpackage(monkeypatch, spark):
    import importlib
    import sys

    for gone in ("corpus_pipeline", "tessera.llm", "tessera.llm.queries"):
        monkeypatch.setitem(sys.modules, gone, None)
    import __spark_entry__ as entry

    entry = importlib.reload(entry)
    assert entry.queries().keys() == QUERIES.keys() and entry.oracle_sql() == ORACLE
    assert entry.entry(spark).count() == 5 * spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").filter("vec_id % 20 = 0").count()
    monkeypatch.undo()
    importlib.reload(entry)


def test_plans_prune_columns_and_push_filters(spark, sf):
    from pyspark.sql import functions as F

    from tessera.operators.knn import knn
    from tessera.plans import fixtures

    e = fixtures.embeddings(spark, sf)
    plan = knn(e.filter("label = 3"), e.filter("vec_id < 5"), 3)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(label), EqualTo(label,3)" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    plan = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id"))._jdf.queryExecution().toString()
    assert "ReadSchema: struct<doc_id:bigint>" in plan


@pytest.mark.parametrize("name", ["ann_recall", "beam_search", "ivf_search", "lsh_search"])
def test_approximate_searches_ask_every_twentieth_vector(spark, sf, name):
    wanted = {r["vec_id"] for r in spark.read.parquet(f"{sf}/embeddings.parquet").filter("vec_id % 20 = 0").collect()}
    assert {r["query_id"] for r in QUERIES[name](spark, sf).select("query_id").collect()} == wanted


def recall_of_query(spark, folder, name, metric):
    from tessera.operators.knn import knn
    from tessera.plans import fixtures

    exact = {(r["query_id"], r["neighbor_id"]) for r in knn(fixtures.embeddings(spark, folder), fixtures.asked(spark, folder), 10, metric).collect()}
    found = [(r["query_id"], r["neighbor_id"]) for r in QUERIES[name](spark, folder).collect()]
    assert len(found) == len(set(found))
    return len(exact & set(found)) / len(exact)


def test_recall_of_registered_lsh_search(spark, sf):
    for folder in (sf, sf.replace("0.001", "0.01"), sf.replace("0.001", "0.1")):
        assert recall_of_query(spark, folder, "lsh_search", "cosine") >= 0.9


def test_recall_of_registered_ivf_search(spark, sf):
    for folder in (sf, sf.replace("0.001", "0.01"), sf.replace("0.001", "0.1")):
        assert recall_of_query(spark, folder, "ivf_search", "l2sq") >= 0.9


def test_inbatch_dedup_compares_whole_texts_in_bounded_batches(spark, tmp_path, monkeypatch):
    texts = ["one two", "one three", "one two", "four", "one two", "four", "five", "one three"]
    rows = [(i // 3, i % 3, "user", t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    monkeypatch.setattr(catalogue, "BATCH", 4)
    got = sorted((r["batch"], r["place"], r["texts"][0]) for r in QUERIES["inbatch_dedup"](spark, str(tmp_path)).collect())
    wanted = []
    for b in (0, 1):
        seen = set()
        for i in range(4 * b, 4 * b + 4):
            if texts[i] not in seen:
                wanted.append((b, i // 3 * 1000 + i % 3, texts[i]))
            seen.add(texts[i])
    assert got == wanted
    monkeypatch.undo()
    n = QUERIES["inbatch_dedup"](spark, "/root/testdata/sf0.1").groupBy("batch").count().collect()
    assert sum(r["count"] for r in n) == 5012 and max(r["count"] for r in n) <= 512 and len(n) == 10
