"""The corpus pipeline, each stage against a brute-force version on what the stage before kept, and end to end."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_corpus_operators import encoded, water
from test_dedup import linked, near_copies

import corpus_pipeline
from tessera.llm import exact_dedup, minhash, mixing, quality, shared
from tessera.llm import textkernel as K
from tessera.session import lean

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row long, size long"


@pytest.fixture(scope="module")
def made(tmp_path_factory, spark):
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(20, 200))) for _ in range(80)]
    texts += [t for _, t in near_copies(rng, 6, 6)] + texts[:8] + texts[:4] + ["junk junk junk junk junk " * 20] * 3 + ["bad#" + t for t in texts[20:40]]
    rows = [(i, t, "en", f"s{i % 4}" if i % 9 else None, len(t), 1, 2) for i, t in enumerate(texts)]
    rows += [(900, None, None, None, None, None, None), (901, "", "en", "s1", 0, 1, 2), (None, texts[50] + " null id", "en", "s2", 9, 1, 2), rows[3], rows[3]]
    rows.append((902, " ".join(rng.choice(words) for _ in range(6000)), "en", "s0", 1, 1, 2))
    folder = tmp_path_factory.mktemp("pipeline")
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(not (t or "").startswith(("bad#", "junk"))), 0) for i, t, *_ in rows[::2]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def texts_of(rows):
    return Counter((r["doc_id"], r["text"]) for r in rows)


def test_stages_against_brute_force(spark, made):
    docs = spark.read.parquet(f"{made}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "exact_duplicates", "near_duplicates", "mix_sources", "pack_sequences"]
    before = docs.collect()
    # Quality: the same model over the rows at once.
    model = quality.fitted(docs, spark.read.parquet(f"{made}/labels.parquet"))
    kept = quality.judge(pa.array([r["text"] for r in before]), model)["kept"]
    docs = spark.createDataFrame(stages["quality_rules"](spark, docs, made).collect(), SCHEMA)
    rows = docs.collect()
    assert texts_of(rows) == texts_of([r for r, k in zip(before, kept, strict=True) if k]) and 0 < len(rows) < len(before)
    # Exact duplicates: the largest doc_id of each text, once.
    best = {}
    for r in rows:
        best[r["text"]] = max(best.get(r["text"], -1), -1 if r["doc_id"] is None else r["doc_id"])
    docs = spark.createDataFrame(stages["exact_duplicates"](spark, docs, made).collect(), SCHEMA)
    rows = docs.collect()
    assert Counter((-1 if r["doc_id"] is None else r["doc_id"], r["text"]) for r in rows) == Counter((i, t) for t, i in best.items())
    # Near duplicates: the smallest doc_id of each component; rows without one stay.
    label = linked([(r["doc_id"], r["text"]) for r in rows])
    wanted = texts_of([r for r in rows if r["doc_id"] is None or label[r["doc_id"]] == r["doc_id"]])
    docs = spark.createDataFrame(stages["near_duplicates"](spark, docs, made).collect(), SCHEMA)
    rows = docs.collect()
    assert texts_of(rows) == wanted and docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    # Mixing: targets of the water level, at most two of a row, which stay as they are.
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows:
        n = len((r["text"] or "").split())
        sizes[r["source"]] += n
        largest[r["source"]] = max(largest[r["source"]], n)
    docs = spark.createDataFrame(stages["mix_sources"](spark, docs, made).collect(), SCHEMA)
    mixed = docs.collect()
    for r in mixed:
        taken[r["source"]] += len((r["text"] or "").split())
    assert set(mixed) <= set(rows) and max(Counter(mixed).values()) <= 2
    for s, target in water(sizes).items():
        assert abs(taken[s] - target) <= max(5, 0.02 * target, largest[s] / 2)
    # Packing: every id of every copy once.
    packed = stages["pack_sequences"](spark, docs, made).collect()
    ids = {r["doc_id"]: encoded(r["text"]) for r in mixed}
    copies = Counter(r["doc_id"] for r in mixed)
    assert Counter(r["doc_id"] for r in packed if r["start"] == 0) == copies
    once = {i for i, n in copies.items() if n == 1}
    places = defaultdict(list)
    for r in packed:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in places.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    single = [r for r in packed if r["doc_id"] in once]
    by_doc = defaultdict(int)
    for r in single:
        by_doc[r["doc_id"]] += r["length"]
    assert by_doc == {i: len(ids[i]) for i in once}


def test_run_is_its_stages_and_empty_tables_pass(spark, made, tmp_path):
    assert corpus_pipeline.run(spark, made).agg(F.sum("length")).first()[0] > 1000
    empty = spark.read.parquet(f"{made}/documents.parquet").limit(0)
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rows_are_dropped_and_repeated_without_a_shuffle_of_texts(spark, made):
    docs = spark.read.parquet(f"{made}/documents.parquet").repartition(5)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for stage in (exact_dedup.deduplicate, minhash.distinct_rows, mixing.mix):
            out = stage(docs)
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and "Join" not in plan and out.columns == docs.columns and out.count() > 50
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rows_are_repeated_as_often_as_told(spark):
    docs = spark.range(5000, numPartitions=3).select("id", F.when(F.col("id") % 7 > 0, F.repeat(F.lit("x"), (F.col("id") % 5).cast("int"))).alias("text"))
    numbered = shared.store(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    counts = numbered.filter("id % 4 < 3 and id < 4000").select("_row", (F.col("id") % 4).alias("n"))
    for otherwise in (0, 1):
        got = shared.repeated(numbered, "_row", counts, otherwise).collect()
        wanted = {i: i % 4 if i % 4 < 3 and i < 4000 else otherwise for i in range(5000)}
        assert Counter(r["id"] for r in got) == {i: n for i, n in wanted.items() if n}
        assert all(r["text"] == ("x" * (r["id"] % 5) if r["id"] % 7 else None) for r in got)
        assert shared.repeated(numbered, "_row", counts.limit(0), otherwise).count() == 5000 * otherwise


def test_a_worker_gives_back_what_its_task_has_freed():
    used = lambda: int(re.search(r"Pss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024
    kept = []

    def run(batches):
        held = [bytes([i % 251]) * 2000 for i in range(40_000)]
        kept.append(bytes(2000))  # on top, so that free() alone gives nothing back
        yield from batches
        del held

    before = used()
    assert list(lean(run)(iter([1, 2]))) == [1, 2]
    assert used() - before < 30


def test_a_worker_keeps_few_powers_and_they_are_right():
    K.Rolling(np.zeros(3 << 20, np.uint8))
    assert sum(x.nbytes for x in K._powers.values()) < 4 << 20
    for base in (K._BASE, K._INVERSE):
        got = K._power(base, 200_001)
        assert len(got) == 200_001 and all(int(got[i]) == pow(base, i, 2**64) for i in (0, 1, 65_535, 65_536, 65_537, 131_072, 200_000))


def test_sets_of_candidates_take_one_worker_a_task(spark, made):
    docs = shared.store(spark.read.parquet(f"{made}/documents.parquet").drop("_row").withColumn("_row", F.monotonically_increasing_id()), "numbered")
    nodes = docs.filter("doc_id % 3 = 0").select(F.col("doc_id").cast("long").alias("id")).distinct()
    pairs = nodes.select(F.col("id").alias("a"), F.col("id").alias("b"))
    one, two = minhash._sets_of(docs, nodes, "_row"), minhash._sets_of(docs, nodes, None)
    assert one._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert {(r["id"], bytes(r["shingles"])) for r in one.collect()} == {(r["id"], bytes(r["shingles"])) for r in two.collect()}
    assert minhash.confirmed(docs, pairs, "_row")._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 2
