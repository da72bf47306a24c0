"""Exact and near deduplication against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, minhash
from tessera.llm import textkernel as K

SCHEMA = "doc_id long, text string, node int, _sha string, digest string, label string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", "y", "z") for i, t in rows], SCHEMA)


def test_equal_texts_keep_the_largest_id(spark):
    rows = [(1, "a"), (2, "b"), (3, "a"), (4, None), (5, ""), (6, "a "), (7, "é" * 5000), (8, "é" * 5000), (None, "b"), (9, "A")]
    got = {r["doc_id"]: r for r in exact_dedup.duplicates(table(spark, rows)).collect()}
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    for i, t in rows:
        mine = groups[t or ""]
        best = max((x for x in mine if x is not None), default=None)
        assert got[i]["keep_id"] == best and got[i]["group_size"] == len(mine) and got[i]["kept"] == (i == best)
        assert got[i]["text_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_smallest_id_and_hot_group_over_many_partitions(spark):
    rows = [(i, "same" if i % 3 else f"own {i}") for i in range(3000)]
    docs = table(spark, rows).repartition(13)
    got = exact_dedup.duplicates(docs, "smallest").collect()
    hot = [r for r in got if r["group_size"] > 1]
    assert len(hot) == 2000 and {r["keep_id"] for r in hot} == {1} and sum(r["kept"] for r in got) == 1001
    assert exact_dedup.tree_merge(exact_dedup.text_digests(docs), bits=1).count() == 1001


def test_repeated_rows_leave_one_and_columns_pass(spark):
    docs = table(spark, [(1, "a"), (1, "a"), (2, "a"), (2, "a"), (3, None), (None, "n"), (None, "n")])
    got = exact_dedup.deduplicate(docs)
    assert got.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["text"]) for r in got.collect()) == [("2", "a"), ("3", None), ("None", "n")]


def test_sorted_runs_are_merged():
    rng = np.random.default_rng(2)
    for sizes in ([5], [0, 3, 7], [1, 2, 3, 4, 5, 6, 7, 8], [40, 1, 1]):
        runs = [np.sort(rng.integers(0, 20, n)) for n in sizes]
        order = exact_dedup._interleaved(runs)
        whole = np.concatenate(runs)
        assert (whole[order] == np.sort(whole)).all() and sorted(order) == list(range(len(whole)))


def test_empty_tables(spark):
    docs = table(spark, [])
    assert exact_dedup.duplicates(docs).count() == exact_dedup.deduplicate(docs).count() == 0
    assert minhash.groups(docs).count() == minhash.distinct_rows(docs).count() == 0


def shingles(text: str | None) -> set:
    words = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def linked(rows) -> dict:
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            n = len(a & b)
            if a and b and 100 * n >= 75 * (len(a) + len(b) - n):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in sets}


def near_copies(rng: random.Random, families: int, copies: int) -> list[tuple[int, str]]:
    rows, n = [], 0
    for f in range(families):
        base = [f"w{f}_{rng.randrange(60)}" for _ in range(rng.randrange(12, 90))]
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 20)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            rows.append((n, " ".join(words)))
            n += 1
    return rows


def test_components_equal_brute_force(spark):
    rng = random.Random(5)
    rows = near_copies(rng, 12, 14)
    rows += [(1000, None), (1001, ""), (1002, "one two"), (1003, "ONE  two"), (1004, "one two three"), (1005, " \n\t"), (1006, "one two " * 4000), (None, "one two"), (1007, "one two " * 4000)]
    docs = table(spark, rows + rows[:3])
    want = linked(rows)
    got = minhash.groups(docs).collect()
    assert len(got) == len(rows) + 3
    for r in got:
        text = dict(rows)[r["doc_id"]]
        assert r["n_shingles"] == len(shingles(text))
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert r["component_id"] == want[r["doc_id"]] and r["kept"] == (want[r["doc_id"]] == r["doc_id"]), r
    kept = minhash.distinct_rows(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(want.values()) | {None}


def test_families_over_a_block_lose_no_link(spark):
    from tessera.llm.minhash import _forests, _similar, in_blocks

    rows = near_copies(random.Random(8), 1, 40)
    sets = [s for t in K.texts(pa.array([t for _, t in rows])) for s in minhash.sets_of(t)]
    df = spark.createDataFrame([(7, 40, i, bytearray(s.tobytes())) for (i, _), s in zip(rows, sets, strict=True)], "label long, n long, id long, shingles binary").withColumn("part", F.col("id"))
    edges = in_blocks(df, "label", "n", 6).select("label", "_i", "_j", "id", "part", "shingles").mapInArrow(_forests("label", _similar), "a long, b long")
    label = {r["id"]: r["label"] for r in minhash.components(edges).collect()}
    assert {i: label.get(i, i) for i, _ in rows} == linked(rows)


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(1)
    a, b = np.unique(rng.integers(0, 2**63, 900).astype(np.uint64)), None
    b = np.unique(np.concatenate((a[:800], rng.integers(0, 2**63, 100).astype(np.uint64))))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    s = minhash.sketches([a, b, a[:1], a[:3], a[:0]])
    assert (s[:4] != minhash._EMPTY).all() and (s[4] == minhash._EMPTY).all()
    assert abs((s[0] == s[1]).mean() - true) < 0.15


def test_chains_of_near_copies_are_one_group_and_blocks_do_not_matter(spark, monkeypatch):
    """Each text differs from the next by a few words, so that far ones are not alike, and buckets hold what stars miss."""
    rng = random.Random(11)
    words, rows = [f"c{i}" for i in range(60)], []
    for i in range(60):
        rows.append((i, " ".join(words)))
        words[rng.randrange(60)] = f"y{i}"
    rows += near_copies(rng, 3, 20)[:60]
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    rng.shuffle(rows)
    want = linked(rows)
    for block, agree in ((512, 70), (8, 70)):
        monkeypatch.setattr(minhash, "BLOCK", block)
        got = {r["doc_id"]: r["component_id"] for r in minhash.groups(table(spark, rows)).collect()}
        assert got == want
    assert len(set(want.values())) < 60


@pytest.mark.parametrize("n", [2, 3, 17, 200])
def test_components_of_paths_and_stars(spark, n):
    path = [(i, i + 1) for i in range(n - 1)]
    star = [(1000, 1000 + i) for i in range(1, n)]
    got = {r["id"]: r["label"] for r in minhash.components(spark.createDataFrame(path + star, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(n)} | {1000 + i: 1000 for i in range(n)}
    assert Counter(got.values()) == {0: n, 1000: n}
