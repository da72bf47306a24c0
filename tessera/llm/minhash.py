"""Near-duplicate documents: fast similarity sketching, banding, and exact verification.

A document's set holds the hashes of its distinct runs of five words (or its whole sequence, if shorter). Its sketch
has ``BINS`` places: in each round every element is hashed to a place and a value, and a place keeps the least value
of the first round that reached it. After ``BINS`` such rounds, a last round for each place takes all elements, so every
place fills. Places agree with probability equal to the sets' similarity, with the concentration of independent ones.

1. Documents with equal sets are one class; only the class's smallest doc_id goes on.
2. Sketches are cut in ``BANDS`` bands of ``ROWS`` places; classes that agree in a band share a bucket. At similarity 0.75
   a pair shares none with probability 5e-6.
3. Every member of a bucket is compared with the bucket's first: where sketches agree in ``AGREE`` places or more (missed
   at 0.75 with probability under 1e-7) and set sizes allow 0.75, the full sets decide. This is linear, and settles most.
4. Buckets of three or more whose members are still apart have all pairs of sketches compared between what is apart, the
   most alike first; the spanning forests found join the members to families, and full sets decide on their links.
5. Families that are still apart after that have all pairs of full sets compared between what is apart, in numpy.
   Components of all links that full sets confirmed are the result.

Buckets and families over ``BLOCK`` members are cut in blocks, and pairs of blocks are dealt to tasks, so no task holds a
whole large group, nothing is capped, and tasks return spanning forests of what they find, never all pairs. Links and
components stay in tables; each round of the component search cuts its lineage in the shared folder.

Defined cases: a null or empty text has the empty set and is linked with nothing; rows with a null doc_id are linked
with nothing and kept; rows that share a doc_id count as one document with the links of all; an empty table gives an
empty result; further columns are ignored by groups() and passed on by distinct_rows().
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textkernel as K
from tessera.llm.shared import by_group, fresh, lean, repeated, store
from tessera.operators.components import UnionFind, connected_components, lookup

WIDTH = 5
PERCENT = 75
BINS, BANDS, ROWS = 128, 32, 4
AGREE = 70
BLOCK = 512
_U = K.U
_EMPTY = _U(2**64 - 1)
_LOW = _U(2**56 - 1)
_SEEDS = [_U(K.mix_int(0xFA57 + i)) for i in range(2 * BINS)]


# --- sets and sketches -------------------------------------------------------------------------------------------


def sets_of(t: K.Texts, width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    low = K.Texts(t.first, K.lower(t.buf), t.offsets)
    starts, ends = K.spans(low)
    h = K.Rolling(low.buf)(starts, ends)
    bounds = K.split_docs(starts, t.offsets)
    s, _, at = K.windows(h, bounds, width)
    out = []
    for i in range(len(t)):
        a, b = bounds[i], bounds[i + 1]
        if b - a >= width:
            out.append(np.unique(s[at[i] : at[i + 1]]))
        elif b > a:
            out.append(K.combine([h[k : k + 1] for k in range(a, b)]))
        else:
            out.append(np.zeros(0, _U))
    return out


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """One row of BINS values for each set; a set without elements has all places empty."""
    out = np.full(len(sets) * BINS, _EMPTY)
    sizes = np.array([len(s) for s in sets], np.int64)
    x = np.concatenate(sets) if len(sets) else np.zeros(0, _U)
    owner = np.repeat(np.arange(len(sets)), sizes)
    for i, seed in enumerate(_SEEDS):
        if not len(x):
            break
        h = K.mix(x ^ seed)
        place = (h >> _U(57)).astype(np.int64) if i < BINS else np.full(len(x), i - BINS)
        np.minimum.at(out, owner * BINS + place, (h & _LOW) | _U(i << 56))
        if i % 4 == 0 or len(x) > 10_000:
            open_ = (out.reshape(-1, BINS) == _EMPTY).any(1)
            live = open_[owner]
            if not live.all():
                x, owner = x[live], owner[live]
    return out.reshape(-1, BINS)


def band_keys(short: np.ndarray) -> np.ndarray:
    """A key for each band of sketches of 32-bit places."""
    wide = short.astype(_U).reshape(len(short), BANDS, ROWS)
    return K.mix(K.combine([wide[:, :, k] for k in range(ROWS)]) ^ (np.arange(BANDS, dtype=_U) * _U(0x9E3779B97F4A7C15)))


_SKETCHED = "doc_id long, n_shingles long, digest binary, sketch binary"


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for t in K.texts(batch.column("text")):
            sets = sets_of(t)
            short = sketches(sets).astype(np.uint32)
            n = np.array([len(s) for s in sets], np.int64)
            digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            sketch = [row.tobytes() if k else None for row, k in zip(short, n, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(t.first, len(t)), pa.array(n), pa.array(digest, pa.binary()), pa.array(sketch, pa.binary())], names=["doc_id", "n_shingles", "digest", "sketch"])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("id")
        for lo in range(0, len(ids), 2048):
            short = np.frombuffer(b"".join(batch.column("sketch").slice(lo, 2048).to_pylist()), np.uint32).reshape(-1, BINS)
            keys = band_keys(short).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), ids.take(pa.array(lo + np.repeat(np.arange(len(short)), BANDS)))], names=["key", "id"])


# --- groups in blocks --------------------------------------------------------------------------------------------


def in_blocks(rows: DataFrame, key: str, n: str, block: int = BLOCK) -> DataFrame:
    """rows dealt to pairs of blocks of their group: (key, _i, _j). A group of up to ``block`` members is one pair, (0, 0)."""
    k = F.ceil(F.col(n) / block).cast("int")
    own = F.pmod(F.xxhash64("id", F.lit(3)), k).cast("int")
    dealt = rows.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), k - 1)))
    dealt = dealt.withColumn("_i", F.least("_own", "_other")).withColumn("_j", F.greatest("_own", "_other")).drop("_own", "_other")
    return dealt.repartition(key, "_i", "_j").sortWithinPartitions(key, "_i", "_j", "id")


def _by_pair_of_blocks(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of one (key, _i, _j) each, from rows sorted by it; they may span batches."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(n).to_numpy(zero_copy_only=False) for n in (key, "_i", "_j")]
        edges = np.flatnonzero(np.concatenate(([True], np.any([c[1:] != c[:-1] for c in columns], axis=0), [True])))
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            mine = tuple(c[lo] for c in columns)
            if held and mine != now:
                yield pa.Table.from_batches(held)
                held = []
            now = mine
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([min(x) for x in found], pa.int64()), pa.array([max(x) for x in found], pa.int64())], names=["a", "b"])


def _forests(key: str, linked):
    """Spanning forests of the links that linked(table) yields as pairs of rows, between members that have not one label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []
        for table in _by_pair_of_blocks(batches, key):
            if table.num_rows < 2:
                continue
            ids = table["id"].to_numpy()
            forest = UnionFind(len(ids))
            _, first, part = np.unique(table["part"].to_numpy(), return_index=True, return_inverse=True)
            if len(first) < 2:
                continue
            for i, p in enumerate(part.tolist()):
                forest.union(i, int(first[p]))
            found += [(int(ids[i]), int(ids[j])) for i, j in linked(table, part) if forest.union(i, j) and ids[i] != ids[j]]
            if len(found) > 20_000:
                yield _edges(found)
                found = []
        if found:
            yield _edges(found)

    return run


def _size_fits(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m)


def _agreeing(table: pa.Table, part: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs of different parts whose sketches agree, the most alike first."""
    short = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint32).reshape(-1, BINS)
    n = table["n_shingles"].to_numpy()
    pairs, scores = [], []
    for i in range(len(short) - 1):
        same = (short[i + 1 :] == short[i]).sum(1)
        hit = np.flatnonzero((same >= AGREE) & _size_fits(n[i + 1 :], n[i]) & (part[i + 1 :] != part[i]))
        pairs.append(np.stack([np.full(len(hit), i), hit + i + 1], 1))
        scores.append(same[hit])
    pairs = np.concatenate(pairs)
    yield from map(tuple, pairs[np.argsort(-np.concatenate(scores), kind="stable")].tolist())


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) whose sketches agree."""
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(f"sketch_{k}").to_pylist()), np.uint32).reshape(-1, BINS) for k in "ab")
        hit = ((x == y).sum(1) >= AGREE) & _size_fits(batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy())
        yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(hit)) for k in "ab"], names=["a", "b"])


def _similar(table: pa.Table, part: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs of different parts whose full sets reach the similarity."""
    sets = [np.frombuffer(x, _U) for x in table["shingles"].to_pylist()]
    n = np.array([len(s) for s in sets], np.int64)
    if len(sets) <= 3:
        shared = np.zeros((len(sets), len(sets)), np.int64)
        for i in range(len(sets)):
            for j in range(i + 1, len(sets)):
                shared[i, j] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
    else:  # shared elements by matrix products over those that occur twice or more
        code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
        several = count > 1
        rank = np.cumsum(several) - 1
        owner = np.repeat(np.arange(len(sets)), n)[several[code]]
        code = rank[code[several[code]]]
        order = np.argsort(code, kind="stable")
        code, owner = code[order], owner[order]
        total, step = int(rank[-1]) + 1 if len(rank) else 0, 4096
        product = np.zeros((len(sets), len(sets)), np.float32)
        cuts = np.searchsorted(code, np.arange(0, total + step, step))
        for k in range(len(cuts) - 1):
            some = np.zeros((len(sets), min(step, total - k * step)), np.float32)
            some[owner[cuts[k] : cuts[k + 1]], code[cuts[k] : cuts[k + 1]] - k * step] = 1
            product += some @ some.T
        shared = product.astype(np.int64)
    for i in range(len(sets) - 1):
        union = n[i] + n[i + 1 :] - shared[i, i + 1 :]
        for j in np.flatnonzero((100 * shared[i, i + 1 :] >= PERCENT * union) & (union > 0) & (part[i + 1 :] != part[i])) + i + 1:
            yield i, int(j)


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, id) whose full sets reach the similarity, from rows grouped by (a, _i) with the rows of a itself."""
    for table in _by_pair_of_blocks(batches, "a"):
        a, ids = table["a"][0].as_py(), table["id"].to_numpy()
        sets = [np.frombuffer(x, _U) for x in table["shingles"].to_pylist()]
        own = [s for s, i in zip(sets, ids, strict=True) if i == a]
        found = set()
        for s, i in zip(sets, ids.tolist(), strict=True):
            for x in own if i != a else []:
                if len(x) and len(s) and _size_fits(np.int64(len(x)), np.int64(len(s))):
                    n = np.count_nonzero(x[np.minimum(np.searchsorted(x, s), len(x) - 1)] == s)
                    if 100 * n >= PERCENT * (len(x) + len(s) - n):
                        found.add((a, i))
        if found:
            yield _edges(sorted(found))


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for t in K.texts(batch.column("text")):
            rows = batch.slice(t.first, len(t))
            others = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(rows.column(n) for n in others), pa.array([s.tobytes() for s in sets_of(t)], pa.binary())], names=[*others, "shingles"])


def components(edges: DataFrame) -> DataFrame:
    """id, label of every node of the edges (a, b): label is the smallest id of its component."""
    return connected_components(edges, "a", "b").select(F.col("node").alias("id"), F.col("component").alias("label"))


# --- operator ----------------------------------------------------------------------------------------------------


def _sets_of(docs: DataFrame, nodes: DataFrame, row: str | None) -> DataFrame:
    """id, shingles of the docs that the distinct ids of nodes name. row: a column as repeated() takes it, with which no text is shuffled."""
    texts, schema = docs.select(F.col("doc_id").cast("long").alias("id"), "text", *([row] if row else [])), "id long, shingles binary"
    if not row:
        return texts.join(nodes, "id").select("id", "text").mapInArrow(lean(_full_sets), schema)
    found = texts.select("id", row).join(nodes, "id", "left_semi")
    return repeated(texts, row, found.select(row, F.lit(1).alias("n")), 0, _full_sets, schema)


def confirmed(docs: DataFrame, pairs: DataFrame, row: str | None = None) -> DataFrame:
    """The distinct pairs (a, b) whose full sets reach the similarity. A set is sent once for each pair, and that of a node
    with many partners once for each ``BLOCK`` of them as well."""
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("k"))
    dealt = lookup(pairs, "a", sizes, None).select("a", F.pmod(F.xxhash64("b"), F.col("k")).cast("int").alias("_i"), F.col("b").alias("id"))
    own = sizes.select("a", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("_i"), F.col("a").alias("id"))
    asked = dealt.unionByName(own).withColumn("_j", F.lit(0))
    nodes = asked.select("id").distinct()
    sets = _sets_of(docs, nodes, row)
    rows = asked.join(sets, "id").select("a", "_i", "_j", "id", "shingles").repartition("a", "_i").sortWithinPartitions("a", "_i", "_j", "id")
    return rows.mapInArrow(lean(_confirmed), "a long, b long")


def _labelled(ids: DataFrame, label: DataFrame) -> DataFrame:
    """ids with part: the label of each, itself where it has none."""
    return ids.join(label.withColumnRenamed("label", "part"), "id", "left").withColumn("part", F.coalesce("part", "id"))


def links(docs: DataFrame, classes: DataFrame, row: str | None = None) -> DataFrame:
    """Links (a, b) that join all classes of similarity 0.75 or more. classes: id, n_shingles, sketch."""
    bands = classes.select("id", "sketch").mapInArrow(lean(_bands), "key long, id long")
    shared = store(bands.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("first")).filter("n > 1"), "buckets")
    buckets = store(lookup(bands, "key", shared, None), "bucket-rows")
    # What is alike to the first of its bucket.
    side = lambda k: classes.select(F.col("id").alias(k), F.col("n_shingles").alias(f"n_{k}"), F.col("sketch").alias(f"sketch_{k}"))
    stars = buckets.filter("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()
    stars = lookup(stars.join(side("b"), "b"), "a", side("a"), None).mapInArrow(lean(_alike), "a long, b long")
    found = store(confirmed(docs, store(stars, "alike"), row), "links")
    # What else its bucket may hold.
    parts = _labelled(buckets, components(found))
    apart = parts.filter("n > 2").groupBy("key").agg(F.min("part").alias("x"), F.max("part").alias("y")).filter("x <> y").select("key")
    left = lookup(parts, "key", apart, None).join(classes, "id")
    forest = in_blocks(left, "key", "n").select("key", "_i", "_j", "id", "part", "n_shingles", "sketch").mapInArrow(lean(_forests("key", _agreeing)), "a long, b long")
    forest = store(forest.distinct(), "alike")
    if forest.isEmpty():
        return found
    more = store(found.unionByName(confirmed(docs, forest, row)), "links")
    # Families that these links leave apart.
    family = components(found.unionByName(forest))
    parts = _labelled(family, components(more))
    sizes = parts.groupBy("label").agg(F.count("*").alias("n"), F.min("part").alias("x"), F.max("part").alias("y")).filter("x <> y").select("label", "n")
    members = store(lookup(parts, "label", sizes, None), "families")
    if members.isEmpty():
        return more
    full = _sets_of(docs, members.select("id").distinct(), row).join(members, "id")
    dealt = in_blocks(full, "label", "n", BLOCK // 4).select("label", "_i", "_j", "id", "part", "shingles")
    return more.unionByName(dealt.mapInArrow(lean(_forests("label", _similar)), "a long, b long"))


def groups(docs: DataFrame, row: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs. row: see _sets_of()."""
    sketched = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(_sketch), _SKETCHED)
    sketched = store(sketched, "sketches")
    named = by_group(sketched.drop("sketch"), "digest", F.xxhash64("doc_id"), 64, {"first": (F.min("doc_id"), F.min)})
    named = store(named.withColumn("first", F.when(F.col("doc_id").isNotNull(), F.coalesce("first", "doc_id"))), "classes")
    first = named.filter("n_shingles > 0 and doc_id = first").select(F.col("doc_id").alias("id"), "digest").distinct()
    classes = store(sketched.select(F.col("doc_id").alias("id"), "n_shingles", "digest", "sketch").join(first, ["id", "digest"], "left_semi").drop("digest"), "class-sketches")
    # A document is tied to the class of its set; classes are tied by links; and rows of one doc_id by that.
    tied = named.filter("doc_id <> first").select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    several = tied.join(named.filter("n_shingles > 0").groupBy("doc_id").agg(F.countDistinct("digest").alias("k")).filter("k > 1").select(F.col("doc_id").alias("b")), "b", "left_semi").select("a", "b")
    found = components(links(docs, classes, row).unionByName(several)).select(F.col("id").alias("first"), "label")
    out = named.join(found, "first", "left")
    component = F.coalesce("label", "first", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def distinct_rows(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, one document of each group, with all their columns. What goes is found by numbers of
    rows, so texts are not shuffled to drop it."""
    row = fresh(docs, "_row")
    numbered = store(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    gone = groups(numbered, row).filter("not kept").select("doc_id").distinct()
    found = numbered.select(F.col("doc_id").cast("long").alias("doc_id"), row).join(gone, "doc_id", "left_semi")
    return repeated(numbered, row, found.select(row, F.lit(0).alias("n")), 1)
