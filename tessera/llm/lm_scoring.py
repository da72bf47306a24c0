"""LM scoring: an interpolated modified Kneser-Ney n-gram model, counted in Spark and memory-mapped by workers.

Words are counted first, by 64-bit hash; each gets an id, small for frequent words. Mappers then count n-grams of the
highest order (``ORDER``) as rows of ids and send sorted, compressed runs by range, a few rows each. A reducer merges a
range's runs, writes them to the shared folder as a sorted hash array, and passes on the distinct endings of its
n-grams, which are the counts of the order below; so every order is counted in one pass over what the order above left.

A hash array holds 64-bit keys (32 bits of the context's hash, and the last word's id) in buckets of about 16 by the
context's leading bits, with 8-bit counts and a list of those that need more. A context's entries are neighbours, so its
sums come from its entries, or from a list for contexts with over ``WIDE`` of them. Workers map the files into memory,
at most ``MAPS`` at a time, and look up a slice's distinct n-grams; nothing is sent to them but the files' names, a few
sums a table and the hot words.

N-grams go to a range by the words between the first and the last, so that contexts and endings of these meet there.
Words so frequent that they would fill a range are hot: there are at most ``HOT_PER_RANGE`` for each range. If all
middle words are hot, the whole context decides, and if all of the context is, the n-gram; the sums of such contexts
are merged in Spark, in the shuffle of the order below, and kept in a table of their own.

Counts of n-grams below the highest order are numbers of different words before them, but occurrences where the n-gram
begins a text. Word ids are kept to 32 bits in keys, so that beyond 2**32 distinct words two may share the place of one
in the same context.

Defined cases: a null text is empty and has the end token alone; a null doc_id belongs to the training rows; without
training rows every word is equally likely; repeated rows count and are scored each; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import os
import shutil
from collections import OrderedDict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import textkernel as K
from tessera.llm.shared import local_path, new_path, open_fs, store, write_file

U = K.U
ORDER = 3
END = U(K.mix_int(0xE2D))
FLUSH = 3_000_000  # tokens counted before a mapper sends its runs
HOT_PER_RANGE = 4
WIDE = 16
MAPS = 2048
_SLICE = 4 << 20
_START = 0  # the id of what stands before a text; words have ids from 1
_NONE = U(2**64 - 1)  # the id of a word that is not in the model


# --- runs --------------------------------------------------------------------------------------------------------


def _narrow(a: np.ndarray) -> np.ndarray:
    top = int(a.max(initial=0))
    return a.astype(np.uint8 if top < 2**8 else np.uint16 if top < 2**16 else np.uint32 if top < 2**32 else U)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, by byte planes, compressed. The first is sorted and stored as differences."""
    z = zstandard.ZstdCompressor(level=1)
    out = [np.array([len(arrays[0]), len(arrays)], "<u4").tobytes()]
    for i, a in enumerate(arrays):
        a = _narrow(np.diff(a, prepend=a.dtype.type(0)) if i == 0 else a)
        data = z.compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes())
        out += [np.array([len(data), a.dtype.itemsize], "<u4").tobytes(), data]
    return b"".join(out)


def _unpack(data: bytes) -> list[np.ndarray]:
    n, k = np.frombuffer(data, "<u4", 2)
    at, out, z = 8, [], zstandard.ZstdDecompressor()
    for i in range(k):
        size, width = np.frombuffer(data, "<u4", 2, at)
        raw = z.decompress(data[at + 8 : at + 8 + size], max_output_size=int(n) * int(width) or 1)
        a = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).reshape(-1).view(f"<u{width}").astype(U)
        out.append(np.cumsum(a, dtype=U) if i == 0 else a)
        at += 8 + int(size)
    return out


def range_of(h: np.ndarray, ranges: int) -> np.ndarray:
    return (((h >> U(32)) * U(ranges)) >> U(32)).astype(np.int64)


def _runs(s: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts."""
    return np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else np.zeros(0, np.int64)


def counted(columns: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted distinct rows of the columns, and the sums of their counts."""
    if not len(n):
        return columns, n.astype(np.int64)
    key, bits = columns[0], int(columns[0].max()).bit_length()
    for c in columns[1:]:  # one number a row, in the rows' order
        more = int(c.max()).bit_length()
        if bits + more > 64:
            key = np.unique(key, return_inverse=True)[1].astype(U)
            bits = int(key.max()).bit_length()
        if bits + more > 64:
            c = np.unique(c, return_inverse=True)[1].astype(U)
            more = int(c.max()).bit_length()
        key, bits = key << U(more) | c, bits + more
    order = np.argsort(key, kind="stable")
    first = _runs(key[order])
    at = order[first]
    return [c[at] for c in columns], np.add.reduceat(n[order].astype(np.int64), first)


def occurring(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted distinct rows of the columns, and how often each occurs: by one sort in place where a row fits one number."""
    bits = [int(c.max(initial=0)).bit_length() for c in columns]
    if sum(bits) > 64:
        return counted([c.astype(U) for c in columns], np.ones(len(columns[0]), np.int64))
    key = columns[0].astype(U)
    for c, more in zip(columns[1:], bits[1:], strict=True):
        key <<= U(more)
        key |= c
    key.sort()
    first = _runs(key)
    n = np.diff(np.append(first, len(key)))
    key, out = key[first], []
    for more in reversed(bits):
        out.insert(0, key & U((1 << more) - 1))
        key = key >> U(more)
    return out, n


# --- tokens ------------------------------------------------------------------------------------------------------


def tokens(t: K.Texts) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words with END after each text, bounds by text)."""
    low = K.Texts(t.first, K.lower(t.buf), t.offsets)
    starts, ends = K.spans(low)
    h = K.Rolling(low.buf)(starts, ends)
    bounds = K.split_docs(starts, t.offsets)
    at = bounds + np.arange(len(bounds))
    out = np.full(at[-1], END, U)
    out[np.arange(len(h)) + K.owners(bounds)] = h
    return out, at


def before(x: np.ndarray, at: np.ndarray, first) -> np.ndarray:
    """The entry before each entry, ``first`` at the beginning of a text."""
    out = np.empty_like(x)
    out[1:] = x[:-1]
    out[at[:-1]] = first
    return out


# --- counting ----------------------------------------------------------------------------------------------------

_META = "range int, kind string, run binary, values array<long>"
_ROWS = pa.schema([("range", pa.int32()), ("kind", pa.string()), ("run", pa.binary()), ("values", pa.list_(pa.int64()))])


def _meta(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], f.type) for i, f in enumerate(_ROWS)], schema=_ROWS)


def _by_range(kind: str, r: np.ndarray, ranges: int, *arrays: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A run for each range; the arrays are sorted by the first inside a range already."""
    order = np.argsort(r, kind="stable")
    arrays = [a[order] for a in arrays]
    edges = np.searchsorted(r[order], np.arange(ranges + 1))
    live = np.flatnonzero(np.diff(edges))
    for some in np.array_split(live, max(1, len(live) // 64)):
        if len(some):
            yield _meta([(int(i), kind, _pack(*(a[edges[i] : edges[i + 1]] for a in arrays)), None) for i in some])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[np.ndarray, np.ndarray]]]:
    """Tokens of as many slices as make about FLUSH tokens."""
    held, n = [], 0
    for batch in batches:
        for t in K.texts(batch.column("text"), _SLICE):
            held.append(tokens(t))
            n += len(held[-1][0])
            if n >= FLUSH:
                yield held
                held, n = [], 0
    if held:
        yield held


def _count_words(ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _slices(batches):
            keys, n = np.unique(np.concatenate([w for w, _ in held]), return_counts=True)
            yield from _by_range("words", range_of(keys, ranges), ranges, keys, n.astype(U))

    return run


def _hash(columns: list[np.ndarray], seed: int) -> np.ndarray:
    return K.mix(K.combine(columns) ^ U(K.mix_int(seed)))


def homes(columns: list[np.ndarray], hot: list[np.ndarray], ranges: int) -> np.ndarray:
    """The range of each n-gram: by its middle words, its context, or all of it; the first of these that is not all hot."""
    *context, _ = columns
    out = range_of(_hash(columns, 3), ranges)
    cold = ~np.logical_and.reduce(hot[:-1])
    out[cold] = range_of(_hash([c[cold] for c in context], 2), ranges)
    if len(context) > 1:
        cold = ~np.logical_and.reduce(hot[1:-1])
        out[cold] = range_of(_hash([c[cold] for c in context[1:]], 2), ranges)
    return out


def _is_hot(ids: np.ndarray, hot: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(hot, ids), len(hot) - 1)
    return hot[at] == ids


def _turned(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Columns in the order middle words, first word, last word: in this order, runs compress best."""
    return [*columns[1:-1], columns[0], columns[-1]] if len(columns) > 1 else columns


def _sent(k: int, turned: list[np.ndarray], n: np.ndarray, hot: np.ndarray, ranges: int) -> Iterator[pa.RecordBatch]:
    """Runs of sorted distinct k-grams."""
    if k == 1:
        r = range_of(_hash(turned, 1), ranges)
    else:
        straight = [turned[-2], *turned[:-2], turned[-1]]
        r = homes(straight, [_is_hot(c, hot) for c in straight], ranges)
    yield from _by_range(f"grams{k}", r, ranges, *turned, n.astype(U))


def _count_grams(model: dict):
    k, ranges, hot = model["order"], model["ranges"], model["hot"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _tables(model["path"], _Holder(model))
        for held in _slices(batches):
            bounds = np.concatenate(([0], np.cumsum([len(w) for w, _ in held])))
            at = np.concatenate([a[:-1] + b for (_, a), b in zip(held, bounds, strict=False)] + [bounds[-1:]])
            unique, inverse = np.unique(np.concatenate([w for w, _ in held]), return_inverse=True)
            held.clear()
            ids = tables.find("words", unique)[1]
            order = np.argsort(ids, kind="stable")  # numbers in this slice, in the order of ids, after START's
            place = np.empty(len(ids), np.uint32)
            place[order] = np.arange(1, len(ids) + 1, dtype=np.uint32)
            ids = np.concatenate((np.array([_START], U), ids[order]))
            columns = [place[inverse]]
            del inverse, unique
            for _ in range(k - 1):
                columns.insert(0, before(columns[0], at, 0))
            columns, n = occurring(_turned(columns))
            columns = [ids[c] for c in columns]
            yield from _sent(k, columns, n, hot, ranges)

    return run


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list]]:
    """(range, rows of kind, run, values) of rows sorted by range; one range is held at a time."""
    now, rows = None, []
    for batch in batches:
        for r, *row in zip(*(batch.column(n) for n in ("range", "kind", "run", "values")), strict=True):
            r = r.as_py()
            if r != now and rows:
                yield now, rows
                rows = []
            now = r
            rows.append([x.as_py() for x in row])
    if rows:
        yield now, rows


def _columns_of(rows: list, kind: str) -> list[np.ndarray] | None:
    parts = [_unpack(run) for k, run, _ in rows if k == kind]
    return [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else None


def _of_counts(n: np.ndarray) -> list[int]:
    return [len(n), *(int((n == k).sum()) for k in (1, 2, 3, 4)), int((n > 2).sum())]


def _merge_words(path: str, ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, rows in _grouped(batches):
            (keys,), n = counted([(got := _columns_of(rows, "words"))[0]], got[1])
            order = np.argsort(-n, kind="stable")
            ids = np.empty(len(n), U)
            ids[order] = np.arange(len(n), dtype=U) * U(ranges) + U(r + 1)  # small for frequent words, and of this range alone
            save_table(path, "words", r, keys, n, ids.astype(np.int64))
            top = np.sort(order[: 16 * HOT_PER_RANGE])
            yield _meta([(r, "words", None, [len(keys), int(n.sum())]), (r, "top", _pack(np.sort(ids[top]), n[top][np.argsort(ids[top])].astype(U)), None)])

    return run


def _sums(n: np.ndarray, start: np.ndarray) -> list[np.ndarray]:
    """By run: the total, and how many counts are 1, 2, and more."""
    if not len(start):
        return [np.zeros(0, np.int64)] * 4
    return [np.add.reduceat(x, start) for x in (n, (n == 1).astype(np.int64), (n == 2).astype(np.int64), (n > 2).astype(np.int64))]


def _merge_stats(path: str, k: int, r: int, rows: list) -> Iterator[pa.RecordBatch]:
    """The sums of contexts of k-grams that lay in several ranges."""
    got = _columns_of(rows, f"stats{k}")
    if got:
        order = np.argsort(got[0], kind="stable")
        first = _runs(got[0][order])
        save_table(path, f"stats{k}", r, got[0][order][first], *(np.add.reduceat(x[order].astype(np.int64), first) for x in got[1:]))
        yield _meta([(r, f"stats{k}", None, [len(first)])])


def _merge(k: int, model: dict):
    """Merge and write a range's k-grams, and send on what the order below counts."""
    path, ranges, hot = model["path"], model["ranges"], model["hot"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, rows in _grouped(batches):
            yield from (_meta([(r, *row)]) for row in rows if row[1] is None)  # told before
            yield from _merge_stats(path, k + 1, r, rows)
            got = _columns_of(rows, f"grams{k}")
            rows.clear()
            if got is None:
                continue
            turned, n = counted(got[:-1], got[-1])
            del got
            yield _meta([(r, f"grams{k}", None, _of_counts(n))])
            if k == 1:
                order = np.argsort(turned[0])
                save_table(path, "left", r, turned[0][order], n[order])
                continue
            columns = [turned[-2], *turned[:-2], turned[-1]]
            del turned
            context = _hash(columns[:-1], 4)
            spread = np.logical_and.reduce([_is_hot(c, hot) for c in columns[:-1]])
            if spread.any():
                order = np.argsort(context[spread], kind="stable")
                keys = context[spread][order]
                first = _runs(keys)
                sums = _sums(n[spread][order], first)
                yield from _by_range(f"stats{k}", range_of(keys[first], ranges), ranges, keys[first], *(x.astype(U) for x in sums))
            save_grams(path, k, r, context, columns[-1], n)
            # An n-gram that begins a text is counted by its occurrences, as START alone stands before it.
            opens = (columns[0] == _START) & (columns[1] == _START) if k > 2 else np.zeros(len(n), bool)
            turned, n = counted(_turned(columns[1:]), np.where(opens, n, 1))
            yield from _sent(k - 1, turned, n, hot, ranges)

    return run


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Discounts for counts 1, 2 and more from the numbers of n-grams that occur 1, 2, 3 and 4 times."""
    n1, n2, n3, n4 = (float(x) for x in n)
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
    d1 = 1 - 2 * y * n2 / n1 if n1 else 0.5
    d2 = 2 - 3 * y * n3 / n2 if n2 else 2 * d1
    d3 = 3 - 4 * y * n4 / n3 if n3 else max(d2, d1)
    return min(max(d1, 0.05), 1.0), min(max(d2, 0.05), 2.0), min(max(d3, 0.05), 3.0)


def _deal(rows: DataFrame, ranges: int) -> DataFrame:
    """Rows in the partition of their range's own number, so that partitions are even."""
    return rows.repartitionById(ranges, "range").sortWithinPartitions("range")


def fit(texts: DataFrame, ranges: int | None = None, order: int = ORDER) -> dict:
    """Count the texts and write the model's tables; what score() needs to know of them."""
    if order < 2:
        raise ValueError(f"order is {order}")
    spark = texts.sparkSession
    path = new_path(spark, "lm")
    texts = texts.select("text")
    ranges = ranges or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * texts.rdd.getNumPartitions())
    words = _deal(texts.mapInArrow(_count_words(ranges), _META), ranges).mapInArrow(_merge_words(path, ranges), _META)
    words = store(words, "lm-words").collect()  # two rows a range
    sizes = [x for x in words if x["kind"] == "words"]
    vocabulary, total = (sum(x["values"][i] for x in sizes) for i in range(2))
    model = {"path": path, "ranges": ranges, "order": order, "words": total, "vocabulary": vocabulary, "tables": {"words": sorted(x["range"] for x in sizes)}, "hot": np.array([_START], U)}
    if not total:
        return model | {"discounts": {}}
    ids, n = (np.concatenate(c) for c in zip(*(_unpack(x["run"]) for x in words if x["kind"] == "top"), strict=True))
    model["hot"] = np.sort(np.append(ids[n >= max(total / (HOT_PER_RANGE * ranges), 1000)], U(_START)))  # at most HOT_PER_RANGE a range, and START
    rows = texts.mapInArrow(_count_grams(model), _META)
    for k in range(order, 0, -1):
        rows = _deal(rows, ranges).mapInArrow(_merge(k, model), _META)
    told = store(rows, "lm-grams").collect()  # a few rows a range and order
    sums = {k: np.sum([x["values"] for x in told if x["kind"] == f"grams{k}"], axis=0) for k in range(1, order + 1)}
    for kind in {x["kind"] for x in told}:
        model["tables"][kind] = sorted(x["range"] for x in told if x["kind"] == kind)
    model["tables"]["left"] = model["tables"]["grams1"]
    model["discounts"] = {k: discounts(s[1:5].tolist()) for k, s in sums.items()}
    d, s = model["discounts"][1], sums[1]
    kinds = int(sums[2][0])  # distinct pairs: what the words' counts add up to
    return model | {"pairs": kinds, "low_rest": float((d[0] * s[1] + d[1] * s[2] + d[2] * s[5]) / kinds)}


# --- files -------------------------------------------------------------------------------------------------------


def _name(path: str, table: str, r: int) -> str:
    return f"{path}/{table}-{r:06d}.bin"


def _save(path: str, table: str, r: int, arrays: list[np.ndarray]) -> None:
    """Arrays one after the other, behind their number and lengths; each begins at a multiple of 8 bytes."""
    head = np.array([len(arrays), *(len(a) for a in arrays), *(a.dtype.itemsize for a in arrays)], "<u8").tobytes()
    write_file(_name(path, table, r), b"".join([head, *(x for a in arrays for x in (a.tobytes(), b"\0" * (-a.nbytes % 8)))]))


def _load(file: str) -> list[np.ndarray]:
    whole = np.memmap(file, np.uint8, "r")
    k = int(whole[:8].view(U)[0])
    told = whole[8 : 8 + 16 * k].view(U).astype(int).tolist()
    at, out = 8 + 16 * k, []
    for n, width in zip(told[:k], told[k:], strict=True):
        out.append(whole[at : at + n * width].view(f"<u{width}"))
        at += n * width + (-n * width % 8)
    return out


def save_table(path: str, table: str, r: int, keys: np.ndarray, *columns: np.ndarray) -> None:
    """Sorted keys and aligned columns."""
    _save(path, table, r, [keys, *columns])


def _split(context: np.ndarray, last: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, key) of n-grams by the hashes of their contexts and their last words' ids."""
    bucket = (context >> U(64 - bits)).astype(np.int64) if bits else np.zeros(len(context), np.int64)
    return bucket, (context << U(32)) | (last & U(2**32 - 1))


def save_grams(path: str, k: int, r: int, context: np.ndarray, last: np.ndarray, n: np.ndarray) -> None:
    """A hash array: where buckets begin, keys, counts (255: see the list), that list, and the sums of wide contexts."""
    bits = max(0, (len(n) // 16).bit_length() - 1)
    bucket, key = _split(context, last, bits)
    order = np.lexsort((key, bucket))
    bucket, key, n = bucket[order], key[order], n[order]
    first = _runs(bucket << 32 | (key >> U(32)).astype(np.int64))
    size = np.diff(np.append(first, len(n)))
    wide = size > WIDE
    sums = [x[wide].astype(U) for x in _sums(n, first)]
    many = np.flatnonzero(n >= 255)
    edges = np.searchsorted(bucket, np.arange((1 << bits) + 1))
    _save(path, f"grams{k}", r, [edges.astype(np.uint32 if len(n) < 2**32 else U), key, np.minimum(n, 255).astype(np.uint8), many.astype(U), n[many].astype(U), first[wide].astype(U), *sums])


def bisect(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The first place in [lo, hi) whose key is x or more, for each x."""
    lo, hi = lo.copy(), hi.copy()
    live = np.flatnonzero(lo < hi)
    while len(live):
        mid = (lo[live] + hi[live]) >> 1
        less = keys[mid] < x[live]
        lo[live[less]] = mid[less] + 1
        hi[live[~less]] = mid[~less]
        live = live[lo[live] < hi[live]]
    return lo


class Grams:
    """One range of one order, in memory-mapped arrays."""

    def __init__(self, arrays: list[np.ndarray]):
        self.edges, self.keys, self.small, self.many, self.large, self.wide, *self.sums = arrays
        self.bits = (len(self.edges) - 1).bit_length() - 1

    def counts(self, at: np.ndarray) -> np.ndarray:
        n = self.small[at].astype(np.int64)
        big = np.flatnonzero(n == 255)
        n[big] = self.large[np.searchsorted(self.many, at[big].astype(U))]
        return n

    def contexts(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the entries of each context begin and end."""
        bucket, low = _split(context, np.zeros(1, U), self.bits)
        a, b = self.edges[bucket].astype(np.int64), self.edges[bucket + 1].astype(np.int64)
        lo = bisect(self.keys, a, b, low)
        return lo, bisect(self.keys, lo, b, low | U(2**32 - 1))  # no word has the last id

    def sums_of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Rows: total, and how many counts are 1, 2, and more."""
        out = np.zeros((4, len(lo)))
        size = hi - lo
        wide = np.flatnonzero(size > WIDE)
        at = np.searchsorted(self.wide, lo[wide].astype(U))
        for k in range(4):
            out[k, wide] = self.sums[k][at]
        live = np.flatnonzero((size > 0) & (size <= WIDE))
        step = 0
        while len(live):
            n = self.counts(lo[live] + step)
            out[0, live] += n
            out[np.minimum(n, 3), live] += 1
            step += 1
            live = live[lo[live] + step < hi[live]]
        return out

    def find(self, lo: np.ndarray, hi: np.ndarray, context: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The counts of n-grams whose contexts' entries are given."""
        x = _split(context, last, 0)[1]
        at = bisect(self.keys, lo, hi, x)
        out = np.zeros(len(x), np.int64)
        hit = np.flatnonzero(at < hi)
        hit = hit[self.keys[at[hit]] == x[hit]]
        out[hit] = self.counts(at[hit])
        return out


# --- scoring -----------------------------------------------------------------------------------------------------


class Tables:
    """The model's files, mapped into memory as they are asked for; the least used are unmapped beyond MAPS."""

    def __init__(self, model: dict, maps: int = MAPS):
        self.model, self.open, self.maps = model, OrderedDict(), maps
        self.there = {k: set(v) for k, v in model["tables"].items()}
        self.local = local_path(model["path"])

    def _file(self, table: str, r: int) -> str:
        if self.local is not None:
            return _name(self.local, table, r)
        # A store that cannot be mapped: one copy an executor, in the folder that Spark gives it and removes with it.
        fs, path = open_fs(_name(self.model["path"], table, r))
        to = os.path.join(SparkFiles.getRootDirectory(), os.path.basename(os.path.dirname(path)), os.path.basename(path))
        if not os.path.exists(to):
            os.makedirs(os.path.dirname(to), exist_ok=True)
            part = f"{to}.{os.getpid()}"
            with fs.open_input_stream(path) as source, open(part, "wb") as out:
                shutil.copyfileobj(source, out, 1 << 20)
            os.replace(part, to)
        return to

    def part(self, table: str, r: int):
        """The arrays of one file (grams: as Grams), or None where there is none."""
        if r not in self.there.get(table, ()):
            return None
        if (table, r) not in self.open:
            arrays = _load(self._file(table, r))
            self.open[table, r] = Grams(arrays) if table.startswith("grams") else arrays
            if len(self.open) > self.maps:
                self.open.popitem(last=False)
        self.open.move_to_end((table, r))
        return self.open[table, r]

    def _ranges(self, r: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        order = np.argsort(r, kind="stable")
        edges = np.append(_runs(r[order]), len(r))
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            yield int(r[order[lo]]), order[lo:hi]

    def find(self, table: str, keys: np.ndarray, r: np.ndarray | None = None, columns: int = 2) -> np.ndarray:
        """The table's columns for keys, 0 where a key is missing."""
        out = np.zeros((columns, len(keys)), U)
        for i, mine in self._ranges(range_of(keys, self.model["ranges"]) if r is None else r):
            part = self.part(table, i)
            if part is None or not len(part[0]):
                continue
            at = np.minimum(np.searchsorted(part[0], keys[mine]), len(part[0]) - 1)
            hit = part[0][at] == keys[mine]
            for o, column in zip(out, part[1:], strict=False):
                o[mine[hit]] = column[at[hit]]
        return out

    def grams(self, k: int, contexts: list[np.ndarray], of: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(counts of k-grams, sums of their contexts). contexts: distinct, as columns of ids; gram i is contexts[of[i]] with last[i]."""
        m = self.model
        hash_ = _hash(contexts, 4)
        hot = [_is_hot(c, m["hot"]) for c in contexts]
        spread = np.logical_and.reduce(hot)
        sums = np.zeros((4, len(hash_)))
        at = np.flatnonzero(spread)
        sums[:, at] = self.find(f"stats{k}", hash_[at], columns=4)
        # Contexts that are not spread have one range; their entries are found once, and those of spread ones by gram.
        columns = [*(c[of] for c in contexts), last]
        r = homes(columns, [*(h[of] for h in hot), np.zeros(len(last), bool)], m["ranges"])
        n = np.zeros(len(last), np.int64)
        for i, mine in self._ranges(r):
            part = self.part(f"grams{k}", i)
            if part is None:
                continue
            own, inverse = np.unique(of[mine], return_inverse=True)
            lo, hi = part.contexts(hash_[own])
            n[mine] = part.find(lo[inverse], hi[inverse], hash_[of[mine]], last[mine])
            whole = ~spread[own]
            sums[:, own[whole]] = part.sums_of(lo[whole], hi[whole])
        return n, sums


@lru_cache(maxsize=2)
def _tables(path: str, holder) -> Tables:
    return Tables(holder.model)


class _Holder:
    """Equal if of the same path and order of work, so that a worker opens a model once."""

    def __init__(self, model: dict):
        self.model = model

    def __hash__(self):
        return hash((self.model["path"], "discounts" in self.model))

    def __eq__(self, other):
        return hash(self) == hash(other)


def _discount(n: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(n, 3)]


def score_texts(tables: Tables, t: K.Texts) -> dict[str, np.ndarray]:
    """n_tokens, n_known, base_score, score of each text."""
    m = tables.model
    words, at = tokens(t)
    unique, inverse = np.unique(words, return_inverse=True)
    raw, ids = tables.find("words", unique)
    raw = raw.astype(np.int64)
    size = m["vocabulary"] + 1
    base = np.log10((raw + 1) / (m["words"] + size))
    if m["discounts"]:
        left = tables.find("left", ids, range_of(_hash([ids], 1), m["ranges"]), 1)[0].astype(np.int64)
        left[raw == 0] = 0
        ids = np.where(raw > 0, ids, _NONE)
        p = (np.maximum(left - _discount(left, m["discounts"][1]), 0) / m["pairs"] + m["low_rest"] / size)[inverse]
        grams, gram_of = [ids], inverse  # the distinct n-grams so far, as columns, and that which ends at each place
        for k in range(2, m["order"] + 1):
            contexts = [np.append(c, U(_START)) for c in grams]
            context_of = before(gram_of, at, len(grams[0]))
            pairs, gram_of = np.unique(context_of * len(unique) + inverse, return_inverse=True)
            of, last = pairs // len(unique), ids[pairs % len(unique)]
            n, sums = tables.grams(k, contexts, of, last)
            total = np.maximum(sums[0], 1)
            rest = np.where(sums[0] > 0, np.array(m["discounts"][k]) @ sums[1:] / total, 1.0)
            own = np.maximum(n - _discount(n, m["discounts"][k]), 0) / total[of]
            p = own[gram_of] + rest[context_of] * p
            grams = [*(c[of] for c in contexts), last]
        score = np.log10(p)
    else:
        score = np.full(len(words), -np.log10(size))
    add = lambda x: np.add.reduceat(x, at[:-1]) if len(t) else np.zeros(0)
    return {"n_tokens": np.diff(at), "n_known": add((raw > 0).astype(np.int64)[inverse]), "base_score": add(base[inverse]), "score": add(score)}


def _scorer(model: dict):
    holder = _Holder(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _tables(model["path"], holder)
        for batch in batches:
            for t in K.texts(batch.column("text"), _SLICE):
                found = score_texts(tables, t)
                rows = batch.slice(t.first, len(t))
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), rows.column("held_out"), pa.array(found["n_tokens"]), pa.array(found["n_known"]), pa.array(np.full(len(t), model["words"])), pa.array(found["base_score"]), pa.array(found["score"]), pa.array(10 ** (-found["score"] / found["n_tokens"]))],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"],
                )

    return run


def held_out(doc_id: Column, folds: int = 7, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % folds == fold, F.lit(False))


def score(docs: DataFrame, held: Column | None = None, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of every row of docs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (held_out(F.col("doc_id")) if held is None else held).alias("held_out"))
    model = fit(rows.filter("not held_out"), order=order)
    return rows.mapInArrow(_scorer(model), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
