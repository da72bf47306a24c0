"""Packing token sequences into windows by non-negative least squares on their length histogram.

Texts become token ids once; each document is cut into whole windows and a tail, and each piece knows its checksum.
Only the histogram of piece lengths (at most ``window`` numbers) decides the plan: shallow combinations of up to three
lengths that fill a window are enumerated, non-negative least squares finds how often to repeat each, the counts are
rounded (down, then up in the order of what that lost, while pieces last), and the residual histogram is packed
greedily, longest first. A greedy window that would be left with a
gap of over ``GAP`` tokens takes the head of a further piece, whose rest goes back to the histogram; only documents
cut so need their ids again, which are kept with the tails. The plan is a list of (pattern, repeats) whose length does
not depend on the number of documents. Pieces are numbered inside their length in two steps (by salt, then by sums
over salts), with as many salts as the session has shuffle partitions, so a length that a third of all documents share
is never in one task.

Defined cases: a null text is empty and has only the end token; a document without text is one piece of length 1;
repeated rows and rows that share a doc_id are documents of their own; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm import textkernel as K
from tessera.llm.shared import lean, store

WINDOW = 1024
GAP = 12
END = 0
TOKENIZER = "byte_bpe_50k.tiktoken"
_CACHE = 400_000


# --- tokens -----------------------------------------------------------------------------------------------------


@lru_cache(maxsize=1)
def tokenizer(path: str):
    """(encoding, bytes of each id). The vocabulary is that of the tokenizers library's file of the same name; both give the same ids."""
    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    size[list(ranks.values())] = [len(k) for k in ranks]
    return tiktoken.Encoding("pack", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), size


def _default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


# Last bytes of white space beyond ASCII, which the tokenizer's pattern may join to a blank that follows.
_WIDE = np.zeros(256, bool)
_WIDE[[0xE1, 0xE2, 0xE3]] = True


def chunks(t: K.Texts) -> tuple[np.ndarray, np.ndarray]:
    """(starts, bounds by text) of pieces that are tokenized independently.

    The tokenizer's pattern never joins anything to white space that follows it, except other white space; so a text may be cut
    before any ASCII white space whose preceding character is none. Where that character could be wide white space, it is not cut.
    """
    b = t.buf
    n = len(b)
    cut = np.zeros(n, bool)
    if n:
        space = K.IS_SPACE[b]
        cut[1:] = space[1:] & ~space[:-1] & ~((b[:-1] >= 0x1C) & (b[:-1] <= 0x1F))
        high = np.flatnonzero(cut[1:] & (b[:-1] >= 0x80)) + 1
        if len(high):
            two = b[np.maximum(high - 2, 0)]
            three = b[np.maximum(high - 3, 0)]
            bad = ((two == 0xC2) & ((b[high - 1] == 0x85) | (b[high - 1] == 0xA0))) | _WIDE[three]
            cut[high[bad]] = False
        cut[t.offsets[:-1][np.diff(t.offsets) > 0]] = True
    starts = np.flatnonzero(cut)
    return starts, np.searchsorted(starts, t.offsets)


class Tokens:
    """Token ids of whole texts; chunks seen before come from a bounded cache."""

    def __init__(self, path: str):
        self.encoding, self.size = tokenizer(path)
        self.place: dict[int, int] = {}  # chunk's hash -> index among the cached chunks
        self.ids = np.zeros(1 << 16, np.uint16)
        self.ends = np.zeros(1 << 16, np.int64)
        self.texts = np.zeros(1 << 16, np.uint8)  # the chunks themselves, so that a hash is never taken at its word
        self.text_ends = np.zeros(1 << 16, np.int64)
        self.used = self.n = 0

    def _add(self, ids: np.ndarray, ends: np.ndarray, raw: np.ndarray, sizes: np.ndarray) -> range:
        """Keep chunks; their indices."""
        grown = lambda a, n: a if n <= len(a) else np.concatenate((a, np.zeros(max(len(a), n - len(a)), a.dtype)))
        k, n, end, reach = self.n, len(ends), self.used + len(ids), int(self.text_ends[self.n]) + len(raw)
        self.ids, self.ends = grown(self.ids, end), grown(self.ends, k + n + 1)
        self.texts, self.text_ends = grown(self.texts, reach), grown(self.text_ends, k + n + 1)
        self.ids[self.used : end] = ids
        self.ends[k + 1 : k + 1 + n] = self.used + ends
        self.texts[reach - len(raw) : reach] = raw
        self.text_ends[k + 1 : k + 1 + n] = reach - len(raw) + np.cumsum(sizes)
        self.used, self.n = end, k + n
        return range(k, k + n)

    def _learn(self, hashes: np.ndarray, t: K.Texts, starts: np.ndarray, ends: np.ndarray) -> None:
        """Tokenize new chunks: all those that begin with white space and end without it in one call, as no token spans two of them."""
        b = t.buf
        safe = K.IS_SPACE[b[starts]] & ~K.IS_SPACE[b[ends - 1]] & ((b[ends - 1] < 0x1C) | (b[ends - 1] > 0x1F))
        two, three = b[np.maximum(ends - 2, 0)], b[np.maximum(ends - 3, 0)]
        safe &= ~((b[ends - 1] >= 0x80) & (((two == 0xC2) & ((b[ends - 1] == 0x85) | (b[ends - 1] == 0xA0))) | _WIDE[three]))
        s, e = starts[safe], ends[safe]
        if len(s):
            size = e - s
            at = np.concatenate(([0], np.cumsum(size)))
            joined = b[np.repeat(s - at[:-1], size) + np.arange(at[-1])]
            ids = np.array(self.encoding.encode_ordinary(joined.tobytes().decode()), np.uint16)
            reach = np.cumsum(self.size[ids])
            last = np.searchsorted(reach, at[1:])
            if not np.array_equal(reach[last], at[1:]):
                raise ValueError("a token spans two chunks")
            self.place.update(zip(hashes[safe].tolist(), self._add(ids, last + 1, joined, size), strict=True))
        for h, x, y in zip(hashes[~safe].tolist(), starts[~safe].tolist(), ends[~safe].tolist(), strict=True):
            self.place[h] = self._one(b[x:y])

    def _one(self, raw: np.ndarray) -> int:
        ids = np.array(self.encoding.encode_ordinary(raw.tobytes().decode()), np.uint16)
        return self._add(ids, np.array([len(ids)]), raw, np.array([len(raw)]))[0]

    def _compared(self, at: np.ndarray, t: K.Texts, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """at, with chunks of their own for those whose bytes are not the kept ones."""
        size = self.text_ends[at + 1] - self.text_ends[at]
        wrong = size != ends - starts
        if not wrong.any():
            same = self.texts[np.repeat(self.text_ends[at] - starts, size) + np.arange(len(t.buf))] == t.buf  # chunks cover the buffer
            if same.all():
                return at
            wrong = ~np.logical_and.reduceat(same, starts)
        else:
            wrong |= np.array([not np.array_equal(self.texts[self.text_ends[k] : self.text_ends[k + 1]], t.buf[x:y]) for k, x, y in zip(at.tolist(), starts.tolist(), ends.tolist(), strict=True)])
        at = at.copy()
        for i in np.flatnonzero(wrong).tolist():
            at[i] = self._one(t.buf[starts[i] : ends[i]])
        return at

    def __call__(self, t: K.Texts) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts with END after each, bounds by text)."""
        starts, bounds = chunks(t)
        ends = np.append(starts[1:], len(t.buf))[: len(starts)]
        unique, first, inverse = np.unique(K.Rolling(t.buf)(starts, ends), return_index=True, return_inverse=True)
        if self.n > _CACHE:
            self.place.clear()
            self.used = self.n = 0
        keys = unique.tolist()
        new = [i for i, k in enumerate(keys) if k not in self.place]
        if new:
            self._learn(unique[new], t, starts[first[new]], ends[first[new]])
        at = np.fromiter(map(self.place.__getitem__, keys), np.int64, len(keys))[inverse]
        if len(at):
            at = self._compared(at, t, starts, ends)
        lengths = (self.ends[at + 1] - self.ends[at]) if len(at) else np.zeros(0, np.int64)
        token_at = np.concatenate(([0], np.cumsum(lengths)))
        total = token_at[bounds] + np.arange(len(bounds))  # an END after each text
        out = np.full(total[-1], END, np.uint16)
        if len(at):
            owner = K.owners(bounds)
            shift = np.repeat(self.ends[at] - token_at[:-1], lengths)
            source = np.arange(token_at[-1])
            out[source + np.repeat(owner, lengths)] = self.ids[source + shift]
        return out, total


def checksum(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])


def _cutter(path: str, window: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(path)
        for batch in batches:
            doc_ids = batch.column("doc_id")
            for t in K.texts(batch.column("text")):
                ids, at = tokens(t)
                n = np.diff(at)
                pieces = -(-n // window)
                doc = np.repeat(np.arange(len(t)), pieces)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * window
                length = np.minimum(window, n[doc] - start)
                wide = memoryview(ids.astype("<u4")).cast("B")
                low = (at[doc] + start).tolist()
                size = length.tolist()
                crc = [zlib.crc32(wide[4 * a : 4 * (a + b)]) for a, b in zip(low, size, strict=True)]
                kept = [ids[a : a + b].tobytes() if b < window else None for a, b in zip(low, size, strict=True)]
                yield pa.RecordBatch.from_arrays([doc_ids.take(pa.array(doc + t.first)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(n[doc]), pa.array(kept, pa.binary())], schema=_PIECES)

    return cut


# --- plan -------------------------------------------------------------------------------------------------------


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """Every multiset of at most three of the given lengths (ascending) that fills the window: rows, 0 for no length."""
    have = np.zeros(window + 1, bool)
    have[lengths] = True
    one = np.array([[window, 0, 0]]) if have[window] else np.zeros((0, 3), int)
    a = lengths[lengths < window]
    pair = a[(2 * a <= window) & have[window - a]]
    two = np.stack([window - pair, pair, np.zeros_like(pair)], 1)
    x, y = np.meshgrid(a, a, indexing="ij")
    z = window - x - y
    ok = (x <= y) & (z >= y) & (z > 0)
    ok[ok] = have[z[ok]]
    three = np.stack([z[ok], y[ok], x[ok]], 1)
    return np.concatenate((one, two, three)).astype(np.int64)


def solve(combos: np.ndarray, histogram: np.ndarray, steps: int = 300) -> np.ndarray:
    """Repeats x >= 0 of the combinations that minimise the weighted squares of (pieces used - histogram).

    Accelerated projected gradient over the sparse incidence; errors at long lengths count more, as those are hard to
    place later. Steps are scaled by each combination's own curvature.
    """
    if not len(combos):
        return np.zeros(0)
    window = len(histogram) - 1
    weight = np.maximum(np.arange(window + 1), window / 8) / window
    weight[0] = 0
    b = histogram.astype(np.float64)
    top = max(b.max(), 1.0)
    b = b / top
    degree = np.maximum(np.bincount(combos.ravel(), minlength=window + 1).astype(float), 1)
    # A diagonal bound on the Gram matrix: sum over a combination's lengths of weight * entries in that row.
    bound = 3.0 * (weight * degree)[combos].sum(1)
    x = np.zeros(len(combos))
    y, t = x.copy(), 1.0
    for _ in range(steps):
        used = np.bincount(combos.ravel(), np.repeat(y, combos.shape[1]), window + 1)
        gradient = (weight * (used - b))[combos].sum(1)
        nxt = np.maximum(y - gradient / bound, 0)
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = nxt + (t - 1) / t2 * (nxt - x)
        x, t = nxt, t2
    return x * top


def rounded(combos: np.ndarray, histogram: np.ndarray) -> tuple[list[list[int]], np.ndarray]:
    """(lengths of each combination, whole repeats): the solution rounded down, then up in the order of what that lost.

    Rounding never uses more pieces than there are.
    """
    wanted = solve(combos, histogram) + 1e-6
    repeats = np.floor(wanted).astype(np.int64)
    spare, rows = histogram.copy(), [[int(l) for l in c if l] for c in combos]  # noqa: E741
    room = lambda c: min(int(spare[l]) // c.count(l) for l in c)  # noqa: E731, E741

    def use(i: int, n: int) -> None:
        repeats[i] = n
        for l in rows[i]:  # noqa: E741
            spare[l] -= n

    for i in np.argsort(-repeats, kind="stable").tolist():
        use(i, min(int(repeats[i]), room(rows[i])))
    lost = wanted - np.floor(wanted)
    for i in np.argsort(-lost, kind="stable").tolist():
        if lost[i] > 1e-3 and room(rows[i]):
            n = int(repeats[i])
            use(i, 1)
            repeats[i] = n + 1
    return rows, repeats


def plan(histogram: np.ndarray, gap: int = GAP) -> tuple[np.ndarray, np.ndarray]:
    """How every piece is placed.

    histogram[l]: number of pieces of length l. Returns (places, cuts). A row (length, from, to, sequence, offset) of places
    puts the pieces of this length whose number n is in [from, to) into sequence + n - from, at the offset. A row
    (length, from, to, sequence, offset, size, next) of cuts does so with the first ``size`` ids, and the rest is then the
    piece with number next + n - from of length (length - size). Numbers of each length: given pieces first, then rests.
    """
    window = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    given = np.zeros(window + 1, np.int64)  # numbers already placed, by length
    top = left.copy()  # numbers that exist, by length
    places, cuts, sequence = [], [], 0

    def put(lengths: list[int], repeats: int) -> int:
        nonlocal sequence
        at, first = 0, sequence
        for l in lengths:  # noqa: E741
            places.append((l, given[l], given[l] + repeats, first, at))
            given[l] += repeats
            left[l] -= repeats
            at += l
        sequence += repeats
        return at

    combos = combinations(np.flatnonzero(left), window)
    rows, repeats = rounded(combos, left)
    for i in np.argsort(-repeats, kind="stable").tolist():
        if repeats[i]:
            put(rows[i], int(repeats[i]))
    while left.any():
        room, taken = window, []
        spare = left.copy()
        while room:
            fits = np.flatnonzero(spare[: room + 1])
            if not len(fits):
                break
            l = int(fits[-1])  # noqa: E741
            k = min(room // l, int(spare[l]))
            taken += [l] * k
            spare[l] -= k
            room -= k * l
        repeats = min(int(left[l]) // taken.count(l) for l in set(taken))
        longer = np.flatnonzero(spare[room + 1 :]) + room + 1
        donor = int(longer[0]) if room > gap and len(longer) else 0
        if donor:
            # The donor may be among the lengths taken: leave it enough pieces for the repeats.
            repeats = min(repeats, int(left[donor]) // (taken.count(donor) + 1)) or 1
        first = sequence
        at = put(taken, repeats)
        n = min(repeats, int(left[donor])) if donor else 0
        if n:
            rest = donor - room
            cuts.append((donor, given[donor], given[donor] + n, first, at, room, top[rest]))
            given[donor] += n
            left[donor] -= n
            left[rest] += n
            top[rest] += n
    return np.array(places, np.int64).reshape(-1, 5), np.array(cuts, np.int64).reshape(-1, 7)


class Placer:
    """Finds the places of numbered pieces in a plan."""

    def __init__(self, places: np.ndarray, cuts: np.ndarray):
        rows = np.concatenate((np.concatenate((places, np.zeros((len(places), 2), np.int64)), 1), cuts)) if len(cuts) else np.concatenate((places, np.zeros((len(places), 2), np.int64)), 1)
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        self.rows = rows
        self.bounds = np.searchsorted(rows[:, 0], np.arange(rows[:, 0].max(initial=0) + 2))

    def __call__(self, length: np.ndarray, number: np.ndarray) -> np.ndarray:
        """The plan's row of each piece."""
        out = np.empty(len(length), np.int64)
        for l in np.unique(length):  # noqa: E741
            lo, hi = self.bounds[l], self.bounds[l + 1]
            mine = length == l
            out[mine] = lo + np.searchsorted(self.rows[lo:hi, 1], number[mine], "right") - 1
        return out


_PACKED = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def place_pieces(placer: Placer, batch: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
    """(placed pieces, rows that are cut, their rows in the plan)."""
    length, number = batch.column("length").to_numpy(), batch.column("number").to_numpy()
    row = placer(length, number)
    plan_rows = placer.rows[row]
    cut = plan_rows[:, 5] > 0
    keep = pa.array(~cut)
    out = pa.RecordBatch.from_arrays([*(batch.column(n).filter(keep) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")), pa.array((plan_rows[:, 3] + number - plan_rows[:, 1])[~cut]), pa.array(plan_rows[~cut, 4])], schema=_PACKED)
    return out, np.flatnonzero(cut), row


def _place_whole(placer):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield place_pieces(placer.value, batch)[0]

    return run


def _select_cut(placer):
    """The numbered pieces that the plan cuts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, cut, _ = place_pieces(placer.value, batch)
            yield pa.RecordBatch.from_arrays([batch.column("piece").take(pa.array(cut)), batch.column("number").take(pa.array(cut))], names=["piece", "number"])

    return run


def _place_cut(placer):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = placer.value.rows
        for batch in batches:
            out = []
            for p in batch.to_pylist():
                ids, start, number = np.frombuffer(p["ids"], np.uint16), p["start"], p["number"]
                while True:  # a rest may be cut again
                    at = int(placer.value(np.array([len(ids)]), np.array([number]))[0])
                    _, first, _, sequence, offset, size, nxt = rows[at].tolist()
                    head = ids[:size] if size else ids
                    out.append((p["doc_id"], start, len(head), checksum(head), p["doc_tokens"], sequence + number - first, offset))
                    if not size:
                        break
                    ids, start, number = ids[size:], start + size, nxt + number - first
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _PACKED, strict=True)], schema=_PACKED)

    return run


def pack(docs: DataFrame, window: int = WINDOW, path: str | None = None, gap: int = GAP) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    spark = docs.sparkSession
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(_cutter(path or _default_path(), window)), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary")
    pieces = store(cut.withColumn("piece", F.monotonically_increasing_id()), "pieces")  # numbers stay once written
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slim = pieces.drop("ids").withColumn("_salt", F.pmod(F.xxhash64("piece"), F.lit(salts)).cast("int"))
    counts = store(slim.groupBy("length", "_salt").agg(F.count("*").alias("n")), "lengths")
    histogram = np.zeros(window + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n")).collect():  # at most window rows
        histogram[length] = n
    if not histogram.any():
        return spark.createDataFrame([], PACKED)
    placer = spark.sparkContext.broadcast(Placer(*plan(histogram, gap)))  # patterns of the plan: bounded by the window
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "_salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("length", "_salt").orderBy("piece")
    numbered = slim.withColumn("_row", F.row_number().over(inside) - 1)
    # window * salts rows of three numbers; they are broadcast only where Spark's size check allows it.
    numbered = numbered.join(starts, ["length", "_salt"]).withColumn("number", F.col("_start") + F.col("_row"))
    numbered = store(numbered.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "piece", "number"), "numbered")
    whole = numbered.mapInArrow(lean(_place_whole(placer)), PACKED)
    if not (placer.value.rows[:, 5] > 0).any():
        return whole
    chosen = numbered.mapInArrow(lean(_select_cut(placer)), "piece long, number long")
    return whole.unionByName(pieces.join(chosen, "piece").select("doc_id", "start", "doc_tokens", "ids", "number").mapInArrow(lean(_place_cut(placer)), PACKED))
