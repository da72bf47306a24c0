"""Quality rules: fixed rules, and logistic regression over hashed word and character n-grams.

Features are shares: each hashed word, word pair, 3-byte and 4-byte n-gram counts by its part of the text's n-grams of
that kind. The weights are fitted to labelled rows (at most ``SAMPLE``, those of smallest hash among texts of at most
``TEXT_BYTES`` bytes, a documented bound in rows and bytes on what the classifier learns from alone), a tenth part each is held out in turn to calibrate the scores to probabilities
(Platt), and Arrow batches of whole texts are scored against the fixed ``THRESHOLD``.

Defined cases: a null text has no words and fails the rules; without labelled rows of both kinds no text is rejected
by the classifier; repeated rows are judged each; an empty table gives an empty result; good_rows() passes on further
columns untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textkernel as K
from tessera.session import lean

SAMPLE = 2500
THRESHOLD = 0.3  # of the probability that a text is bad
BITS = 17
LEAST_TEXTS = 4
TEXT_BYTES = 1 << 17
_FAMILIES = 4
_TRAIN_SLICE = 1 << 18
_SCALE = 30.0

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


@dataclass
class Measures:
    """Aligned arrays, one entry for each text."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which entries have a key that another entry has too."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    same = s[1:] == s[:-1]
    out = np.zeros(len(keys), bool)
    twice = np.zeros(len(keys), bool)
    twice[1:] |= same
    twice[:-1] |= same
    out[order] = twice
    return out


def _later(keys: np.ndarray) -> np.ndarray:
    """Which entries have a key that an earlier entry has."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    out = np.zeros(len(keys), bool)
    out[order[1:]] = s[1:] == s[:-1]
    return out


def _with_owner(h: np.ndarray, owner: np.ndarray) -> np.ndarray:
    return K.mix(h ^ K.mix(owner.astype(K.U) + K.U(0xABCDEF)))


def measures(t: K.Texts, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rolling: K.Rolling) -> Measures:
    """The base counts, over words as written."""
    heads = np.concatenate(([0], np.cumsum((t.buf & 0xC0) != 0x80)))  # code points before each byte
    chars = K.sum_by(heads[ends] - heads[starts], bounds)
    marks = np.concatenate(([0], np.cumsum(_SYMBOL[t.buf])))
    symbols = marks[t.offsets[1:]] - marks[t.offsets[:-1]]
    # Lines: pieces between line feeds, cut at the ends of texts as well.
    feed = np.flatnonzero(t.buf == 10)
    line_start = np.sort(np.concatenate((t.offsets[:-1], feed + 1)))
    line_owner = np.searchsorted(t.offsets, line_start, "right") - 1
    feed_owner = np.searchsorted(t.offsets, feed, "right") - 1
    order = np.lexsort((np.concatenate((t.offsets[:-1], feed + 1)), np.concatenate((np.arange(len(t)), feed_owner))))
    line_start = np.concatenate((t.offsets[:-1], feed + 1))[order]
    line_owner = np.concatenate((np.arange(len(t)), feed_owner))[order]
    last = np.ones(len(line_start), bool)
    last[:-1] = line_owner[1:] != line_owner[:-1]
    line_end = np.where(last, t.offsets[line_owner + 1], np.concatenate((line_start[1:] - 1, [0])))
    full = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    ls, le, lo = line_start[full], line_end[full], line_owner[full]
    again = _later(_with_owner(rolling(ls, le), lo))
    dup = np.bincount(lo[again], minlength=len(t))
    w, first, at = K.windows(rolling(starts, ends), bounds, 5)
    repeat = np.zeros(len(t), np.int64)
    if len(w):
        hit = first[_repeated(_with_owner(w, K.owners(at)))]
        cover = np.zeros(len(starts) + 1, np.int64)
        np.add.at(cover, hit, 1)
        np.add.at(cover, hit + 5, -1)
        repeat = K.sum_by((np.cumsum(cover)[:-1] > 0).astype(np.int64), bounds)
    return Measures(np.diff(bounds), chars, symbols, dup, repeat)


def base_failed(m: Measures) -> np.ndarray:
    return (m.n_words < 10) | (100 * m.n_repeat_words > 20 * m.n_words)


def _features(t: K.Texts) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each family: (bucket of every n-gram, bounds by text)."""
    low = K.Texts(t.first, K.lower(t.buf), t.offsets)
    starts, ends = K.spans(low)
    h = K.Rolling(low.buf)(starts, ends)
    bounds = K.split_docs(starts, t.offsets)
    pairs, _, at = K.windows(h, bounds, 2)
    top = K.U(64 - BITS)
    out = [((h >> top).astype(np.int32), bounds), ((pairs >> top).astype(np.int32), at)]
    b = t.buf.astype(np.uint32)
    three = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) if len(b) > 2 else np.zeros(0, np.uint32)
    four = (three[:-1] << 8 | b[3:]) if len(b) > 3 else np.zeros(0, np.uint32)
    for k, g in ((3, three), (4, four)):
        code = ((g * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int32)
        counts = np.maximum(np.diff(t.offsets) - k + 1, 0)
        at = np.concatenate(([0], np.cumsum(counts)))
        if at[-1] != len(code):  # n-grams across texts
            index = np.repeat(t.offsets[:-1] - at[:-1], counts) + np.arange(at[-1])
            code = code[index]
        out.append((code, at))
    return out


@dataclass
class Model:
    weights: np.ndarray  # families x buckets, float32
    bias: float
    slope: float
    shift: float

    def logits(self, t: K.Texts) -> np.ndarray:
        z = np.full(len(t), self.bias)
        for w, (code, at) in zip(self.weights, _features(t), strict=True):
            z += _SCALE * K.sum_by(w[code].astype(np.float64), at) / np.maximum(np.diff(at), 1)
        return z

    def bad(self, t: K.Texts) -> np.ndarray:
        """Calibrated probability that a text is bad."""
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(t) + self.shift, -50, 50)))


def _sparse(t: K.Texts) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, feature, value) of each family's features, each once a row."""
    for f, (code, at) in enumerate(_features(t)):
        key, n = np.unique(K.owners(at) * (1 << BITS) + code, return_counts=True)
        doc = key >> BITS
        yield (doc + t.first).astype(np.int32), ((key & ((1 << BITS) - 1)) + (f << BITS)).astype(np.int32), (_SCALE * n / np.diff(at)[doc]).astype(np.float32)


def _rows(array: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) of texts; features of under LEAST_TEXTS texts are left out, as they could only be learnt by heart.

    Features are counted in one pass and made again in a second, so that those left out are never held together.
    """
    seen = np.zeros(_FAMILIES << BITS, np.int32)
    for t in K.texts(array, _TRAIN_SLICE):
        for _, codes, _ in _sparse(t):
            np.add.at(seen, codes, 1)
    common = seen >= min(LEAST_TEXTS, len(array))
    n, at = int(seen[common].sum()), 0
    out = np.empty(n, np.int32), np.empty(n, np.int32), np.empty(n, np.float32)
    for t in K.texts(array, _TRAIN_SLICE):
        for part in _sparse(t):
            keep = common[part[1]]
            end = at + int(keep.sum())
            for whole, some in zip(out, part, strict=True):
                whole[at:end] = some[keep]
            at = end
    return out


def _fit(rows, codes, values, y, weight, steps: int = 60, l2: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the rows of positive weight.

    Each feature enters by its log ratio between the labels, so that those alike in both weigh little from the start.
    """
    inside = weight[rows] > 0
    rows, codes, values = rows[inside], codes[inside], values[inside]
    share = (weight / weight.sum()).astype(np.float32)
    bad, good = ((y == k) & (weight > 0) for k in (1, 0))
    ratio = np.log((np.bincount(codes[bad[rows]], minlength=_FAMILIES << BITS) + 1) / bad.sum() / ((np.bincount(codes[good[rows]], minlength=_FAMILIES << BITS) + 1) / good.sum())).astype(np.float32)
    values = values * ratio[codes]
    w, bias = np.zeros(_FAMILIES << BITS, np.float32), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, steps + 1):
        z = np.bincount(rows, values * w[codes], len(y)) + bias
        g = (share * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y)).astype(np.float32)
        grad = np.bincount(codes, values * g[rows], len(w)).astype(np.float32) + l2 * w
        a, b = 1 - 0.9**step, 1 - 0.99**step
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        mb, vb = 0.9 * mb + 0.1 * g.sum(), 0.99 * vb + 0.01 * g.sum() ** 2
        w -= (0.1 / a) * m / (np.sqrt(v / b) + 1e-8)
        bias -= 0.1 * (mb / a) / ((vb / b) ** 0.5 + 1e-8)
    return w * ratio, float(bias)


def platt(z: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and shift that turn held-out logits into probabilities, by Newton steps with Platt's smoothed targets."""
    good, bad = (y == 0).sum(), (y == 1).sum()
    target = np.where(y == 1, (bad + 1) / (bad + 2), 1 / (good + 2))
    a = np.array([1.0, 0.0])
    x = np.stack([z, np.ones(len(z))], 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -50, 50)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.eye(2) * 1e-3
        a = a - np.clip(np.linalg.solve(h, x.T @ (p - target)), -1, 1)
    return float(max(a[0], 1e-3)), float(a[1])


def train(texts: pa.Array, bad: np.ndarray) -> Model | None:
    """A model of labelled texts (bad: 0 or 1), or None if they are not of both kinds."""
    y = np.asarray(bad, np.float64)
    if len(y) < 2 or not 0 < y.sum() < len(y):
        return None
    rows, codes, values = _rows(texts)
    balanced = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum())) * len(y)
    fold = np.arange(len(y)) % 5 == 0
    z = None
    if len(y) >= 50 and 0 < y[fold].sum() < fold.sum() and 0 < y[~fold].sum() < (~fold).sum():
        w, b = _fit(rows, codes, values, y, np.where(fold, 0, balanced))
        z = np.bincount(rows, values * w[codes], len(y)) + b
    weights, bias = _fit(rows, codes, values, y, balanced)
    slope, shift = platt(z[fold], y[fold]) if z is not None else (1.0, 0.0)
    return Model(weights.reshape(_FAMILIES, -1), bias, slope, shift)


def labelled(docs: DataFrame, labels: DataFrame, label: str, limit: int, which=None) -> DataFrame:
    """text and label of at most ``limit`` labelled rows, those of smallest hash of doc_id; bounded, so one task may hold it."""
    rows = labels.select("doc_id", label).filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
    if which is not None:
        rows = rows.filter(which)
    few = rows.orderBy(F.xxhash64("doc_id"), "doc_id", label).limit(limit)
    short = docs.select("doc_id", "text").filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= TEXT_BYTES)
    return short.join(F.broadcast(few), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).select("text", F.col(label).cast("int").alias(label))


def fitted(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> Model | None:
    """The model, trained by one task on its bounded sample; the driver gets its 2 MB alone."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if parts:
            sample = pa.Table.from_batches(parts)
            m = train(sample["text"], 1 - sample["quality"].to_numpy())
            if m is not None:
                yield pa.RecordBatch.from_pylist([{"weights": m.weights.astype(np.float32).tobytes(), "bias": m.bias, "slope": m.slope, "shift": m.shift}])

    found = labelled(docs, labels, "quality", limit).coalesce(1).mapInArrow(lean(fit), "weights binary, bias double, slope double, shift double").toArrow().to_pylist()
    return Model(np.frombuffer(found[0]["weights"], np.float32).reshape(_FAMILIES, -1), found[0]["bias"], found[0]["slope"], found[0]["shift"]) if found else None


_JUDGED = {"n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(), "base_failed": pa.bool_(), "kept": pa.bool_(), "bad_probability": pa.float64()}


def judge(texts: pa.Array, model: Model | None, threshold: float = THRESHOLD) -> dict[str, np.ndarray]:
    out = {k: [] for k in _JUDGED}
    for t in K.texts(texts):
        starts, ends = K.spans(t)
        m = measures(t, starts, ends, K.split_docs(starts, t.offsets), K.Rolling(t.buf))
        failed = base_failed(m)
        p = model.bad(t) if model else np.zeros(len(t))
        for k, v in {**vars(m), "base_failed": failed, "kept": ~failed & (p < threshold), "bad_probability": p}.items():
            out[k].append(v)
    return {k: np.concatenate(v) if v else np.zeros(0) for k, v in out.items()}


def verdicts(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and bad_probability for every row of docs."""
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, limit))  # 2 MB, whatever the input

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = judge(batch.column("text"), model.value, threshold)
            arrays = [pa.array(found[k].astype(t.to_pandas_dtype()), t) for k, t in _JUDGED.items()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names=["doc_id", *_JUDGED])

    kinds = {pa.int64(): "long", pa.bool_(): "boolean", pa.float64(): "double"}
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(score), "doc_id long, " + ", ".join(f"{k} {kinds[t]}" for k, t in _JUDGED.items()))


def good_rows(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that are kept, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, limit))
    place = docs.columns.index("text")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(judge(batch.column(place), model.value, threshold)["kept"].astype(bool)))

    return docs.mapInArrow(lean(choose), docs.schema)
