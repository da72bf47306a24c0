"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

Each word enters as the embedding of its hashed form and the mean of the embeddings of its hashed pieces of 4 and 6 bytes
(with marks at its ends); both tables are trained with the network. Two gated recurrent layers of ``HIDDEN`` units read
windows of ``WINDOW`` words, one in each direction; attention pools their states and a logistic output scores the window. Windows
overlap by half and cover every word; a text's score is that of its highest window, so any toxic passage of a long
text counts. Training: the highest window of a text stands for it, chosen anew between epochs; at first, the window
with the word that is most typical of toxic texts. A fifth of the training rows is left out of training, to turn
scores to probabilities.

The training rows are at most ``SAMPLE`` of either label, those of smallest hash among texts of at most ``TEXT_BYTES``
bytes, a documented bound in rows and bytes; all texts are scored whole. Labels, language, source and identifiers are never inputs.

Defined cases: a null or empty text scores as a window without words; without training rows of both labels every text
scores 0.5 times the smoothed share of toxic rows (0 if there are none); a null doc_id is not held out and never
trained on; repeated rows are scored each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textkernel as K
from tessera.llm.lm_scoring import held_out
from tessera.llm.quality import platt

SAMPLE = {1: 1500, 0: 3000}
THRESHOLD = 0.3
WINDOW, STRIDE = 32, 16
HIDDEN = 16
BITS = 15
WIDTH = 16  # of either embedding
TEXT_BYTES = 1 << 17
_INPUTS = 2 * WIDTH
_BATCH = 1024
_PRIOR = 2.0
_EPOCHS = 6
_DROPPED = 0.5
_RATE = 0.3
_STEP = 0.01
_INIT = 0.01
_SLICE = 1 << 20
_F = np.float32


# --- inputs ------------------------------------------------------------------------------------------------------


@dataclass
class Words:
    """Distinct words: hash, and buckets of the 4-byte and 6-byte pieces with bounds; each word's place among them; words' bounds by text."""

    hash: np.ndarray
    piece: np.ndarray
    piece_at: np.ndarray
    index: np.ndarray
    at: np.ndarray

    @property
    def form(self) -> np.ndarray:
        return (self.hash >> K.U(64 - BITS)).astype(np.int64)


def words_of(t: K.Texts) -> Words:
    buf = K.lower(t.buf)
    starts, ends = K.spans(K.Texts(t.first, buf, t.offsets))
    at = K.split_docs(starts, t.offsets)
    hash_, first, index = np.unique(K.Rolling(buf)(starts, ends), return_index=True, return_inverse=True)
    starts, ends = starts[first], ends[first]
    # Words set apart by marks: \x02 word \x03, so that every word has at least one 4-byte piece when padded.
    size = ends - starts
    room = np.maximum(size + 2, 4)
    place = np.concatenate(([0], np.cumsum(room)))
    marked = np.zeros(place[-1], np.uint32)
    marked[place[:-1]] = 2
    inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    marked[np.repeat(place[:-1] + 1, size) + inner] = buf[np.repeat(starts, size) + inner]
    marked[place[:-1] + 1 + size] = 3
    count = room - 3
    piece_at = np.concatenate(([0], np.cumsum(count)))
    # Each place of a word gives a piece of 4 bytes, and in turn one of 6 that begins there (cut at the word's end).
    where, stop = _stretches(place[:-1], count), np.repeat(place[1:], count)
    four, six = np.zeros(len(where), np.uint64), np.zeros(len(where), np.uint64)
    for k in range(6):
        byte = np.where(where + k < stop, marked[np.minimum(where + k, max(len(marked) - 1, 0))], 0).astype(np.uint64)
        six = six << K.U(8) | byte
        four = four << K.U(8) | byte if k < 4 else four
    bucket = lambda x, seed: (K.mix(x + K.U(seed << 56)) >> K.U(64 - BITS)).astype(np.int32)
    pieces = np.stack([bucket(four, 1), bucket(six, 2)], 1).reshape(-1)
    return Words(hash_, pieces, 2 * piece_at, index.astype(np.int32), at)


def _stretches(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... (count[i] numbers), one stretch after the other."""
    at = np.cumsum(count) - count
    return np.repeat(start - at, count) + np.arange(int(count.sum()))


def joined(slices: Iterator[Words]) -> Words:
    """Words of consecutive slices as one; pieces are kept of words not met before."""
    known, hashes, pieces, counts, index, sizes = np.zeros(0, K.U), [], [], [], [], []
    for w in slices:
        at = np.minimum(np.searchsorted(known, w.hash), max(len(known) - 1, 0))
        new = np.flatnonzero(known[at] != w.hash) if len(known) else np.arange(len(w.hash))
        count = np.diff(w.piece_at)
        hashes.append(w.hash[new])
        pieces.append(w.piece[_stretches(w.piece_at[new], count[new])])
        counts.append(count[new])
        index.append(w.hash[w.index])
        sizes.append(np.diff(w.at))
        known = np.sort(np.concatenate((known, w.hash[new])))
    told = np.concatenate(hashes)  # in the order of the pieces
    order = np.argsort(told, kind="stable")
    index = np.concatenate([np.searchsorted(known, h).astype(np.int32) for h in index])
    count = np.concatenate(counts)
    piece_at = np.concatenate(([0], np.cumsum(count)))
    whole, piece = np.concatenate(pieces), np.empty(piece_at[-1], np.int32)
    del pieces
    ends = np.concatenate(([0], np.cumsum(count[order])))
    for i in range(0, len(order), 50_000):
        mine = order[i : i + 50_000]
        piece[ends[i] : ends[i + len(mine)]] = whole[_stretches(piece_at[mine], count[mine])]
    return Words(known, piece, ends, index, np.concatenate(([0], np.cumsum(np.concatenate(sizes)))))


def inputs(w: Words, some: np.ndarray, form: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """Input rows of some of the distinct words: the form's embedding beside the mean of the pieces'."""
    out = np.empty((len(some), _INPUTS), _F)
    out[:, :WIDTH] = form[w.form[some]]
    for i in range(0, len(some), 8192):
        mine = some[i : i + 8192]
        begin, count = w.piece_at[mine], w.piece_at[mine + 1] - w.piece_at[mine]
        sums = np.add.reduceat(piece[w.piece[_stretches(begin, count)]], np.cumsum(count) - count)
        out[i : i + 8192, WIDTH:] = sums / count[:, None]
    return out


# --- network -----------------------------------------------------------------------------------------------------


def windows_of(n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word in the text, length) of every window; a text without words has one of length 0."""
    n = np.maximum(1, -(-(n_words - (WINDOW - STRIDE)) // STRIDE))
    text = np.repeat(np.arange(len(n_words)), n)
    first = (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * STRIDE
    return text, first, np.minimum(WINDOW, n_words[text] - first)


def initial(seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    h = HIDDEN
    p = {}
    for d in ("f", "b"):
        p[f"W{d}"] = rng.normal(0, 0.4, (_INPUTS, 3 * h))
        p[f"c{d}"] = np.concatenate((np.full(h, -1.0), np.zeros(2 * h)))
        p[f"U{d}"] = rng.normal(0, 0.3, (h, 2 * h))
        p[f"N{d}"] = rng.normal(0, 0.3, (h, h))
    p["v"] = rng.normal(0, 0.3, 2 * h)
    p["o"] = rng.normal(0, 0.3, 2 * h)
    p["k"] = np.zeros(1)
    return {k: v.astype(_F) for k, v in p.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.tanh(x * _F(0.5)) * _F(0.5) + _F(0.5)


def _run(gates: np.ndarray, rows: np.ndarray, mask: np.ndarray, U: np.ndarray, N: np.ndarray, out: np.ndarray, tape: list | None) -> None:
    """One direction over windows: rows[t] are the words read at step t, out[t] gets the states."""
    h = np.zeros((rows.shape[1], HIDDEN), _F)
    for t in range(len(rows)):
        g = gates[rows[t]]
        zr = _sigmoid(g[:, : 2 * HIDDEN] + h @ U)
        zs, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        rh = r * h
        n = np.tanh(g[:, 2 * HIDDEN :] + rh @ N)
        z = zs * mask[t][:, None]
        if tape is not None:
            tape.append((h, zs, r, n, rh, z))
        h = h + z * (n - h)
        out[t] = h


def gates_of(p: dict[str, np.ndarray], x: np.ndarray) -> dict[str, np.ndarray]:
    """The inputs' part of the gates, for each word once; the last row is for steps beyond a window's end."""
    x = np.concatenate((x, np.zeros((1, _INPUTS), _F)))
    return {d: x @ p[f"W{d}"] + p[f"c{d}"] for d in ("f", "b")}


def forward(p: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray, length: np.ndarray, keep: bool = False, gates: dict | None = None):
    """Logits of windows of words x[first : first + length], and what a backward pass needs.

    Without gates of all words, they are made for the windows' words alone.
    """
    steps = max(int(length.max(initial=0)), 1)
    t = np.arange(steps)[:, None]
    mask = (t < length).astype(_F)
    if gates is None:
        source = np.where(t < length, first + t, 0).reshape(-1)
        size = len(x)
        x = x[source] if size else np.zeros((steps * len(first), _INPUTS), _F)
        first, stride = np.arange(len(first)), len(first)
        gates = gates_of(p, x)
        x = np.concatenate((x, np.zeros((1, _INPUTS), _F)))
    else:
        stride, source, size = 1, None, 0
    blank = len(gates["f"]) - 1
    ahead = np.where(t < length, first + t * stride, blank)
    back = np.where(t < length, first + (length - 1 - t) * stride, blank)
    states = np.empty((steps, len(first), 2 * HIDDEN), _F)
    tapes = {"f": [], "b": []} if keep else {"f": None, "b": None}
    for d, rows, part in (("f", ahead, slice(0, HIDDEN)), ("b", back, slice(HIDDEN, None))):
        one = np.empty((steps, len(first), HIDDEN), _F)
        _run(gates[d], rows, mask, p[f"U{d}"], p[f"N{d}"], one, tapes[d])
        if d == "b":  # back to the order of the words
            one = one[np.clip(length - 1 - t, 0, None), np.arange(len(first))]
        states[:, :, part] = one
    e = np.where(mask > 0, states @ p["v"], _F(-30))
    a = np.exp(e - e.max(0))
    a /= a.sum(0)
    pooled = (a[:, :, None] * states).sum(0) * (length > 0)[:, None]
    logits = pooled @ p["o"] + p["k"][0]
    return logits, (x, ahead, back, mask, states, a, pooled, tapes, length, source, size)


def backward(p: dict[str, np.ndarray], saved, dlogit: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the weights, and of the input rows as "x"."""
    x, ahead, back, mask, states, a, pooled, tapes, length, source, size = saved
    gx = np.zeros_like(x)
    g = {"k": dlogit.sum(keepdims=True), "o": pooled.T @ dlogit}
    dpooled = dlogit[:, None] * p["o"] * (length > 0)[:, None]
    da = (states * dpooled).sum(2)
    de = a * (da - (a * da).sum(0)) * (mask > 0)
    g["v"] = np.einsum("tn,tnk->k", de, states)
    ds = a[:, :, None] * dpooled + de[:, :, None] * p["v"]
    t = np.arange(len(mask))[:, None]
    for d, rows, part in (("f", ahead, slice(0, HIDDEN)), ("b", back, slice(HIDDEN, None))):
        dout = ds[:, :, part]
        if d == "b":
            turned = np.zeros_like(dout)
            turned[np.clip(length - 1 - t, 0, None), np.arange(len(length))] += np.where(mask[:, :, None] > 0, dout, 0)
            dout = turned
        U, N = p[f"U{d}"], p[f"N{d}"]
        gU, gN, gW, gc = np.zeros_like(U), np.zeros_like(N), np.zeros_like(p[f"W{d}"]), np.zeros_like(p[f"c{d}"])
        carry = np.zeros_like(dout[0])
        for s in range(len(mask) - 1, -1, -1):
            h, zs, r, n, rh, z = tapes[d][s]
            dh = carry + dout[s]
            dn = dh * z * (1 - n * n)
            dz = dh * (n - h) * mask[s][:, None] * zs * (1 - zs)
            drh = dn @ N.T
            dr = drh * h * r * (1 - r)
            zr = np.concatenate((dz, dr), 1)
            carry = dh * (1 - z) + drh * r + zr @ U.T
            gU += h.T @ zr
            gN += rh.T @ dn
            gates = np.concatenate((zr, dn), 1)
            gW += x[rows[s]].T @ gates
            gx[rows[s]] += gates @ p[f"W{d}"].T  # a step reads each window's own rows
            gc += gates.sum(0)
        g |= {f"U{d}": gU, f"N{d}": gN, f"W{d}": gW, f"c{d}": gc}
    g["x"] = np.zeros((size, _INPUTS), _F)
    if size:
        np.add.at(g["x"], source, gx[:-1] * mask.reshape(-1, 1))
    return g


def _logits(p: dict[str, np.ndarray], w: Words, form: np.ndarray, piece: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Logits of windows in the order of the words. Gates are made once for each distinct word of a stretch."""
    out = np.empty(len(first), _F)
    for i in range(0, len(first), 4 * _BATCH):
        f, n = first[i : i + 4 * _BATCH], length[i : i + 4 * _BATCH]
        lo, hi = int(f.min(initial=0)), int((f + n).max(initial=0))
        some, own = np.unique(w.index[lo:hi], return_inverse=True)
        gates = gates_of(p, inputs(w, some, form, piece))
        places = np.append(own, len(some))  # the last row of the gates is for steps beyond a window
        for j in range(0, len(f), _BATCH):
            out[i + j : i + j + len(f[j : j + _BATCH])] = _scored(p, gates, places, f[j : j + _BATCH] - lo, n[j : j + _BATCH])
    return out


def _scored(p: dict[str, np.ndarray], gates: dict, places: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """forward() without a tape, over gates of distinct words."""
    steps = max(int(length.max(initial=0)), 1)
    t = np.arange(steps)[:, None]
    mask = (t < length).astype(_F)
    blank = len(places) - 1
    states = np.empty((steps, len(first), 2 * HIDDEN), _F)
    for d, at, part in (("f", first + t, slice(0, HIDDEN)), ("b", first + (length - 1 - t), slice(HIDDEN, None))):
        one = np.empty((steps, len(first), HIDDEN), _F)
        _run(gates[d], places[np.where(t < length, at, blank)], mask, p[f"U{d}"], p[f"N{d}"], one, None)
        states[:, :, part] = one[np.clip(length - 1 - t, 0, None), np.arange(len(first))] if d == "b" else one
    e = np.where(mask > 0, states @ p["v"], _F(-30))
    a = np.exp(e - e.max(0))
    a /= a.sum(0)
    return np.einsum("tn,tnk->nk", a, states) * (length > 0)[:, None] @ p["o"] + p["k"][0]


# --- model -------------------------------------------------------------------------------------------------------


@dataclass
class Model:
    form: np.ndarray
    piece: np.ndarray
    network: dict[str, np.ndarray] | None
    slope: float
    shift: float

    def logits(self, w: Words) -> np.ndarray:
        """That of the highest window of each text."""
        text, first, length = windows_of(np.diff(w.at))
        z = _logits(self.network, w, self.form, self.piece, w.at[text] + first, length)
        return np.maximum.reduceat(z, np.searchsorted(text, np.arange(len(w.at) - 1))).astype(np.float64)

    def scores(self, t: K.Texts) -> np.ndarray:
        if self.network is None:
            return np.full(len(t), self.shift)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(words_of(t)) + self.shift, -40, 40)))


def _typical(w: Words, y: np.ndarray) -> np.ndarray:
    """How typical of toxic texts each distinct word is: a log ratio, drawn to 0 where little was seen."""
    owner = K.owners(w.at)
    pairs = np.unique(owner * len(w.hash) + w.index)  # once a text
    label, word = y[pairs // len(w.hash)], pairs % len(w.hash)
    bad, good = (np.bincount(word, k, len(w.hash)) for k in (label, 1 - label))
    return np.log((bad + _PRIOR) / (good * (y.sum() / max(1, len(y) - y.sum())) + _PRIOR))


class _Steps:
    """Adam for the network, Adagrad for the touched rows of the embeddings."""

    def __init__(self, p: dict[str, np.ndarray], tables: list[np.ndarray]):
        self.p, self.tables, self.n = p, tables, 0
        self.m, self.v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
        self.sums = [np.full(len(t), 1e-6, _F) for t in tables]

    def __call__(self, g: dict[str, np.ndarray], rows: list[tuple[np.ndarray, np.ndarray]]) -> None:
        norm = np.sqrt(sum(float((a * a).sum()) for k, a in g.items() if k != "x"))
        scale, self.n = min(1.0, 2.0 / (norm + 1e-9)), self.n + 1
        for k, a in self.p.items():
            gk = g[k] * scale + 1e-5 * a
            self.m[k] = 0.9 * self.m[k] + 0.1 * gk
            self.v[k] = 0.99 * self.v[k] + 0.01 * gk * gk
            self.p[k] = (a - _STEP * (self.m[k] / (1 - 0.9**self.n)) / (np.sqrt(self.v[k] / (1 - 0.99**self.n)) + 1e-7)).astype(_F)
        for table, total, (place, grad) in zip(self.tables, self.sums, rows, strict=True):
            at, inverse = np.unique(place, return_inverse=True)
            whole = np.zeros((len(at), WIDTH), _F)
            np.add.at(whole, inverse, grad)
            total[at] += (whole * whole).mean(1)
            table[at] -= _RATE * whole / np.sqrt(total[at])[:, None]


def train(texts: pa.Array, toxic: np.ndarray, epochs: int = _EPOCHS, seed: int = 7) -> Model:
    every = np.asarray(toxic, np.int64)
    rng = np.random.default_rng(seed)
    form, piece = (rng.normal(0, _INIT, (1 << BITS, WIDTH)).astype(_F) for _ in range(2))
    if len(every) == 0 or not 0 < every.sum() < len(every):
        return Model(form, piece, None, 1.0, 0.5 * float(every.sum() / (len(every) + 1)) if len(every) else 0.0)
    w = joined(words_of(t) for t in K.texts(texts, _SLICE))
    # Every fifth row of either label is kept for calibration, if there are enough.
    order = np.empty(len(every), np.int64)
    for k in (0, 1):
        order[every == k] = np.arange((every == k).sum())
    held = (order % 5 == 4) & (min(every.sum(), len(every) - every.sum()) >= 10)
    used = np.flatnonzero(~held)
    y = every[used]
    text, first, length = windows_of(np.diff(w.at))
    first = first + w.at[text]
    at = np.searchsorted(text, np.arange(len(every) + 1))
    p = initial(seed)
    step = _Steps(p, [form, piece])
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum())) * len(y)
    seen = Words(w.hash, w.piece, w.piece_at, w.index[np.repeat(~held, np.diff(w.at))], np.concatenate(([0], np.cumsum(np.diff(w.at)[used]))))
    reach = np.append(_typical(seen, y)[w.index], -9.0)
    z = np.array([reach[a : a + max(n, 1)].max() for a, n in zip(first.tolist(), length.tolist(), strict=True)])
    for epoch in range(epochs):
        if epoch in (1, 2, 4):
            z = _logits(p, w, form, piece, first, length)
        top = np.array([at[i] + int(np.argmax(z[at[i] : at[i + 1]])) for i in used])
        clean = used[y == 0]
        some = at[clean] + (rng.random(len(clean)) * (at[clean + 1] - at[clean])).astype(np.int64)  # and any window of a clean text
        chosen = np.concatenate((top, some))
        label = np.concatenate((y, np.zeros(len(clean), np.int64)))
        share = np.concatenate((weight, weight[y == 0]))
        mixed = rng.permutation(len(chosen))
        size = max(16, min(64, len(mixed) // 8))
        for i in range(0, len(mixed), size):
            o = mixed[i : i + size]
            n = length[chosen[o]]
            some, own = np.unique(w.index[_stretches(first[chosen[o]], n)], return_inverse=True)
            x = inputs(w, some, form, piece)
            gone = rng.random(len(some)) < _DROPPED  # without some forms, so that pieces learn to speak for words never seen
            x[gone, :WIDTH] = 0
            logits, saved = forward(p, x[own], np.cumsum(n) - n, n, True)
            d = ((1 / (1 + np.exp(-logits)) - label[o]) * share[o] / len(o)).astype(_F)
            g = backward(p, saved, d)
            gx = np.zeros((len(some), _INPUTS), _F)
            np.add.at(gx, own, g["x"])
            gx[gone, :WIDTH] = 0
            count = w.piece_at[some + 1] - w.piece_at[some]
            pieces = w.piece[_stretches(w.piece_at[some], count)]
            step(g, [(w.form[some], gx[:, :WIDTH]), (pieces, np.repeat(gx[:, WIDTH:] / count[:, None], count, 0))])
    model = Model(form, piece, p, 1.0, 0.0)
    z = model.logits(w)
    told = held if held.any() else np.ones(len(every), bool)
    model.slope, model.shift = platt(z[told], every[told])
    return model


def sampled(docs: DataFrame, labels: DataFrame, limits: dict[int, int]) -> pa.Table:
    """text and toxic of at most limits[label] labelled training rows of either label."""
    rows = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 4, 2))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    few = None
    for label, limit in limits.items():
        part = rows.filter(F.col("toxic") == label).orderBy(*order).limit(limit)
        few = part if few is None else few.unionByName(part)
    total = sum(limits.values())
    # At most the rows of limits, so they may go to every task and, with texts of bounded length, to the driver.
    short = docs.select("doc_id", "text").filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= TEXT_BYTES)
    return short.join(F.broadcast(few), "doc_id").orderBy(*order, "toxic").limit(total).select("text", "toxic").toArrow()


def toxicity(docs: DataFrame, labels: DataFrame, limits: dict[int, int] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    sample = sampled(docs, labels, limits or SAMPLE)
    model = docs.sparkSession.sparkContext.broadcast(train(sample["text"], sample["toxic"].to_numpy()))  # 4 MB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in K.texts(batch.column("text"), _SLICE):
                s = model.value.scores(t)
                rows = batch.slice(t.first, len(t))
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(F.col("doc_id"), 4, 2).alias("held_out"))
    return slim.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
