"""Vectorised text kernel: word, shingle and line hashes of whole Arrow batches in numpy.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``; every separator is ASCII, so working on UTF-8 bytes
is exact. Hashes are 64-bit: a polynomial over the bytes, finished with a mixer that also takes the length.
Texts are handled in slices of about ``SLICE`` bytes, so memory follows the slice or the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE = 2 << 20
U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_STEPS = 1 << 16

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def mix_int(x: int) -> int:
    return int(mix(np.array([x & (2**64 - 1)], U))[0])


_powers = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64. The first ``_STEPS`` are grown by doubling and kept, the rest are their multiples."""
    have = _powers.get(base)
    if have is None:
        have = np.ones(_STEPS, U)
        width = 1
        factor = base
        while width < _STEPS:
            have[width : 2 * width] = have[:width] * U(factor)
            factor = factor * factor % 2**64
            width *= 2
        _powers[base] = have
    if n <= _STEPS:
        return have[:n]
    step = pow(base, _STEPS, 2**64)
    out = np.empty(n, U)
    for k in range(0, n, _STEPS):
        np.multiply(have[: n - k], U(pow(step, k // _STEPS, 2**64)), out=out[k : k + _STEPS])
    return out


_INVERSE = pow(_BASE, -1, 2**64)


@dataclass
class Texts:
    """Consecutive texts as one byte buffer. Text i is buf[offsets[i]:offsets[i + 1]]; a null text is empty."""

    first: int
    buf: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


def texts(array: pa.Array | pa.ChunkedArray, limit: int = SLICE) -> Iterator[Texts]:
    """Slices of a string or binary column, in order, each of at most ``limit`` bytes or one text."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks() if array.num_chunks != 1 else array.chunk(0)
        if isinstance(array, pa.ChunkedArray):
            array = pa.concat_arrays(array.chunks)
    if not len(array):
        return
    if pa.types.is_null(array.type):
        array = array.cast(pa.string())
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    if array.null_count:
        array = array.fill_null(b"" if "binary" in str(array.type) else "")
    _, ends, data = array.buffers()
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i, n = 0, len(array)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, n)
        yield Texts(i, buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j


def lower(buf: np.ndarray) -> np.ndarray:
    return LOWER[buf]


def spans(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word."""
    word = ~IS_SPACE[t.buf]
    if not len(word):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(len(word) + 1, bool)
    inner = t.offsets[(t.offsets > 0) & (t.offsets < len(word))]
    edge[inner] = True
    before = np.concatenate(([False], word[:-1]))
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.concatenate((word[1:], [False]))
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return starts, ends


class Rolling:
    """Hashes of any byte ranges of a buffer from one pass of prefix sums."""

    def __init__(self, buf: np.ndarray):
        power = _power(_BASE, len(buf) + 1)
        self.sum = np.zeros(len(buf) + 1, U)
        np.cumsum((buf.astype(U) + U(1)) * power[: len(buf)], out=self.sum[1:])
        self.inverse = _power(_INVERSE, len(buf) + 1)

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self.sum[ends] - self.sum[starts]) * self.inverse[starts]
        return mix(h + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def split_docs(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bounds of each text's words among all words: text i has words [b[i], b[i + 1])."""
    return np.searchsorted(starts, offsets)


def owners(bounds: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


_MULTIPLIERS = [mix_int(0x5EED + k) | 1 for k in range(64)]


def windows(h: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, index of the first word, bounds by text) of every run of ``width`` words inside one text."""
    n = len(h) - width + 1
    counts = np.maximum(np.diff(bounds) - width + 1, 0)
    out = np.concatenate(([0], np.cumsum(counts)))
    if n <= 0 or not out[-1]:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    s = np.zeros(n, U)
    for k in range(width):
        s += h[k : k + n] * U(_MULTIPLIERS[k])
    first = np.repeat(bounds[:-1] - out[:-1], counts) + np.arange(out[-1])
    return mix(s[first] + U(width)), first, out


def combine(parts: list[np.ndarray]) -> np.ndarray:
    """One hash of aligned hashes, in order."""
    s = np.zeros_like(parts[0])
    for k, p in enumerate(parts):
        s += p * U(_MULTIPLIERS[k])
    return mix(s + U(len(parts)))


def sum_by(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[b[i]:b[i + 1]]."""
    c = np.concatenate((np.zeros(1, values.dtype), np.cumsum(values)))
    return c[bounds[1:]] - c[bounds[:-1]]
