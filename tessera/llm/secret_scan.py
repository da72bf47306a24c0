"""Secret scan: three patterns, and a token-efficiency test for random strings.

Long strings are split by a byte-pair vocabulary. Words and names of a language cost few tokens for their length;
random strings cost many. A run of key characters with under ``RATIO`` characters a token is reported as ``random``,
unless it is a known digest (hexadecimal of a digest's length, a UUID) or an identifier (words, possibly joined or in
camel case, numbers and versions at the end of words). Letters are a word only if they cost few tokens themselves. What
other spans leave of a run is tested; if it is not random as a whole, so are its stretches of parts that can't be read.

Defined cases: a null text is empty and has no spans; texts are scanned whole, whatever their length; repeated rows
are scanned each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm import textkernel as K

KINDS = ("assign", "access", "hex", "random")
RATIO = 2.0
LEAST = 16
TOKENIZER = "byte_bpe_50k.tiktoken"

# The patterns and the least lengths of their values.
_ASSIGN = re.compile(rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{24,}")

_RUN = re.compile(rb"[A-Za-z0-9+/_=-]{%d,}" % LEAST)
_DIGEST = re.compile(rb"(?i:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}|[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})")
_NAME = re.compile(rb"(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+(?![A-Za-z]))(?:[-_/+=]+(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+(?![A-Za-z]))|(?<=[a-z])[A-Z][a-z]+|(?<=[A-Za-z])[0-9]{1,4}(?![0-9A-Za-z]))*[-_/+=]*")
_LETTERS = re.compile(rb"[A-Z]?[a-z]+|[A-Z]+")
_PART = re.compile(rb"(?<![A-Za-z0-9])(?i:[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})(?![A-Za-z0-9])|[A-Za-z0-9]+")
_SHORT = 4


def _default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


VOCABULARY = _default_path()


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("scan", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1 << 16)
def _is_word(letters: bytes, path: str, ratio: float) -> bool:
    """Few tokens for its length, in the given case or in lower case, as few words in capitals are in a vocabulary."""
    n = min(len(encoding(path).encode_ordinary(x)) for x in {letters.decode(), letters.decode().lower()})
    return n == 1 or len(letters) >= ratio * n


def is_name(run: bytes, path: str = VOCABULARY, ratio: float = RATIO) -> bool:
    return bool(_NAME.fullmatch(run)) and all(_is_word(x, path, ratio) for x in _LETTERS.findall(run))


def is_random(run: bytes, path: str = VOCABULARY, ratio: float = RATIO) -> bool:
    if _DIGEST.fullmatch(run) or is_name(run, path, ratio):
        return False
    return len(run) < ratio * len(encoding(path).encode_ordinary(run.decode()))


def _stretches(run: bytes, path: str, ratio: float) -> Iterator[tuple[int, int]]:
    """Stretches of at least ``LEAST`` characters from one part that can't be read to another, over short parts between."""
    start = end = None
    for m in _PART.finditer(run):
        if not (_DIGEST.fullmatch(m[0]) or is_name(m[0], path, ratio)):
            start, end = m.start() if start is None else start, m.end()
        elif start is not None and len(m[0]) >= _SHORT:
            if end - start >= LEAST:
                yield start, end
            start = None
    if start is not None and end - start >= LEAST:
        yield start, end


def random_parts(run: bytes, path: str = VOCABULARY, ratio: float = RATIO) -> list[tuple[int, int]]:
    """(start, end) of what is random in a run: all of it, or stretches beside readable parts."""
    if _DIGEST.fullmatch(run) or is_name(run, path, ratio):
        return []
    if is_random(run, path, ratio):
        return [(0, len(run))]
    return [(s, e) for s, e in _stretches(run, path, ratio) if is_random(run[s:e], path, ratio)]


def _joint(spans: list[tuple[int, int, int]]) -> list[list[int]]:
    """What sorted spans cover: disjoint [start, end], in order."""
    out: list[list[int]] = []
    for s, _, e in spans:
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def _left(text: bytes, covered: list[list[int]]) -> Iterator[tuple[int, int]]:
    """What covered stretches leave of the text's runs: one sweep over both."""
    at = 0
    for m in _RUN.finditer(text):
        start, end = m.span()
        while at < len(covered) and covered[at][1] <= start:
            at += 1
        k = at
        while k < len(covered) and covered[k][0] < end:
            if start < covered[k][0]:
                yield start, covered[k][0]
            start = max(start, covered[k][1])
            k += 1
        if start < end:
            yield start, end
        at = max(at, k - 1)


def find(text: bytes, path: str = VOCABULARY, ratio: float = RATIO) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every span, in bytes, sorted. What lies in another span is not told again as random."""
    found = []
    if b":" in text or b"=" in text:
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    for s, e in _left(text, _joint(sorted(found))):
        if e - s >= LEAST:
            found += [(s + a, 3, s + b) for a, b in random_parts(text[s:e], path, ratio)]
    return sorted(found)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


_OUT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_random", pa.int64())])


def _scanner(path: str, ratio: float):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            ids = batch.column("doc_id").to_pylist()
            for t in K.texts(batch.column("text")):
                follows = None
                for i in range(len(t)):
                    lo, hi = t.offsets[i], t.offsets[i + 1]
                    spans = find(t.buf[lo:hi].tobytes(), path, ratio)
                    if spans:  # bytes to code points
                        if follows is None:
                            follows = np.concatenate(([0], np.cumsum((t.buf & 0xC0) == 0x80)))
                        point = lambda at: int(at - (follows[lo + at] - follows[lo]))  # noqa: B023, E731
                        spans = [(point(s), k, point(e)) for s, k, e in spans]
                    base = [x for x in spans if x[1] < 3]
                    n = [sum(x[1] == k for x in spans) for k in range(4)]
                    out.append((ids[t.first + i], n[0], n[1], n[2], hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), n[3]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)

    return scan


def scan(docs: DataFrame, vocabulary: str = VOCABULARY, ratio: float = RATIO) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random for every row of docs."""
    from pyspark.sql import functions as F

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scanner(vocabulary, ratio), _OUT)
