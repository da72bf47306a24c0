"""Text cleaning and token arrays as column expressions; HTML entities by an Arrow-batched function."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

START, END = 49406, 49407
#: Bytes of texts whose encodings are held at once; the tokenizer keeps over a hundred bytes a token.
ENCODED = 1 << 20


def whitespace_clean(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"^ | $", "")


def canonicalize(text: Column, keep: str | None = None) -> Column:
    """Underscores to blanks, ASCII punctuation dropped, lower case, white space collapsed.

    keep: a string that stays as it is; the parts between its occurrences are cleaned.
    """
    t = F.regexp_replace(text, "_", " ")
    drop = lambda c: F.regexp_replace(c, r"[\p{Punct}]", "")
    t = drop(t) if keep is None else F.array_join(F.transform(F.split(t, _quoted(keep)), drop), keep)
    return whitespace_clean(F.lower(t))


def _quoted(s: str) -> str:
    return r"\Q" + s + r"\E"


def repaired(text: str) -> str:
    """Mojibake undone: stretches whose characters, as bytes of Windows-1252 or Latin-1, are valid UTF-8 of several bytes."""

    def undo(m: re.Match) -> str:
        for codec in ("cp1252", "latin-1"):
            try:
                return m[0].encode(codec).decode()
            except UnicodeError:
                continue
        return m[0]

    for _ in range(2):  # text may have been read wrongly twice
        fixed = _MOJIBAKE.sub(undo, text)
        if fixed == text:
            break
        text = fixed
    return text


# First bytes of a character of two, three or four bytes, and the bytes that follow, as Windows-1252 or Latin-1 shows them.
_FOLLOW = "[\x80-\xbf€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]"
_MOJIBAKE = re.compile(f"(?:[\xc2-\xdf]{_FOLLOW}|[\xe0-\xef]{_FOLLOW}{{2}}|[\xf0-\xf4]{_FOLLOW}{{3}})+")


@F.pandas_udf(StringType())
def repair_and_unescape(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda t: t if t is None else html.unescape(html.unescape(repaired(t))))


def basic_clean(text: Column) -> Column:
    """Mojibake repaired, HTML entities undone twice, blanks cut off the ends."""
    return F.trim(repair_and_unescape(text))


@lru_cache(maxsize=2)
def _byte_pairs(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True  # their strings in a text are ordinary text
    return t


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Stretches of texts of about ENCODED bytes, or one text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + ENCODED, "right")))
        yield texts.slice(lo, hi - lo)
        lo = hi


def byte_pair_ids(text: Column, path: str) -> Column:
    """Ids of cleaned lower-case text under the byte-pair vocabulary at path."""

    @F.arrow_udf(ArrayType(IntegerType()))
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        t = _byte_pairs(path)
        for batch in batches:
            ids, ends = [np.zeros(0, np.int32)], [0]
            for some in _slices(batch):
                for e in t.encode_batch_fast([x or "" for x in some.to_pylist()], add_special_tokens=False):
                    ids.append(np.array(e.ids, np.int32))
                    ends.append(ends[-1] + len(ids[-1]))
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids)))

    return encode(lower_clean(text))


def byte_signs() -> dict[int, str]:
    """The sign that stands for each byte in a vocabulary: itself if it can be seen in Latin-1, else the next of those from 256."""
    seen = [b for b in range(256) if 33 <= b <= 126 or b >= 161 and b != 173]
    hidden = [b for b in range(256) if b not in set(seen)]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def byte_pair_text(ids: Column, path: str) -> Column:
    """The text of ids, a blank after each word; ids that stand for no text are left out."""
    byte_of = {sign: b for b, sign in byte_signs().items()}

    @F.arrow_udf(StringType())
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        t = _byte_pairs(path)
        for batch in batches:
            words = ("".join(t.id_to_token(i) for i in x.as_py() if i < START).split("</w>") for x in batch)
            yield pa.array((" ".join(bytes(byte_of[c] for c in w).decode(errors="replace") for w in x) for x in words), pa.string())

    return decode(ids)


def dropped(tokens: Column, key: Column, share: float) -> Column:
    """Tokens that stay when a share is dropped at random, in their order: at least one, if there is any."""
    return random_mask(tokens, key, F.greatest(F.lit(1), F.floor(F.size(tokens) * F.lit(1 - share)).cast("int")))


def lower_clean(text: Column) -> Column:
    return F.lower(whitespace_clean(basic_clean(text)))


def clean(text: Column, mode: str) -> Column:
    modes = {"canonicalize": lambda t: canonicalize(basic_clean(t)), "lower": lower_clean, "whitespace": lambda t: whitespace_clean(basic_clean(t))}
    if mode not in modes:
        raise ValueError(f"mode is {mode!r}; known: {', '.join(modes)}")
    return modes[mode](text)


# Word classes of the pre-tokenizer.
_WORDS = r"('s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+)"


def words(text: Column) -> Column:
    """Pre-tokens: contractions, letter runs, single digits, runs of other marks."""
    return F.regexp_extract_all(F.lower(text), F.lit(_WORDS), F.lit(1))


def fixed_length(ids: Column, length: int = 77, start: int = START, end: int = END) -> Column:
    """start + ids + end, cut so that end stays last, padded with zeros."""
    body = F.slice(F.coalesce(ids, F.array().cast("array<int>")), 1, length - 2)
    framed = F.concat(F.array(F.lit(start)), body, F.array(F.lit(end)))
    return F.concat(framed, F.array_repeat(F.lit(0), F.lit(length) - F.size(framed)))


def hash_ids(tokens: Column, size: int = 49152) -> Column:
    """Ids of tokens by hash, where no vocabulary is at hand."""
    return F.transform(tokens, lambda t: F.pmod(F.crc32(F.encode(t, "UTF-8")), F.lit(size)).cast("int"))


def random_mask(tokens: Column, key: Column, keep: int) -> Column:
    """``keep`` tokens by smallest seeded hash, in their own order."""
    seen = F.transform(tokens, lambda t, i: F.struct(F.md5(F.concat_ws(":", key.cast("string"), i.cast("string"))).alias("h"), i.alias("i"), t.alias("t")))
    some = F.slice(F.array_sort(seen), 1, keep)
    return F.transform(F.array_sort(F.transform(some, lambda s: F.struct(s["i"].alias("i"), s["t"].alias("t")))), lambda s: s["t"])


def block_mask(tokens: Column, key: Column, keep: int) -> Column:
    """A contiguous block of ``keep`` tokens at a seeded place."""
    room = F.greatest(F.size(tokens) - keep, F.lit(0)) + 1
    return F.slice(tokens, (F.pmod(F.crc32(F.encode(key.cast("string"), "UTF-8")), room.cast("bigint")) + 1).cast("int"), keep)


def shuffle_mask(tokens: Column, key: Column, keep: int) -> Column:
    """``keep`` tokens by smallest seeded hash, in the order of the hashes."""
    seen = F.transform(tokens, lambda t, i: F.struct(F.md5(F.concat_ws(":", key.cast("string"), i.cast("string"))).alias("h"), i.alias("i"), t.alias("t")))
    return F.transform(F.slice(F.array_sort(seen), 1, keep), lambda s: s["t"])
