"""Identifiers, digests, dates and nested JSON as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the URL namespace of RFC 4122.
NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"


def uuid5(name: Column, namespace: str = NAMESPACE_URL) -> Column:
    """RFC 4122 version-5 identifier of a name."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def order_key(*parts: Column, seed: int = 42) -> Column:
    """A seeded pseudo-random order that any engine with MD5 reproduces."""
    return F.md5(F.concat_ws(":", *[p.cast("string") for p in parts], F.lit(str(seed))))


def bucket(value: Column, n: int) -> Column:
    """Multiplicative hash of an id into n buckets."""
    return F.pmod(value.cast("long") * F.lit(2654435761), F.lit(n))


def to_utc(local: Column, zone: Column | str) -> Column:
    return F.to_utc_timestamp(local, zone)


def parsed_timestamp(text: Column) -> Column:
    """A timestamp, or null where the text is out of range or malformed."""
    return F.try_to_timestamp(text)


def without_sentinel_dates(text: Column) -> Column:
    return F.replace(text, F.lit("0001-01-01"), F.lit("1970-01-01"))


def json_value(text: Column, path: str) -> Column:
    return F.get_json_object(text, path)


def digest_matches(content: Column, prefix: Column) -> Column:
    return F.startswith(F.sha2(content, 256), prefix)


def clean_tag(tag: Column) -> Column:
    """A model's tag as registries compare it: lower case, hyphens as underscores."""
    return F.replace(F.lower(tag), F.lit("-"), F.lit("_"))


def is_remote(path: Column) -> Column:
    return F.contains(path, F.lit("http"))


def merged_config(base: Column, overlay: Column) -> Column:
    """The base map with the overlay's values, but for unknown keys and nulls."""
    known = F.map_filter(overlay, lambda k, v: F.array_contains(F.map_keys(base), k) & v.isNotNull())
    return F.map_from_entries(F.transform(F.map_entries(base), lambda e: F.struct(e["key"].alias("key"), F.coalesce(F.element_at(known, e["key"]), e["value"]).alias("value"))))
