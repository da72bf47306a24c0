"""Patch captions and info strings, parsed and built as column expressions.

A caption is ``_x_y_w_h_level.png`` (or without the leading underscore); an info string is
``{id}_{name}_{x}_{y}_{w}_{h}_{level}.png``, where the name may hold underscores, so it is read from its tail.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _number(c: Column) -> Column:
    return c.try_cast("int")


def parse_info(info: Column) -> dict[str, Column]:
    """Columns of an info string; malformed strings give null coordinates."""
    p = F.split(info, "_")
    n = F.size(p)
    tail = lambda k: F.try_element_at(p, F.lit(-k))
    return {
        "slide_id": F.try_element_at(p, F.lit(1)),
        "wsi_name": F.array_join(F.slice(p, F.lit(2), F.greatest(n - 6, F.lit(0))), "_"),
        "source_wsi_name": F.array_join(F.slice(p, F.lit(1), F.greatest(n - 5, F.lit(0))), "_"),
        "x": _number(tail(5)), "y": _number(tail(4)), "w": _number(tail(3)), "h": _number(tail(2)),
        "level": _number(F.substring_index(tail(1), ".", 1)),
    }


def is_complete(parsed: dict[str, Column]) -> Column:
    ok = F.lit(True)
    for k in ("x", "y", "w", "h", "level"):
        ok = ok & parsed[k].isNotNull()
    return ok


_CAPTION = r"^_?(\d+)_(\d+)_(\d+)_(\d+)_(\d+)\.png$"


def parse_caption(caption: Column) -> dict[str, Column]:
    """x, y, w, h, level of a caption with or without its leading underscore."""
    return {k: _number(F.regexp_extract(caption, _CAPTION, i + 1)) for i, k in enumerate(("x", "y", "w", "h", "level"))}


def caption(x: Column, y: Column, w: Column, h: Column, level: Column) -> Column:
    return F.concat(F.lit("_"), F.concat_ws("_", *[c.cast("string") for c in (x, y, w, h, level)]), F.lit(".png"))


def info(folder: Column, x: Column, y: Column, w: Column, h: Column, level: Column) -> Column:
    return F.concat(folder, caption(x, y, w, h, level))


def tile_url(head: str | Column, name: Column, x: Column, y: Column, w: Column, h: Column, level: Column) -> Column:
    head = F.lit(head) if isinstance(head, str) else head
    return F.concat_ws("/", head, name, *[c.cast("string") for c in (x, y, w, h, level)])


def without_first_token(name: Column) -> Column:
    return F.regexp_replace(name, r"^[^_]*_", "")


def label_of_folder(path: Column) -> Column:
    """Second dash-separated part of a folder's own name."""
    return F.split_part(F.element_at(F.split(path, "/"), -1), F.lit("-"), F.lit(2))


def natural_key(name: Column, width: int = 12) -> Column:
    """A sort key under which digit runs compare as numbers."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, width, "0")).otherwise(p))
