"""Vector arithmetic on array<float> columns, in double precision, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Below this a norm counts as zero.
TINY = 1e-8


def _double(a: Column) -> Column:
    return a.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(_double(a), F.lit(0.0), lambda s, x: s + x * x))


def l2_squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column, guard: str = "zero") -> Column:
    """Cosine similarity.

    guard: "zero" gives 0 where a norm is tiny; "epsilon" adds a tiny number to the denominator; "none" divides.
    """
    product = norm(a) * norm(b)
    if guard == "zero":
        return F.when((norm(a) < TINY) | (norm(b) < TINY), F.lit(0.0)).otherwise(dot(a, b) / product)
    if guard == "epsilon":
        return dot(a, b) / (product + TINY)
    if guard == "none":
        return dot(a, b) / product
    raise ValueError(f"guard is {guard!r}")


def cosine_distance(query: Column, candidate: Column) -> Column:
    """1 - cosine. A zero query is at distance 1 from all; a candidate's norm is at least TINY."""
    near = dot(query, candidate) / (norm(query) * F.greatest(norm(candidate), F.lit(TINY)))
    return F.when(norm(query) < TINY, F.lit(1.0)).otherwise(1 - near)


def normalized(a: Column) -> Column:
    """The unit vector; a zero vector stays as it is."""
    n = norm(a)
    return F.transform(_double(a), lambda x: x / F.when(n == 0, F.lit(1.0)).otherwise(n))


def rounded(a: Column, digits: int = 6) -> Column:
    return F.transform(_double(a), lambda x: F.round(x, digits))


def mean_vector(a: Column, size: int) -> list[Column]:
    """Aggregates that average each of the first ``size`` entries over a group."""
    return [F.avg(F.get(_double(a), F.lit(i))) for i in range(size)]


def aspect_penalty(w1: Column, h1: Column, w2: Column, h2: Column) -> Column:
    return F.exp(-F.abs(w1 - w2) - F.abs(h1 - h2))


def level_zero(x: Column, level: Column) -> Column:
    """A level-local coordinate in level-0 pixels."""
    return (x * F.pow(F.lit(2.0), level)).cast("long")


def sincos(position: Column, size: int) -> Column:
    """Sine-cosine embedding of a position: size / 2 sines, then as many cosines."""
    half = size // 2
    steps = F.sequence(F.lit(0), F.lit(half - 1))
    angle = lambda i: position.cast("double") / F.pow(F.lit(10000.0), i.cast("double") / F.lit(float(half)))
    return F.concat(F.transform(steps, lambda i: F.sin(angle(i))), F.transform(steps, lambda i: F.cos(angle(i))))


def sincos_2d(x: Column, y: Column, size: int) -> Column:
    """Half of the embedding for either axis."""
    return F.concat(sincos(x, size // 2), sincos(y, size // 2))


def mebibytes(rows: Column, size: Column, width: int = 4) -> Column:
    return rows * size * F.lit(width) / F.lit(float(2**20))


def channel_normalized(pixels: Column, mean: float, deviation: float) -> Column:
    return F.transform(_double(pixels), lambda p: (p - F.lit(mean)) / F.lit(deviation))


def rotated_size(w: Column, h: Column, degrees: Column) -> tuple[Column, Column]:
    """Width and height of the box around a rotated w x h rectangle, rounded up (with tolerance for float noise)."""
    a = F.radians(degrees)
    c, s = F.abs(F.cos(a)), F.abs(F.sin(a))
    up = lambda x: F.ceil(F.round(x, 6)).cast("long")
    return up(w * c + h * s), up(w * s + h * c)


def full_turns(degrees: float) -> float:
    return math.fmod(degrees, 360.0)
