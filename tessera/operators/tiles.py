"""Tile grids and tile geometry."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _steps(last: Column, step: Column) -> Column:
    """0, step, 2 step, .. up to last; nothing if last is negative."""
    return F.when(last >= 0, F.sequence(F.lit(0), last, step)).otherwise(F.array().cast("array<int>"))


def _as_int(c: Column | int) -> Column:
    return F.lit(c).cast("int") if isinstance(c, int) else c.cast("int")


def tile_grid(slides: DataFrame, size: int = 256, first_level: int = 0) -> DataFrame:
    """A row for each tile of each level of slides(wsi_name, levels array<struct<level, width, height>>); edge tiles are kept."""
    one = slides.withColumn("_l", F.explode("levels")).filter(F.col("_l.level") >= first_level)
    s = F.lit(size)
    rows = one.withColumn("y", F.explode(_steps(F.col("_l.height").cast("int") - 1, s))).withColumn("x", F.explode(_steps(F.col("_l.width").cast("int") - 1, s)))
    return rows.select(*[c for c in slides.columns if c != "levels"], F.col("_l.level").alias("level"), "x", "y", F.lit(size).alias("w"), F.lit(size).alias("h"))


def scanned(grid: DataFrame, patches: DataFrame, keys: Sequence[str] = ("slide_no", "level")) -> DataFrame:
    """The tiles of grid(keys, x, y, w, h) that patches(keys, gx, gy) have, each as often as they have it."""
    at = patches.select(*keys, F.col("gx").alias("_gx"), F.col("gy").alias("_gy"))
    places = grid.withColumn("_gx", F.floor(F.col("x") / F.col("w")).cast("int")).withColumn("_gy", F.floor(F.col("y") / F.col("h")).cast("int"))
    return places.join(at, [*keys, "_gx", "_gy"]).drop("_gx", "_gy").select(*grid.columns)


def whole_tiles(images: DataFrame, size: int = 224) -> DataFrame:
    """Tiles that do not overlap; partial ones are dropped. images: width, height and other columns."""
    s = F.lit(size)
    rows = images.withColumn("x", F.explode(_steps(_as_int(F.col("width")) - size, s))).withColumn("y", F.explode(_steps(_as_int(F.col("height")) - size, s)))
    return rows.withColumn("w", s).withColumn("h", s)


def mesh_step(width: Column, size: int = 224) -> Column:
    """Step of overlapping tiles that end at the image's edge; the tile size for images no wider than a tile."""
    n = F.floor(width / size)
    return F.when(width <= size, F.lit(size)).otherwise(size - F.floor((size - F.pmod(width, F.lit(size))) / n)).cast("int")


def mesh_tiles(images: DataFrame, size: int = 224) -> DataFrame:
    """Overlapping tiles, with the step fitted to each image's width and height."""
    rows = images
    for name, side in (("x", "width"), ("y", "height")):
        rows = rows.withColumn(name, F.explode(_steps(_as_int(F.col(side)) - size, mesh_step(F.col(side), size))))
    return rows.withColumn("w", F.lit(size)).withColumn("h", F.lit(size))


def square_tiles(images: DataFrame) -> DataFrame:
    """Squares with the image's shorter side; the last may run past the edge."""
    side = F.least("width", "height").cast("int")
    rows = images.withColumn("w", side).withColumn("h", side)
    for name, length in (("x", "width"), ("y", "height")):
        rows = rows.withColumn(name, F.explode(_steps(_as_int(F.col(length)) - 1, F.col("w"))))
    return rows


def in_window(x: Column, y: Column, left: Column | int, top: Column | int, w: Column | int, h: Column | int) -> Column:
    """Half-open range filter."""
    return (x >= left) & (x < left + w) & (y >= top) & (y < top + h)


def reshaped(x: Column, y: Column, w: Column, h: Column, ratio: Column) -> tuple[Column, Column, Column, Column]:
    """A region of the same area and centre with the given aspect, moved into the positive quadrant."""
    width = F.floor(F.sqrt((w * h).cast("double") * ratio)).cast("long")
    height = F.floor(width / ratio).cast("long")
    zero = F.lit(0).cast("long")
    left = F.greatest(F.floor(x + F.floor(w / 2) - F.floor(width / 2)).cast("long"), zero)
    top = F.greatest(F.floor(y + F.floor(h / 2) - F.floor(height / 2)).cast("long"), zero)
    return left, top, width, height


def lookup_site(rows: DataFrame, code: str, sites: dict[str, list[str]], default: str = "Others") -> DataFrame:
    """rows with the first site, in the given order, that lists the code. The table has an entry for each listed code."""
    known: dict[str, str] = {}
    for site, codes in sites.items():
        for c in codes:
            known.setdefault(c, site)
    pairs = [x for k, v in known.items() for x in (F.lit(k), F.lit(v))]
    return rows.withColumn("site", F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(code)), F.lit(default)))


def bright_share(pixels: Column, limit: int = 240) -> Column:
    """Share of pixel values at or above a limit."""
    return F.size(F.filter(pixels, lambda p: p >= limit)) / F.size(pixels)


def otsu(histogram: DataFrame) -> DataFrame:
    """The threshold of a grey histogram (image_id, value, n) that parts it with most variance between the classes."""
    up = Window.partitionBy("image_id").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy("image_id")
    h = histogram.withColumn("_w0", F.sum("n").over(up)).withColumn("_s0", F.sum(F.col("n") * F.col("value")).over(up))
    h = h.withColumn("_w", F.sum("n").over(every)).withColumn("_s", F.sum(F.col("n") * F.col("value")).over(every))
    w1 = F.col("_w") - F.col("_w0")
    apart = F.when(w1 > 0, F.col("_w0") * w1 * F.pow(F.col("_s0") / F.col("_w0") - (F.col("_s") - F.col("_s0")) / w1, F.lit(2.0))).otherwise(F.lit(0.0))
    return h.groupBy("image_id").agg(F.max_by("value", F.struct(apart.alias("v"), (-F.col("value")).alias("o"))).alias("threshold"))


def tissue_share(histogram: DataFrame) -> DataFrame:
    """image_id, threshold, share of pixels above Otsu's threshold, and whether that is over a tenth."""
    t = otsu(histogram)
    share = F.sum(F.when(F.col("value") > F.col("threshold"), F.col("n")).otherwise(F.lit(0))) / F.sum("n")
    return histogram.join(t, "image_id").groupBy("image_id", "threshold").agg(share.alias("share")).withColumn("is_tissue", F.col("share") > 0.1)


def sampled_crops(levels: DataFrame, accepted: Callable[[DataFrame], DataFrame], keys: Sequence[str], kept: int = 3, tries: int = 100, last: int = 448, other: int = 1120, seed: int = 0) -> DataFrame:
    """keys, try, x, y, side: the first ``kept`` of at most ``tries`` random crops of a level that ``accepted`` lets pass.

    levels: keys, width, height, is_last. Crops lie inside the level; their side is ``last`` on the last level, else
    ``other``. A level smaller than its crop has none.
    """
    side = F.when(F.col("is_last"), F.lit(last)).otherwise(F.lit(other))
    draw = lambda name, room: F.conv(F.substring(F.md5(F.concat_ws(":", *keys, "try", F.lit(name), F.lit(seed))), 1, 8), 16, 10).cast("long") % (room + 1)
    tried = levels.withColumn("side", side).filter((F.col("width") >= F.col("side")) & (F.col("height") >= F.col("side")))
    tried = tried.withColumn("try", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))))
    tried = tried.withColumn("x", draw("x", F.col("width") - F.col("side"))).withColumn("y", draw("y", F.col("height") - F.col("side")))
    first = Window.partitionBy(*keys).orderBy("try")
    return accepted(tried).withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= kept).select(*keys, "try", "x", "y", "side")
