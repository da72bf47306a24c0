"""Region algebra: adjacency of tiles, connected regions, boxes, scores, similarity and query windows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.vector import aspect_penalty, cosine
from tessera.operators.components import UnionFind, connected_components

OFFSETS = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy]


def adjacency(tiles: DataFrame, keys: Sequence[str], node: str = "patch_id", x: str = "gx", y: str = "gy", w: str | int = 1, h: str | int = 1) -> DataFrame:
    """keys, src, dst: ordered pairs of tiles of one group that lie at one of the eight offsets (+-w, +-h).

    Offsets are those of src's own size, so the relation is one-sided where sizes differ. A theta join over all pairs
    becomes an equi-join: each tile is looked up at its eight neighbours' places.
    """
    size = lambda s: F.col(s) if isinstance(s, str) else F.lit(s)
    at = F.explode(F.array(*[F.struct((F.col(x) + dx * size(w)).alias("x"), (F.col(y) + dy * size(h)).alias("y")) for dx, dy in OFFSETS]))
    near = tiles.select(*keys, F.col(node).alias("src"), at.alias("_at")).select(*keys, "src", F.col("_at.x").alias("_x"), F.col("_at.y").alias("_y"))
    there = tiles.select(*keys, F.col(node).alias("dst"), F.col(x).alias("_x"), F.col(y).alias("_y"))
    return near.join(there, [*keys, "_x", "_y"]).select(*keys, "src", "dst")


def touching(rects: DataFrame, keys: Sequence[str], node: str = "patch_id") -> DataFrame:
    """keys, src, dst: ordered pairs of rectangles (x, y, w, h) that share an edge with positive overlap; corners do not count."""
    a = rects.select(*keys, F.col(node).alias("src"), *[F.col(c).alias(f"a{c}") for c in "xywh"])
    b = rects.select(*keys, F.col(node).alias("dst"), *[F.col(c).alias(f"b{c}") for c in "xywh"])
    over_y = (F.col("ay") < F.col("by") + F.col("bh")) & (F.col("by") < F.col("ay") + F.col("ah"))
    over_x = (F.col("ax") < F.col("bx") + F.col("bw")) & (F.col("bx") < F.col("ax") + F.col("aw"))
    sides = [
        (F.col("ax") + F.col("aw"), F.col("bx"), over_y), (F.col("ax"), F.col("bx") + F.col("bw"), over_y),
        (F.col("ay") + F.col("ah"), F.col("by"), over_x), (F.col("ay"), F.col("by") + F.col("bh"), over_x),
    ]
    out = None
    for mine, theirs, overlap in sides:
        one = a.withColumn("_edge", mine).join(b.withColumn("_edge", theirs), [*keys, "_edge"]).filter(overlap & (F.col("src") != F.col("dst"))).select(*keys, "src", "dst")
        out = one if out is None else out.unionByName(one)
    return out.distinct()


def _grid_labels(pdf: pd.DataFrame, node: str, x: str, y: str, w: int, h: int) -> np.ndarray:
    """Component of each row: the smallest node it is connected to. Rows at one place are joined only through neighbours."""
    pdf = pdf.reset_index(drop=True)
    order = np.argsort(pdf[node].to_numpy(), kind="stable")
    at: dict[tuple, list[int]] = {}
    for rank, i in enumerate(order):
        at.setdefault((int(pdf[x][i]), int(pdf[y][i])), []).append(rank)
    sets = UnionFind(len(pdf))
    for (px, py), mine in at.items():
        for dx, dy in OFFSETS:
            for j in at.get((px + dx * w, py + dy * h), ()):
                for i in mine:
                    sets.union(i, j)
    nodes = pdf[node].to_numpy()[order]
    out = np.empty(len(pdf), nodes.dtype)
    for rank, i in enumerate(order):
        out[i] = nodes[sets.find(rank)]
    return out


def connected(hits: DataFrame, keys: Sequence[str], node: str = "patch_id", x: str = "gx", y: str = "gy", w: int = 1, h: int = 1, singletons: bool = True) -> DataFrame:
    """hits with region_id, the smallest node of the connected region.

    A group is one query's hits on one slide and level, so it is bounded by the search's k. For unbounded graphs use
    adjacency() with components.connected_components().
    """
    from pyspark.sql.types import LongType, StructField, StructType

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(region_id=_grid_labels(pdf, node, x, y, w, h))
        if not singletons:
            pdf = pdf[pdf.groupby("region_id")["region_id"].transform("size") > 1]
        return pdf

    schema = StructType([*hits.schema.fields, StructField("region_id", LongType())])
    return hits.groupBy(*keys).applyInPandas(label, schema)


def region_boxes(regions: DataFrame, keys: Sequence[str], score: str = "score", x: str = "gx", y: str = "gy") -> DataFrame:
    """keys, region_id, box, n_patches, score: the sum of similarities over the box's area in patches."""
    area = (F.max(x) - F.min(x) + 1) * (F.max(y) - F.min(y) + 1)
    return regions.groupBy(*keys, "region_id").agg(
        F.min(x).alias("x0"), F.min(y).alias("y0"), F.max(x).alias("x1"), F.max(y).alias("y1"), F.count("*").alias("n_patches"), (F.sum(score) / area).alias("score")
    )


def pixel_boxes(regions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, region_id, x, y, w, h around tiles x, y, w, h."""
    x1, y1 = F.max(F.col("x") + F.col("w")), F.max(F.col("y") + F.col("h"))
    return regions.groupBy(*keys, "region_id").agg(F.min("x").alias("x"), F.min("y").alias("y"), (x1 - F.min("x")).alias("w"), (y1 - F.min("y")).alias("h"), F.count("*").alias("n_patches"))


def first_seen_mode(rows: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    """keys, value: the most frequent value; of equals, the one seen first."""
    n = rows.groupBy(*keys, value).agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    return n.groupBy(*keys).agg(F.min_by(value, F.struct((-F.col("_n")).alias("n"), "_first")).alias(value))


def best_slide(hits: DataFrame, slide: str = "wsi_name", score: str = "score") -> DataFrame:
    """query_id, slide, total: the slide with the largest sum of scores; of equals, the one seen first."""
    s = hits.groupBy("query_id", slide).agg(F.round(F.sum(score), 6).alias("total"), F.min("rank").alias("_first"))
    top = F.min(F.struct((-F.col("total")).alias("t"), F.col("_first").alias("f"), F.col(slide).alias("s")))
    return s.groupBy("query_id").agg(top.alias("m")).select("query_id", F.col("m.s").alias(slide), (-F.col("m.t")).alias("total"))


def similarity(first: DataFrame, second: DataFrame) -> DataFrame:
    """pair_id, similarity of region pairs.

    first and second: pair_id, patch_id, gx, gy, embedding, and w, h of the region. Positions are shifted to 0 and scaled
    by the region's size; each patch of the first takes the nearest of the second (the smaller id on ties) if nearer
    than 0.5; the mean of their cosines is weighed by the aspect penalty. 0 if nothing matched.
    """

    def scaled(df: DataFrame, p: str) -> DataFrame:
        w = Window.partitionBy("pair_id")
        unit = lambda c, s: (F.col(c) - F.min(c).over(w)) / F.greatest(F.col(s).cast("double"), F.lit(1.0))
        return df.select("pair_id", F.col("patch_id").alias(f"{p}id"), unit("gx", "w").alias(f"{p}x"), unit("gy", "h").alias(f"{p}y"), F.col("w").alias(f"{p}w"), F.col("h").alias(f"{p}h"), F.col("embedding").alias(f"{p}v"))

    a, b = scaled(first, "a"), scaled(second, "b")
    apart = F.sqrt((F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2)
    pairs = a.join(b, "pair_id").withColumn("_d", F.round(apart, 9))  # patches of two regions of one pair: both are bounded windows
    near = pairs.withColumn("_n", F.row_number().over(Window.partitionBy("pair_id", "aid").orderBy("_d", "bid"))).filter("_n = 1")
    worth = F.avg(F.when(F.col("_d") < 0.5, cosine(F.col("av"), F.col("bv"))))
    return near.groupBy("pair_id").agg((F.coalesce(worth, F.lit(0.0)) * F.first(aspect_penalty(F.col("aw"), F.col("ah"), F.col("bw"), F.col("bh")))).alias("similarity"))


def full_windows(tiles: DataFrame, keys: Sequence[str], w: int, h: int, x: str = "gx", y: str = "gy") -> DataFrame:
    """keys, x, y of every w x h window whose tiles are all there. Each tile is counted for the w * h windows it is in."""
    inside = F.explode(F.array(*[F.struct((F.col(x) - i).alias("x"), (F.col(y) - j).alias("y")) for i in range(w) for j in range(h)]))
    starts = tiles.select(*keys, x, y).distinct().select(*keys, inside.alias("_s")).select(*keys, F.col("_s.x").alias("x"), F.col("_s.y").alias("y"))
    return starts.groupBy(*keys, "x", "y").agg(F.count("*").alias("_n")).filter(F.col("_n") == w * h).drop("_n")


def rerank(regions: DataFrame, queries: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """keys, region_id, score, rank: cosine of the query with the mean of the region's vectors (a stand-in for encoding its image anew)."""
    cells = regions.select(*keys, "region_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("_i", "_v"))
    means = cells.groupBy(*keys, "region_id", "_i").agg(F.avg("_v").alias("_v"))
    mean = F.transform(F.sort_array(F.collect_list(F.struct("_i", "_v"))), lambda c: c["_v"])
    region = means.groupBy(*keys, "region_id").agg(mean.alias("_mean"))
    q = queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("_q"))
    scored = region.join(q, "query_id").withColumn("score", F.round(cosine(F.col("_q"), F.col("_mean")), 6)).drop("_q", "_mean")
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "region_id")).cast("long"))


def touching_groups(rects: DataFrame, keys: Sequence[str], node: str = "patch_id") -> DataFrame:
    """rects with region_id: the smallest node of the group of rectangles that share edges; a rectangle alone is its own group.

    Groups may be of any size: the links go to the component search as a table.
    """
    found = connected_components(touching(rects, keys, node)).select(F.col("node").alias(node), F.col("component").alias("region_id"))
    return rects.join(found, node, "left").withColumn("region_id", F.coalesce("region_id", node))


def region_urls(boxes: DataFrame, head: str, slide_id: str, name: str, patch: int = 256) -> DataFrame:
    """boxes with label ({id}_{name}) and url (head/name/x/y/w/h/level) of their pixels."""
    x, y = F.col("x0") * patch, F.col("y0") * patch
    w, h = (F.col("x1") - F.col("x0") + 1) * patch, (F.col("y1") - F.col("y0") + 1) * patch
    return boxes.withColumn("label", F.concat_ws("_", slide_id, name)).withColumn("url", F.concat_ws("/", F.lit(head), F.col(name), x, y, w, h, "level"))


def tile_positions(tiles: DataFrame, index: str, columns: int) -> DataFrame:
    """tiles with row and column in an image that is cut into ``columns`` tiles a row, by their index."""
    return tiles.withColumn("row", F.floor(F.col(index) / columns)).withColumn("column", F.col(index) % columns)


def trials(windows: DataFrame, sizes: Sequence[tuple[int, int]], queries: int = 10, rounds: int = 10, seed: int = 0) -> DataFrame:
    """size, round, query and the window of each trial: for each size and round, the ``queries`` windows of smallest seeded hash.

    windows: w, h, and what names a window. The hash takes all columns, so draws do not depend on the order of rows.
    """
    of_size = None
    for w, h in sizes:
        one = windows.filter((F.col("w") == w) & (F.col("h") == h)).withColumn("size", F.lit(f"{w}x{h}"))
        of_size = one if of_size is None else of_size.unionByName(one)
    drawn = of_size.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    order = Window.partitionBy("size", "round").orderBy("_h", *windows.columns)
    text = F.concat_ws(":", *windows.columns, "round", F.lit(seed))
    drawn = drawn.withColumn("_h", F.md5(text)).withColumn("query", F.row_number().over(order)).filter(F.col("query") <= queries)
    return drawn.drop("_h")


def trial_report(scored: DataFrame, value: str) -> DataFrame:
    """size, mean, std (population) over rounds of the rounds' mean value, and rounds."""
    by_round = scored.groupBy("size", "round").agg(F.avg(value).alias("m"))
    return by_round.groupBy("size").agg(F.avg("m").alias("mean"), F.stddev_pop("m").alias("std"), F.count("*").alias("rounds"))
