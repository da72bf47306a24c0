"""The service's requests as functions over DataFrames: search, batch search and region search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import captions
from tessera.operators import knn, regions

DEFAULT_TOP_K = 20


def top_k(value: object, default: int = DEFAULT_TOP_K) -> int:
    """A request's k: the default unless it is a positive whole number."""
    try:
        k = int(value)
    except (TypeError, ValueError):
        return default
    return k if k > 0 else default


def formatted(hits: DataFrame, infos: DataFrame) -> DataFrame:
    """hits with their parsed info strings. Malformed ones go after ranking, so their ranks stay empty."""
    rows = hits.join(infos.select(F.col("vec_id").alias("neighbor_id"), "info"), "neighbor_id")
    parsed = captions.parse_info(F.col("info"))
    return rows.filter(captions.is_complete(parsed)).select(*hits.columns, "info", *[c.alias(n) for n, c in parsed.items()])


def batch_search(corpus: DataFrame, infos: DataFrame, queries: DataFrame, k: object = None, metric: str = "cosine") -> DataFrame:
    """Ranked, parsed hits of every query, each under its own query_id."""
    return formatted(knn.knn(corpus, queries, top_k(k), metric), infos)


def search(corpus: DataFrame, infos: DataFrame, query: DataFrame, k: object = None, metric: str = "cosine") -> tuple[DataFrame, DataFrame]:
    """(hits, connected regions of more than one tile with their tiles)."""
    hits = batch_search(corpus, infos, query, k, metric)
    joined = regions.connected(hits.withColumn("patch_id", F.col("neighbor_id")), ["query_id", "wsi_name", "level"], x="x", y="y", w=256, h=256, singletons=False)
    tile = F.struct("rank", "x", "y", "w", "h", "score")
    told = joined.groupBy("query_id", "wsi_name", "level", "region_id").agg(F.count("*").alias("tile_count"), F.sort_array(F.collect_list(tile)).alias("tiles"))  # at most k tiles
    return hits, told


def as_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct("*")).alias("value"))


def region_search(corpus: DataFrame, tiles: DataFrame, queries: DataFrame, k: object = None) -> DataFrame:
    """Scored boxes of the connected regions of each query's hits, best first.

    tiles: vec_id, slide_no, level, gx, gy.
    """
    hits = knn.knn(corpus, queries, top_k(k, 50), "cosine")
    placed = hits.join(tiles.select(F.col("vec_id").alias("neighbor_id"), "slide_no", "level", "gx", "gy"), "neighbor_id")
    joined = regions.connected(placed, ["query_id", "slide_no", "level"], "neighbor_id")
    return regions.region_boxes(joined, ["query_id", "slide_no", "level"]).orderBy("query_id", F.desc("score"))
