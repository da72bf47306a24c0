"""Deterministic inputs derived from the given tables: positions for vectors, info strings, slides, hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import captions
from tessera.operators.knn import knn
from tessera.session import read

#: Two levels a slide of 100 vectors: level 1 (fine) is a 10 x 8 grid, level 0 a 5 x 4 grid. Runs in Spark and DuckDB.
PATCHES = """
SELECT vec_id, embedding, label,
  CAST(floor(vec_id/100) AS BIGINT) AS slide_no,
  CAST(CASE WHEN vec_id%100 < 80 THEN 1 ELSE 0 END AS INT) AS level,
  CAST(CASE WHEN vec_id%100 < 80 THEN vec_id%10 ELSE (vec_id%100-80)%5 END AS INT) AS gx,
  CAST(CASE WHEN vec_id%100 < 80 THEN floor((vec_id%100)/10) ELSE floor((vec_id%100-80)/5) END AS INT) AS gy,
  vec_id % 40 AS sub_id,
  CAST(CASE WHEN vec_id%7 = 0 THEN 0 ELSE 1 END AS INT) AS is_foreground
FROM embeddings
"""


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings")


def scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of different lengths, so that norms show."""
    return embeddings(spark, sf_dir).withColumn("embedding", F.transform("embedding", lambda x: (x * (1 + F.col("vec_id") % 3)).cast("float")))


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PATCHES.replace("FROM embeddings", "FROM {e}"), e=embeddings(spark, sf_dir))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 20: a query set that grows with the table."""
    return embeddings(spark, sf_dir).filter(F.col("vec_id") % 20 == 0)


def infos(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.col("slide_no").cast("string"), F.lit("_S"), F.col("slide_no").cast("string"), F.lit("_HE.svs"))
    size = F.lit(256)
    return patches(spark, sf_dir).select("vec_id", captions.info(name, F.col("gx") * 256, F.col("gy") * 256, size, size, F.col("level")).alias("info"))


INFOS = f"""
SELECT vec_id, concat(slide_no,'_S',slide_no,'_HE.svs_',gx*256,'_',gy*256,'_256_256_',level,'.png') AS info FROM ({PATCHES})
"""


def slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = patches(spark, sf_dir).select("slide_no").distinct()
    level = lambda n, w, h: F.struct(F.lit(n).alias("level"), F.lit(w).alias("width"), F.lit(h).alias("height"))
    return one.withColumn("levels", F.array(level(0, 1280, 1024), level(1, 2560, 2048)))


def hits(spark: SparkSession, sf_dir: str, k: int = 60) -> DataFrame:
    """The k nearest fine patches of the vectors asked, with positions."""
    p = patches(spark, sf_dir).filter("level = 1")
    found = knn(p, asked(spark, sf_dir), k, "cosine", exclude_self=True)
    return found.join(p.select(F.col("vec_id").alias("neighbor_id"), "slide_no", "level", "gx", "gy", "label", "sub_id", "embedding"), "neighbor_id").withColumn("score", F.round("score", 6))


HITS = f"""
SELECT * FROM (SELECT q.vec_id AS query_id, n.vec_id AS neighbor_id, n.slide_no, n.level, n.gx, n.gy, n.label, n.sub_id, n.embedding,
  round(list_cosine_similarity(q.embedding::DOUBLE[], n.embedding::DOUBLE[]), 6) AS score,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.embedding::DOUBLE[], n.embedding::DOUBLE[]) DESC, n.vec_id) AS rank
FROM (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q, ({PATCHES}) n WHERE n.level = 1 AND q.vec_id <> n.vec_id) WHERE rank <= 60
"""


def ranked_patients(spark: SparkSession, sf_dir: str, k: int = 60) -> DataFrame:
    """Hits of the vectors asked among all patches, with both sides' patient and label."""
    p = patches(spark, sf_dir)
    found = knn(p, asked(spark, sf_dir), k, "cosine", exclude_self=True)
    a = p.select(F.col("vec_id").alias("query_id"), F.col("sub_id").alias("q_sub"), F.col("label").alias("q_label"))
    b = p.select(F.col("vec_id").alias("neighbor_id"), F.col("sub_id").alias("n_sub"), F.col("label").alias("n_label"))
    return found.join(a, "query_id").join(b, "neighbor_id").withColumn("relevant", F.col("q_label") == F.col("n_label"))


RANKED = f"""
SELECT *, q_label = n_label AS relevant FROM (SELECT q.vec_id AS query_id, n.vec_id AS neighbor_id, q.sub_id AS q_sub, n.sub_id AS n_sub, q.label AS q_label, n.label AS n_label,
  list_cosine_similarity(q.embedding::DOUBLE[], n.embedding::DOUBLE[]) AS score,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.embedding::DOUBLE[], n.embedding::DOUBLE[]) DESC, n.vec_id) AS rank
FROM (SELECT * FROM ({PATCHES}) WHERE vec_id % 20 = 0) q, ({PATCHES}) n WHERE q.vec_id <> n.vec_id) WHERE rank <= 60
"""

WALK = f"""
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS r FROM
 (SELECT *, row_number() OVER (PARTITION BY query_id, n_sub ORDER BY rank) AS f FROM ({RANKED}) WHERE n_sub <> q_sub) WHERE f = 1
"""
