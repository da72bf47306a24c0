"""Relational tables as text nodes, script runners and catalogue scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.ids import uuid5


def catalogue(spark: SparkSession, database: str | None = None) -> DataFrame:
    """table_name, column_name, data_type of every table of the session's catalogue."""
    rows = [(t.name, c.name, c.dataType) for t in spark.catalog.listTables(database) for c in spark.catalog.listColumns(t.name)]
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string")


def text_nodes(table: DataFrame, name: str) -> DataFrame:
    """node_id, text, metadata, table_name: each row as JSON text, with a name-based id."""
    text = F.to_json(F.struct(*[F.col(c) for c in table.columns]), {"ignoreNullFields": "false"})
    rows = table.select(text.alias("text"))
    return rows.select(uuid5(F.concat(F.lit(f"{name}:"), F.col("text"))).alias("node_id"), "text", F.col("text").alias("metadata"), F.lit(name).alias("table_name"))


def run_script(spark: SparkSession, script: str) -> int:
    """Run the statements of a script, split at semicolons; how many there were."""
    parts = [s.strip() for s in script.split(";") if s.strip()]
    for s in parts:
        spark.sql(s)
    return len(parts)


def run_lines(spark: SparkSession, script: str) -> int:
    """Run one statement a line, with the sentinel date 0001-01-01 written as 1970-01-01."""
    lines = [s.strip().rstrip(";").replace("0001-01-01", "1970-01-01") for s in script.splitlines() if s.strip()]
    for s in lines:
        spark.sql(s)
    return len(lines)


def jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table over JDBC; secrets come as options from the caller's configuration."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
