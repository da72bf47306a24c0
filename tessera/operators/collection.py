"""A vector collection: versioned Parquet below one folder, with a pointer to the current version.

Writes go to a new version first; only then does the pointer move, so readers see whole versions and a failed write
leaves the old one in place.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.knn import METRICS, knn, numbered_rows


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """One row for each key: the last under the order."""
    w = Window.partitionBy(key).orderBy(*[F.desc(o) for o in order])
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def upserted(current: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """current with changes written over it by key: the highest version stays, and of equals the change.

    Only rows whose key occurs among the changes are compared; the rest passes by an anti-join.
    """
    new = latest(changes, key, version)
    untouched = current.join(new.select(key), key, "left_anti")
    old = current.join(new.select(key), key, "left_semi").withColumn("_from", F.lit(0))
    both = old.unionByName(new.withColumn("_from", F.lit(1)), allowMissingColumns=True)
    return untouched.unionByName(latest(both, key, version, "_from").drop("_from"), allowMissingColumns=True)


def scrolled(rows: DataFrame, key: str, limit: int, after: int | None = None) -> DataFrame:
    """The next page in key order after a cursor."""
    page = rows if after is None else rows.filter(F.col(key) > after)
    return page.orderBy(key).limit(limit)


def without_known(rows: DataFrame, known: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """rows whose key is not known yet."""
    return rows.join(known.select(*([key] if isinstance(key, str) else key)).distinct(), key, "left_anti")


class Collection:
    """A named collection of rows (id, vector, payload columns)."""

    def __init__(self, spark: SparkSession, root: str, name: str):
        self.spark, self.path = spark, f"{root.rstrip('/')}/{name}"

    # The pointer and the settings are one-row text tables, so that any store Spark reads will do.
    def _note(self, what: str, value: dict) -> None:
        self.spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/{what}")

    def _noted(self, what: str) -> dict | None:
        from pyspark.errors import AnalysisException

        try:
            row = self.spark.read.text(f"{self.path}/{what}").first()
        except AnalysisException:
            return None
        return json.loads(row[0]) if row else None

    def exists(self) -> bool:
        return self._noted("settings") is not None

    def create(self, size: int, metric: str = "cosine", payload: str = "") -> None:
        if metric not in METRICS:
            raise ValueError(f"metric is {metric!r}")
        if self.exists():
            raise ValueError(f"{self.path} exists")
        schema = "id long, vector array<float>" + (f", {payload}" if payload else "")
        self._note("settings", {"size": size, "metric": metric})
        self._write(self.spark.createDataFrame([], schema), 0)

    def settings(self) -> dict:
        found = self._noted("settings")
        if found is None:
            raise ValueError(f"{self.path} is not a collection")
        return found | {"version": self._version()}

    def _version(self) -> int:
        """The newest whole version: a write ends with its mark, and a mark is never changed."""
        fs, path = _store(self.spark, self.path)
        told = [x.getPath() for x in fs.listStatus(path) if x.getPath().getName().startswith("version=")]
        whole = [int(p.getName().split("=")[1]) for p in told if fs.exists(_child(self.spark, p, "_SUCCESS"))]
        if not whole:
            raise ValueError(f"{self.path} has no whole version")
        return max(whole)

    def _write(self, rows: DataFrame, version: int) -> None:
        """Write a version, of which readers see nothing before its mark is there; that before the last goes."""
        rows.write.mode("errorifexists").parquet(f"{self.path}/version={version}")
        fs, path = _store(self.spark, f"{self.path}/version={version - 2}")
        fs.delete(path, True)

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/version={self.settings()['version']}")

    def upsert(self, changes: DataFrame) -> None:
        s = self.settings()
        wrong = F.size("vector") != s["size"]
        checked = changes.withColumn("vector", F.when(wrong, F.raise_error(F.lit("a vector has the wrong size"))).otherwise(F.col("vector").cast("array<float>")))
        merged = upserted(self.rows().withColumn("_v", F.lit(0)), checked.withColumn("_v", F.lit(1)), "id", "_v").drop("_v")
        self._write(merged, s["version"] + 1)

    def delete(self, where: Column) -> None:
        s = self.settings()
        self._write(self.rows().filter(~F.coalesce(where, F.lit(False))), s["version"] + 1)

    def insert(self, rows: DataFrame) -> None:
        """Append rows under ids of their own, above those there are; columns that the collection lacks are added to it."""
        s = self.settings()
        top = self.rows().agg(F.max("id")).first()[0]
        numbered = numbered_rows(rows.withColumn("_k", F.xxhash64(*rows.columns)), "_k").withColumn("id", F.col("_row") + F.lit(0 if top is None else top + 1))
        wrong = F.size("vector") != s["size"]
        checked = numbered.drop("_k", "_row").withColumn("vector", F.when(wrong, F.raise_error(F.lit("a vector has the wrong size"))).otherwise(F.col("vector").cast("array<float>")))
        self._write(self.rows().unionByName(checked, allowMissingColumns=True), s["version"] + 1)

    def stats(self) -> dict:
        """Settings, rows, columns and version."""
        rows = self.rows()
        return self.settings() | {"rows": rows.count(), "columns": rows.columns}

    def count(self, where: Column | None = None) -> int:
        return (self.rows() if where is None else self.rows().filter(where)).count()

    def scroll(self, limit: int, after: int | None = None) -> tuple[DataFrame, int | None]:
        """(page, cursor of the next page or None)."""
        page = scrolled(self.rows(), "id", limit, after)
        end = page.agg(F.max("id"), F.count("*")).first()
        return page, end[0] if end[1] == limit else None

    def query(self, where: Column, fields: Sequence[str] = ("id",)) -> DataFrame:
        return self.rows().filter(where).select(*fields)

    def search(self, queries: DataFrame, k: int, *, where: Column | None = None, threshold: float | None = None, fields: Sequence[str] = ()) -> DataFrame:
        """query_id, rank, id, score and payload fields; the filter and threshold hold before the cut."""
        rows = self.rows()
        hits = knn(rows, queries.select("id", "vector"), k, self.settings()["metric"], id="id", vector="vector", where=where, threshold=threshold)
        hits = hits.withColumnRenamed("neighbor_id", "id")
        return hits.join(rows.select("id", *fields), "id").select("query_id", "rank", "id", "score", *fields) if fields else hits

    def copy_to(self, other: Collection, limit: int) -> None:
        other.upsert(scrolled(self.rows(), "id", limit))


def _store(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _child(spark: SparkSession, parent, name: str):
    return spark._jvm.org.apache.hadoop.fs.Path(parent, name)


def collections(spark: SparkSession, root: str) -> list[str]:
    """The names of the collections below root."""
    fs, path = _store(spark, root)
    found = [x.getPath().getName() for x in fs.listStatus(path) if x.isDirectory()] if fs.exists(path) else []
    return sorted(n for n in found if Collection(spark, root, n).exists())
