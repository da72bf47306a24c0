"""Files and folders as tables, tolerant JSON, matrices, and sinks of index tables."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_BINARY = "path string, modificationTime timestamp, length long, content binary"


def listing(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path, folder, name, length of every file below root. Contents are pruned from the scan."""
    files = spark.read.format("binaryFile").schema(_BINARY).option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return files.select("path", F.regexp_replace("path", "/[^/]*$", "").alias("folder"), F.element_at(F.split("path", "/"), -1).alias("name"), "length")


def with_prefix(files: DataFrame, prefix: str) -> DataFrame:
    """Files whose name starts so, in lexicographic order (batch_10 before batch_2)."""
    return files.filter(F.startswith("name", F.lit(prefix))).orderBy("name")


def leaf_folders(files: DataFrame) -> DataFrame:
    """folder: those that hold files and no folder that does."""
    folders = files.select("folder").distinct()
    parents = folders.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("folder", "/")) - 1), lambda n: F.array_join(F.slice(F.split("folder", "/"), 1, n), "/"))).alias("folder")).distinct()
    return folders.join(parents, "folder", "left_anti")


def slides(files: DataFrame, least: int = 50 << 20, cap: int = 50) -> DataFrame:
    """The first large slide file of each folder, at most ``cap`` for each folder above it."""
    ok = files.filter(F.lower("name").rlike(r"\.(svs|tiff)$") & (F.col("length") > least))
    first = ok.withColumn("_n", F.row_number().over(Window.partitionBy("folder").orderBy("name"))).filter("_n = 1")
    above = F.regexp_replace("folder", "/[^/]*$", "")
    return first.withColumn("cohort", above).withColumn("_n", F.row_number().over(Window.partitionBy("cohort").orderBy("path"))).filter(F.col("_n") <= cap).drop("_n")


def json_list(spark: SparkSession, path: str, element: str = "string") -> DataFrame:
    """pos, value, path of JSON arrays, a file each; missing or corrupt files give no rows."""
    from pyspark.errors import AnalysisException

    try:
        texts = spark.read.option("wholetext", "true").text(path).select("value", F.col("_metadata.file_path").alias("path"))
    except AnalysisException:
        return spark.createDataFrame([], f"pos int, value {element}, path string")
    return texts.select("path", F.posexplode(F.from_json("value", f"array<{element}>")).alias("pos", "value")).select("pos", "value", "path")


def text_samples(spark: SparkSession, path: str, arity: int) -> DataFrame:
    """texts of JSON lines (gzip too): a list, {texts}, or {context, response} as [response, context]; another arity is an error."""
    lines = spark.read.text(path)
    plain = F.from_json("value", "array<string>")
    keyed = F.from_json("value", "struct<texts: array<string>, context: string, response: string>")
    pair = F.when(keyed["context"].isNotNull() & keyed["response"].isNotNull(), F.array(keyed["response"], keyed["context"]))
    rows = lines.select(F.when(F.startswith(F.ltrim("value"), F.lit("[")), plain).otherwise(F.coalesce(keyed["texts"], pair)).alias("texts")).filter("texts is not null")
    return rows.withColumn("texts", F.when(F.size("texts") == arity, F.col("texts")).otherwise(F.raise_error(F.lit(f"a sample has not {arity} texts"))))


def matrices(spark: SparkSession, path: str, rows: int = 4096) -> DataFrame:
    """path, row, embedding of .npy files."""
    files = spark.read.format("binaryFile").schema(_BINARY).option("pathGlobFilter", "*.npy").option("recursiveFileLookup", "true").load(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                m = np.load(io.BytesIO(content), allow_pickle=False).astype(np.float32)
                for lo in range(0, len(m), rows):
                    part = m[lo : lo + rows]
                    yield pd.DataFrame({"path": p, "row": np.arange(lo, lo + len(part)), "embedding": list(part)})

    return files.select("path", "content").mapInPandas(run, "path string, row long, embedding array<float>")


def is_matrix(content):
    """Whether bytes begin as a .npy file does."""
    return F.substring(content, 1, 6) == F.unhex(F.lit("934E554D5059"))


def write_index(spark: SparkSession, path: str, **tables: DataFrame) -> None:
    """The tables of an index (nodes, edges, cells, params ..), each as Parquet below path."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_index(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True, escape='"', multiLine=True)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV files with a header, without an index column."""
    df.write.mode("overwrite").csv(path, header=True, escape='"')


def write_json(df: DataFrame, path: str, by: str | None = None) -> None:
    """JSON lines, in a folder for each value of ``by``."""
    out = df.write.mode("overwrite")
    (out.partitionBy(by) if by else out).json(path)


def write_matrices(df: DataFrame, path: str, order: str, vector: str = "embedding") -> DataFrame:
    """file, rows: the vectors as .npy files below path, a file for each partition in the given order inside it.

    Files are named by partition and put in place by a rename, so a repeated task writes the same files again.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [np.stack([np.asarray(v, np.float32) for v in pdf[vector]]) for pdf in batches if len(pdf)]
        if parts:
            name = f"{path}/part-{TaskContext.get().partitionId():06d}.npy"
            out = io.BytesIO()
            np.save(out, np.concatenate(parts))
            fs, at = pafs.FileSystem.from_uri(name) if "://" in name else (pafs.LocalFileSystem(), name)
            fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
            with fs.open_output_stream(f"{at}.part", compression=None) as f:
                f.write(out.getvalue())
            fs.move(f"{at}.part", at)
            yield pd.DataFrame({"file": [name], "rows": [sum(map(len, parts))]})

    return df.sortWithinPartitions(order).select(vector).mapInPandas(run, "file string, rows long")


def sampled_index(nodes: DataFrame, edges: DataFrame, n: int = 1000, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): n nodes of each level, those of smallest seeded hash, and the edges between them."""
    w = Window.partitionBy("level").orderBy(F.md5(F.concat_ws(":", "node", F.lit(seed))), "node")
    some = nodes.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")
    inside = some.select("node")
    kept = edges.join(inside.withColumnRenamed("node", "src"), "src", "left_semi").join(inside.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return some, kept


def folders_with_prefix(files: DataFrame, prefix: str) -> DataFrame:
    """The folders among the files' own whose name starts so, in lexicographic order."""
    return files.select("folder").distinct().filter(F.startswith(F.element_at(F.split("folder", "/"), -1), F.lit(prefix))).orderBy("folder")


def tile_histogram(files: DataFrame) -> DataFrame:
    """folder, n: how many files each folder holds."""
    return files.groupBy("folder").agg(F.count("*").alias("n"))


def ensured_json_list(spark: SparkSession, path: str, element: str = "string") -> DataFrame:
    """json_list() of one file, which is written as an empty list if it is missing."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        out = fs.create(hadoop)
        out.write(bytearray(b"[]"))
        out.close()
    return json_list(spark, path, element)
