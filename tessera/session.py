"""Session helpers shared by every part of the engine."""

from __future__ import annotations

import ctypes
import os
import re
import shutil
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

_shipped: "weakref.WeakSet" = weakref.WeakSet()


def local_session(cores: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tessera")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per Spark context, so that Python operators can import it there."""
    sc = spark.sparkContext
    if sc in _shipped:
        return
    _shipped.add(sc)
    root = Path(__file__).resolve().parent.parent
    base = tempfile.mkdtemp(prefix="tessera-")
    stage = os.path.join(base, "stage")
    shutil.copytree(root / "tessera", os.path.join(stage, "tessera"), ignore=shutil.ignore_patterns("__pycache__"))
    if (root / "corpus_pipeline.py").exists():
        shutil.copy(root / "corpus_pipeline.py", stage)
    sc.addPyFile(shutil.make_archive(os.path.join(base, "tessera_package"), "zip", stage))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def folder(spark: SparkSession) -> str:
    """The folder of this application that driver and executors share: in spark.checkpoint.dir.

    On one machine, as in tests, a temporary folder is set where the session names none; a cluster must name one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints", "tessera")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/tessera-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """Filesystem and path of a URI in the shared folder, from any process."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), re.sub("^file:/*", "/", uri)
    return pafs.FileSystem.from_uri(uri)


def store(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and a lost executor costs no rerun before it."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.stored_at = path
    return back


def lean(run: Callable) -> Callable:
    """run, for mapInArrow, with what a task has freed given back to the system when it ends.

    Workers live on between tasks, and without this each keeps the most that it ever held, for all later stages.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
            if trim:
                trim(0)

    return whole


def remove(*stored: DataFrame) -> None:
    """Delete tables of store() that nothing reads any more."""
    for df in stored:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
