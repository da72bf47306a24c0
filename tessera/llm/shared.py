"""Tables in the folder that the driver and all executors share, and grouping that survives hot keys."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import folder, lean, new_path, open_fs, remove, store  # noqa: F401


def local_path(uri: str) -> str | None:
    """A path that can be memory-mapped, if the shared folder is mounted."""
    return re.sub("^file:/*", "/", uri) if uri.startswith("file:") else uri if "://" not in uri else None


def write_file(uri: str, data) -> None:
    """Write a whole file by a temporary name, so that readers never see part of it and a retried task may repeat it."""
    fs, path = open_fs(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(part, compression=None) as out:
        out.write(data)
    fs.move(part, path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def by_group(df: DataFrame, key: str, salt: Column, salts: int, aggregates: dict[str, tuple[Column, callable]]) -> DataFrame:
    """df with, on every row, aggregates over all rows of its key; no task sees a whole hot key.

    aggregates: name -> (partial aggregate over df, function of the partial's column that merges partials).
    Rows are counted by (key, salt) first, so a key has at most ``salts`` partial rows; merged values return to those
    and from there to the rows, by (key, salt).
    """
    salted = df.withColumn("_salt", F.pmod(salt, F.lit(salts)).cast("int"))
    partial = salted.groupBy(key, "_salt").agg(*[a.alias(n) for n, (a, _) in aggregates.items()])
    whole = partial.groupBy(key).agg(*[merge(F.col(n)).alias(n) for n, (_, merge) in aggregates.items()])
    spread = partial.select(key, "_salt").join(whole, key)
    return salted.join(spread, [key, "_salt"], "left").drop("_salt")


#: Bits of a monotonically increasing id that are the place inside its partition.
_PLACE = 33
_SLICE = 1024


def repeated(numbered: DataFrame, row: str, counts: DataFrame, otherwise: int, then: Callable | None = None, schema: str | None = None) -> DataFrame:
    """numbered without the column ``row``, every row as often as counts(row, n) tells, or ``otherwise`` where they don't.

    numbered is a table of store() whose ``row`` is a monotonically increasing id, so its high bits are the partition that
    wrote the row. Only the counts are dealt out, to a folder for each such partition; the task that reads rows of a
    partition reads its counts, and the rows themselves, with their texts, are neither shuffled nor sorted.

    then, schema: a function for mapInArrow that gets these rows in the same worker; a second mapInArrow in the stage
    would double the workers of an executor and send the texts through the JVM once more.
    """
    path = new_path(numbered.sparkSession, "counts")
    told = counts.select(F.col(row).alias("row"), F.col("n").cast("long").alias("n")).withColumn("part", F.shiftrightunsigned("row", _PLACE))
    told.repartition("part").write.partitionBy("part").parquet(path)
    out = numbered.drop(row)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(row).to_numpy()
            n = np.full(len(at), otherwise, np.int64)
            for part in np.unique(at >> _PLACE).tolist():
                rows, times = _counts_of(path, part)
                if len(rows):
                    mine = np.flatnonzero(at >> _PLACE == part)
                    i = np.minimum(np.searchsorted(rows, at[mine]), len(rows) - 1)
                    there = rows[i] == at[mine]
                    n[mine[there]] = times[i[there]]
            batch = batch.drop_columns([row])
            for lo in range(0, len(at), _SLICE):
                own = n[lo : lo + _SLICE]
                if not own.any():
                    continue
                yield batch.slice(lo, _SLICE).take(pa.array(np.repeat(np.arange(len(own)), own)))

    whole = (lambda batches: then(run(batches))) if then else run
    return numbered.select(*out.columns, row).mapInArrow(lean(whole), schema or out.schema)


@lru_cache(maxsize=2)
def _counts_of(path: str, part: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted rows and their numbers that repeated() has written for a partition."""
    fs, folder = open_fs(f"{path}/part={part}")
    rows, times = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for file in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)):
        if file.path.endswith(".parquet"):
            with fs.open_input_file(file.path) as source:
                got = pq.ParquetFile(source).read(["row", "n"])
            rows.append(got["row"].to_numpy())
            times.append(got["n"].to_numpy())
    rows, times = np.concatenate(rows), np.concatenate(times)
    order = np.argsort(rows)
    return rows[order], times[order]
