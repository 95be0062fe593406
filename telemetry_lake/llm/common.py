"""Scratch tables in the shared folder, and the reading of a document column inside a task."""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telemetry_lake.session import scratch_dir

# Rows of one Arrow batch between the JVM and Python. A batch is held whole on both sides, so
# with texts of up to some 100,000 characters a thousand rows stay far below the worker's memory.
ARROW_ROWS = 1000
ARROW_BYTES = 16 << 20
# An executor keeps several Python workers beside its heap, also between stages. So that each gives back what a batch
# took, Arrow takes its memory where numpy does, arrays of 4 MB and more are mapped, and 16 MB at most stay free.
WORKERS = {
    "ARROW_DEFAULT_MEMORY_POOL": "system",
    "MALLOC_ARENA_MAX": "1",
    "MALLOC_MMAP_THRESHOLD_": str(4 << 20),
    "MALLOC_TRIM_THRESHOLD_": str(16 << 20),
}


def configure(spark: SparkSession) -> None:
    """Bound the Arrow batches and what a Python worker holds on to; everything else is left as the cluster has it.

    Workers on this machine also get the folder of this package, wherever the session was started; on
    a cluster the package is installed or sent along as usual.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    environment = spark.sparkContext.environment
    paths = [str(Path(__file__).resolve().parents[2]), *environment.get("PYTHONPATH", "").split(os.pathsep)]
    environment["PYTHONPATH"] = os.pathsep.join(dict.fromkeys(filter(None, paths)))
    for key, value in WORKERS.items():
        environment.setdefault(key, value)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write the rows to a fresh table in the shared folder and read them back.

    This cuts the lineage: a lost executor costs nothing that was finished before, and what
    is read several times is computed once.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@functools.cache
def file_store(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder's URI, for tasks that read or write files; a bare path is local."""
    return fs.FileSystem.from_uri(folder if ":" in folder.partition("/")[0] else f"file://{folder}")


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def partitions(spark: SparkSession) -> int:
    """The cluster's setting for shuffles; the operators derive every count of parts from it."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts(column: pa.Array) -> Iterator[str]:
    """The column's values one by one, null as the empty text."""
    for value in column:
        yield value.as_py() or ""


def long_lists(column: pa.Array) -> list[np.ndarray]:
    """The rows of a list<long> column as views of one numpy array."""
    ends = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    return [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def hex_digits(column: str) -> Column:
    """16 lower-case hex digits of a 64-bit value."""
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))
