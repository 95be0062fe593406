"""Reading and writing the layers of the lake."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from telemetry_lake.session import scratch_dir
from telemetry_lake.sources.commits import remove


def write_layer(data: DataFrame, path: str) -> None:
    """Replace a region-partitioned Parquet layer.

    The rebalance step keeps files near the advisory partition size. AQE splits a region that
    holds a large share of the rows over many tasks and merges small ones, so neither one huge
    task nor one file per task and region comes out.
    """
    (
        data.hint("rebalance", F.col("region"))
        .write.mode("overwrite")
        .partitionBy("region")
        .parquet(path)
    )


def read_layer(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A layer with its declared schema: no inference, and `region` back in its place.

    A blank region is written as Hive's default partition and comes back as null.
    """
    return spark.read.schema(schema).parquet(path).select(*schema.names)


def write_statistics(answer: DataFrame, path: str) -> None:
    """An answer as JSON. AQE merges a small answer into one file; a large one comes as several rather
    than through a single task. Readers sort it again: files are read in no particular order."""
    answer.write.mode("overwrite").json(path)


def read_statistics(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def through_table(spark: SparkSession, data: DataFrame, name: str) -> DataFrame:
    """Write `data` to the shared scratch folder and read it back.

    Cuts the lineage before a plan that reads its input several times; a lost executor then
    costs a re-read, not a re-computation.
    """
    path = scratch_dir(spark, name)
    data.write.parquet(path)
    return spark.read.schema(data.schema).parquet(path)


@contextmanager
def held(rows: DataFrame, folder: str) -> Iterator[DataFrame]:
    """The rows as a table in `folder`, which is there as long as the block lasts.

    In place of a cache: cached rows that have to go to disk are written by Java's serializer, which holds on to
    the last hundred of a task's batches, so a large micro-batch would not fit in an executor.
    """
    spark = rows.sparkSession
    try:
        rows.write.parquet(folder)
        yield spark.read.schema(rows.schema).parquet(folder)
    finally:
        remove(spark, folder)
