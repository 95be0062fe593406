"""Append-only Parquet tables written by micro-batches, safe to retry.

A micro-batch owns the folder `run=<query>/batch=<id>`, so a second query with a new checkpoint adds its own.
What other streams consume is published: written aside and renamed into its place as a whole, once. A
retried batch finds it there and leaves it, so no file that a consumer may have listed changes or goes. Other
tables are overwritten by a retry.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from telemetry_lake.sources.commits import exists, move_if_absent, remove

# Partitions of a table that is read by key.
BUCKETS = 64
_OWNER = [StructField("run", StringType()), StructField("batch", LongType())]
_BUCKET = StructField("bucket", IntegerType())
# The partition columns of a table of states.
STATE_PLACE = [*_OWNER, _BUCKET]


def run_name(checkpoint: str) -> str:
    """Stable across restarts of one checkpoint, different for another."""
    return hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]


def bucket(key: str) -> Column:
    """The partition of a key in a table that is read by key: a micro-batch reads the buckets it touches."""
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int").alias("bucket")


def buckets_of(rows: DataFrame, key: str) -> list[int]:
    """The buckets of the rows' keys, at most BUCKETS numbers."""
    return [r.bucket for r in rows.select(bucket(key)).distinct().collect()]


def read_table(spark: SparkSession, path: str, schema: StructType, buckets: list[int] | None = None) -> DataFrame:
    """All rows so far, of the given buckets only if there are any given; a table nobody wrote to is empty."""
    return _read(spark, path, schema, buckets).select(*schema.names)


def read_before(
    spark: SparkSession, path: str, schema: StructType, run: str, batch: int, buckets: list[int] | None = None
) -> DataFrame:
    """The rows a batch may see: not its own from an earlier attempt, nor later ones of its run.

    All tested columns are partition columns, so the folders left out are not read.
    """
    own = (F.col("run") == run) & (F.col("batch") >= batch)
    return _read(spark, path, schema, buckets).filter(~own).select(*schema.names)


def _read(spark: SparkSession, path: str, schema: StructType, buckets: list[int] | None) -> DataFrame:
    full = StructType([*schema.fields, *_OWNER, *([] if buckets is None else [_BUCKET])])
    if not exists(spark, path):
        return spark.createDataFrame([], full)
    rows = spark.read.schema(full).parquet(path)
    return rows if buckets is None else rows.filter(F.col("bucket").isin(buckets))


def write_batch(rows: DataFrame, path: str, run: str, batch: int, *partitioned: str) -> None:
    """Replace the batch's folder; partitioned rows are dealt so that small partitions are one file each."""
    if partitioned:
        rows = rows.hint("rebalance", *[F.col(name) for name in partitioned])
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(*partitioned) if partitioned else writer).parquet(f"{path}/run={run}/batch={batch}")


def publish_batch(rows: DataFrame, path: str, run: str, batch: int, *partitioned: str) -> bool:
    """Put the batch's folder in its place, complete, unless it is there; says whether it was written now.

    Folders that begin with an underscore are not read, so a half-written attempt is never seen.
    """
    spark, place = rows.sparkSession, f"{path}/run={run}/batch={batch}"
    if exists(spark, place):
        return False
    aside = f"{path}/_attempts/{uuid.uuid4().hex}"
    if partitioned:
        rows = rows.hint("rebalance", *[F.col(name) for name in partitioned])
    (rows.write.partitionBy(*partitioned) if partitioned else rows.write).parquet(aside)
    if move_if_absent(spark, aside, place):
        return True
    remove(spark, aside)
    return False


def write_bucketed(rows: DataFrame, path: str, run: str, batch: int, key: str) -> None:
    write_batch(rows.withColumn("bucket", bucket(key)), path, run, batch, "bucket")


def read_version(spark: SparkSession, path: str, schema: StructType, run: str, version: int) -> DataFrame:
    """What one batch wrote; a missing or unfinished version is an error."""
    folder = f"{path}/run={run}/batch={version}"
    require_version(spark, path, run, version)
    return spark.read.schema(schema).parquet(folder).select(*schema.names)


def require_version(spark: SparkSession, path: str, run: str, version: int) -> None:
    """Going on without a version would forget what it held."""
    folder = f"{path}/run={run}/batch={version}"
    if not exists(spark, f"{folder}/_SUCCESS"):
        raise FileNotFoundError(f"no finished version in {folder}")


def drop_version(spark: SparkSession, path: str, run: str, version: int) -> None:
    """Remove a version that no retry can need any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/run={run}/batch={version}")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
