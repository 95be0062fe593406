"""The bronze layer: raw topic records, never interpreted."""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from telemetry_lake.schemas import BRONZE
from telemetry_lake.session import for_small_files
from telemetry_lake.sources.lake import through_table
from telemetry_lake.sources.object_list import follow, is_known, offset_of, opened, store_of

PLACE = ["topic", "partition", "offset"]


def without_newlines(payload: Column) -> Column:
    """Line breaks are removed, not replaced; everything else stays verbatim."""
    return F.translate(payload, "\n\r", "")


def to_bronze(records: DataFrame) -> DataFrame:
    """Topic records (batch or stream) as bronze rows."""
    return records.withColumn("value", without_newlines(F.col("value").cast("string"))).select(*BRONZE.names)


def read_landed(spark: SparkSession, path: str) -> DataFrame:
    """Bronze as the landing stream writes it: Parquet by topic partition."""
    return spark.read.schema(BRONZE).parquet(path).select(*BRONZE.names)


def _as_objects(files: DataFrame, topic: str | None) -> DataFrame:
    offset = F.regexp_extract(F.col("_metadata.file_path"), r"offset(?:=|%3D)([0-9]+)", 1).try_cast("bigint")
    return _records(files, offset, topic)


def _records(files: DataFrame, offset: Column, topic: str | None) -> DataFrame:
    return files.select(
        F.col("content").cast("string").alias("value"),
        F.lit(topic).cast("string").alias("topic"),
        "partition",
        offset.alias("offset"),
        F.lit(None).cast("timestamp").alias("kafkaTimestamp"),
    )


# Spark opens a small file some ten times faster as bytes than as a whole text.
_OBJECT = "path string, modificationTime timestamp, length long, content binary, partition int"


def read_objects(spark: SparkSession, path: str, topic: str | None = None) -> DataFrame:
    """Bronze in the one-object-per-record layout `partition=P/offset=O.json`.

    Spark packs many of the small objects into one task. The record time is unknown there.
    """
    return _as_objects(spark.read.schema(_OBJECT).format("binaryFile").load(path), topic)


def object_stream(spark: SparkSession, path: str, max_files: int | None = None, topic: str | None = None) -> DataFrame:
    """The same layout as a stream, so that objects can be landed a batch at a time: the stream's own log
    remembers what it has taken of the list of objects, and a batch opens the new ones only.

    The list is made by tasks and lies beside the objects (see `object_list`). Where pyarrow does not know the
    store, Spark's file source lists it, which keeps all names on the driver.
    """
    own = for_small_files(spark)
    if is_known(path):
        objects = opened(follow(own, path, max_files), path)
        return _records(objects, offset_of(F.col("name")), topic)
    reader = own.readStream.schema(_OBJECT).format("binaryFile")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return _as_objects(reader.load(path), topic)


def write_objects(bronze: DataFrame, folder: str) -> int:
    """Write records in that layout, one object each, and say how many. Every task writes the objects of its rows;
    one that is tried again writes the same objects over.

    `folder` is a path that all workers share, or a URI whose file system pyarrow knows (`s3://`, `gs://`, `hdfs://`).
    """
    store, root = store_of(folder)

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = set()
        for part in parts:
            for value, partition, offset in zip(*(column.to_pylist() for column in part.columns), strict=True):
                place = f"{root}/partition={partition}"
                if partition not in made:
                    store.create_dir(place)
                    made.add(partition)
                with store.open_output_stream(f"{place}/offset={offset}.json") as out:
                    out.write((value or "").encode())
            yield pa.record_batch([pa.array([part.num_rows], pa.int64())], ["objects"])

    done = to_bronze(bronze).select("value", "partition", "offset").mapInArrow(write, "objects long")
    return done.agg(F.sum("objects")).first()[0] or 0


def read_bronze(spark: SparkSession, source: str) -> DataFrame:
    """Each record of a bronze folder once: as landed, or `objects:FOLDER` for one object per record.

    An object's name is its place in the topic, so there is one for each record.
    """
    if source.startswith("objects:"):
        return read_objects(spark, source.removeprefix("objects:"))
    return landed_once(spark, source)


def landed_once(spark: SparkSession, path: str) -> DataFrame:
    """Landed bronze without the records that two landing queries added at the same moment.

    One query lands a record once. Where the offsets of two queries overlap, their places alone are compared,
    and the surplus rows are taken out by file and row; payloads are read by whoever asks for them, and
    shuffled only if the surplus is too large to broadcast. One row per query and topic partition reaches the driver.
    """
    rows = spark.read.schema(StructType([*BRONZE.fields, StructField("run", StringType())])).parquet(path)
    spans = rows.groupBy("run", "topic", "partition").agg(F.min("offset").alias("low"), F.max("offset").alias("high"))
    shared = _overlaps([tuple(r) for r in spans.collect()])
    if not shared:
        return rows.select(*BRONZE.names)
    near = F.lit(False)
    for topic, partition, low, high in shared:
        same = F.col("topic").eqNullSafe(F.lit(topic)) & F.col("partition").eqNullSafe(F.lit(partition))
        near = near | (same & F.col("offset").between(low, high))
    places = rows.where(near).select(*PLACE, F.struct("_metadata.file_path", "_metadata.row_index").alias("row"))
    copies = places.groupBy(*PLACE).agg(F.min("row").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    surplus = places.join(copies.select(*PLACE, "first"), PLACE).where("row <> first").select("row.*")
    surplus = through_table(spark, surplus, "surplus")
    named = rows.select(*BRONZE.names, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    gone = (F.col("_file") == surplus["file_path"]) & (F.col("_row") == surplus["row_index"])
    return named.join(surplus, gone, "left_anti").select(*BRONZE.names)


def _overlaps(spans: list[tuple]) -> list[tuple]:
    """(topic, partition, low, high) of the stretches of offsets that more than one run has."""
    found, reach = [], {}
    for _, topic, partition, low, high in sorted(spans, key=lambda s: (str(s[1]), s[2] or 0, s[3] if s[3] is not None else 0)):
        if low is None:
            continue
        top = reach.get((topic, partition))
        if top is not None and low <= top:
            found.append((topic, partition, low, min(high, top)))
        reach[topic, partition] = high if top is None else max(high, top)
    return found


def bound_of(text: str | None) -> int | None:
    """A bound on the number of records; unset or unreadable text is no bound."""
    try:
        return int(text)
    except (TypeError, ValueError):
        return None


def first_records(bronze: DataFrame, count: int | None) -> DataFrame:
    """The first `count` records by (offset, partition, topic), or all of them without a bound.

    Where they end is found by counting: by stretches of offsets, then by ever shorter ones within the stretch in which
    the count is reached. Only offsets are read for that, and what is returned is a filter, so no
    record passes through a single task. Records are taken to have a place of their own.
    """
    if count is None:
        return bronze
    if count <= 0:
        return bronze.where(F.lit(False))
    left, inside, low = count, F.col("offset").isNotNull(), None
    for width in (1 << 20, 1 << 10, 1):
        stretch = (F.col("offset") - F.pmod("offset", F.lit(width))).alias("low")
        found = bronze.where(inside).groupBy(stretch).count().orderBy("low").collect()
        low = None
        for row in found:
            if row["count"] >= left:
                low = row["low"]
                break
            left -= row["count"]
        if low is None:
            # All of them; those without an offset come last and are not told apart.
            return bronze.where(F.col("offset").isNotNull())
        inside = F.col("offset").between(low, low + width - 1)
    last = bronze.where(inside).select("partition", "topic").orderBy("partition", "topic").limit(left)
    ends = [(r["partition"], r["topic"]) for r in last.collect()]
    chosen = functools.reduce(
        operator.or_,
        [F.col("partition").eqNullSafe(F.lit(p)) & F.col("topic").eqNullSafe(F.lit(t)) for p, t in ends],
    )
    return bronze.where((F.col("offset") < low) | ((F.col("offset") == low) & chosen))


# Offsets of one stretch in which gaps are looked for by one task.
GAP_STRETCH = 1 << 16


def offset_gaps(bronze: DataFrame) -> DataFrame:
    """`topic`, `partition`, `low`, `high`: the offsets between a partition's first and last that are not there.

    Neighbours are compared within stretches of offsets; only the stretches' ends, one row each, meet by partition.
    """
    key = ["topic", "partition"]
    stretch = (F.col("offset") - F.pmod("offset", F.lit(GAP_STRETCH))).alias("stretch")
    places = bronze.where("offset IS NOT NULL").select(*key, stretch, "offset")
    before = F.lag("offset").over(Window.partitionBy(*key, "stretch").orderBy("offset"))
    inner = places.withColumn("before", before).select(*key, "before", "offset")
    ends = places.groupBy(*key, "stretch").agg(F.min("offset").alias("offset"), F.max("offset").alias("last"))
    outer = ends.withColumn("before", F.lag("last").over(Window.partitionBy(*key).orderBy("stretch")))
    gaps = inner.unionByName(outer.select(*key, "before", "offset")).where("offset > before + 1")
    return gaps.select(*key, (F.col("before") + 1).alias("low"), (F.col("offset") - 1).alias("high"))
