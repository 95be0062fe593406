"""Sensor readings derived from an `events` table, for queries, tests and the bench.

Every event becomes one reading: the user is the transformer, `value` drives temperature and
risk, and the number in `props` drives current and load. Keys and statuses are padded and
mixed-case on purpose, some loads exceed 100 percent and one status is missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemetry_lake.schemas import BRONZE, READING_FIELDS

TOPIC = "ST"
TOPIC_PARTITIONS = 6

EVENTS_SCHEMA = (
    "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events, dealt over all cores: the file is one row group, which Spark cannot split."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.repartition(spark.sparkContext.defaultParallelism, "event_id")


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/region.parquet")


def readings_of(event_rows: DataFrame, region_rows: DataFrame) -> DataFrame:
    """Reading columns plus `eventId` and `happenedAt` (works on batch and streaming events)."""
    joined = event_rows.join(
        region_rows.select(F.col("r_regionkey").cast("bigint").alias("regionKey"), "r_name"),
        F.col("user_id") % 5 == F.col("regionKey"),
    )
    k = F.get_json_object("props", "$.k").cast("int")
    return joined.select(
        F.format_string(" S-%d ", F.col("event_id")).alias("sensorId"),
        F.format_string("TR-%d", F.col("user_id")).alias("transformerId"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
        F.col("r_name").alias("region"),
        (F.lit(215.0) + (F.col("event_id") * 7 % 3000) / F.lit(100.0)).alias("voltage"),
        (F.lit(5.0) + k * F.lit(0.945)).alias("current"),
        (F.lit(40.0) + F.least(F.col("value"), F.lit(80.0))).alias("temperature"),
        (k * F.lit(1.05)).alias("load"),
        F.least(F.lit(1.0), F.col("value") / F.lit(50.0)).alias("failureRiskScore"),
        F.when(F.col("event_type") == "error", "overheating")
        .when(F.col("event_type") == "purchase", " Overload ")
        .when(F.col("event_type") == "view", "normal")
        .when(F.col("event_type") == "click", "ONLINE")
        .alias("status"),
        F.col("event_id").alias("eventId"),
        F.col("ts").cast("timestamp").alias("happenedAt"),
    )


def bronze_of(readings: DataFrame) -> DataFrame:
    """The readings as raw topic records, keyed so that one transformer stays in one partition."""
    number = F.regexp_extract("transformerId", r"(\d+)$", 1).cast("bigint")
    return readings.select(
        F.to_json(F.struct(*READING_FIELDS)).alias("value"),
        F.lit(TOPIC).alias("topic"),
        (number % TOPIC_PARTITIONS).cast("int").alias("partition"),
        F.col("eventId").alias("offset"),
        F.col("happenedAt").alias("kafkaTimestamp"),
    ).select(*BRONZE.names)


def sample_bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bronze_of(readings_of(events(spark, sf_dir), regions(spark, sf_dir)))
