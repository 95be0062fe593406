"""Topic adapters. The Kafka connector is an optional package of the cluster; files always work.

Both kinds give the same columns: `value, topic, partition, offset, kafkaTimestamp`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from telemetry_lake.schemas import BRONZE


def kafka_stream(
    spark: SparkSession, servers: str, topic: str, max_offsets_per_trigger: int | None = None
) -> DataFrame:
    """A topic from its earliest record; later starts continue from the checkpoint."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
    )
    if max_offsets_per_trigger is not None:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets_per_trigger)
    return reader.load().select(
        F.col("value").cast("string").alias("value"),
        "topic",
        "partition",
        "offset",
        F.col("timestamp").alias("kafkaTimestamp"),
    )


def file_stream(
    spark: SparkSession, path: str, max_files_per_trigger: int | None = None, schema: StructType = BRONZE
) -> DataFrame:
    """Records from a folder of Parquet files, oldest file first."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path).select(*schema.names)


def kafka_sink(messages: DataFrame, servers: str, topic: str, checkpoint: str) -> DataStreamWriter:
    """Writer for a stream of `key, value` rows; the key keeps a transformer in one partition.

    Needs the Kafka package, so no test here has run it.
    """
    return (
        messages.select("key", "value")
        .writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .option("checkpointLocation", checkpoint)
    )
