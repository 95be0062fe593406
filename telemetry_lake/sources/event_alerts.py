"""Alert messages derived from an `events` table, as untidy as a topic may deliver them.

Ids are padded, blank or repeated; severities are mixed-case, unknown, blank or missing; reasons
and regions are sometimes blank.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemetry_lake.operators.decode import accepted, decode_alerts
from telemetry_lake.operators.history import stored_alerts
from telemetry_lake.schemas import BRONZE, READING_FIELDS
from telemetry_lake.sources.event_readings import TOPIC_PARTITIONS, events, readings_of, regions

TOPIC = "ST2"


def messages_of(event_rows: DataFrame, region_rows: DataFrame) -> DataFrame:
    readings = readings_of(event_rows, region_rows)
    number = F.col("eventId")
    source = [
        F.when(number % 7 == 0, " ").otherwise(F.col("region")).alias("region")
        if name == "region"
        else F.coalesce("status", F.lit("")).alias("status")
        if name == "status"
        else F.col(name)
        for name in READING_FIELDS
    ]
    alert_id = (
        F.when(number % 10 == 0, "  ")
        .when(number % 10 <= 2, F.format_string("alert-%d-d", F.floor(number / 10)))
        .otherwise(F.format_string("\talert-%d ", number))
    )
    severity = (
        F.when(F.col("status") == "overheating", "critical")
        .when(F.col("status") == " Overload ", " Warning ")
        .when(F.col("status") == "normal", "minor")
        .when(F.col("status") == "ONLINE", "\t")
    )
    reason = F.when(number % 4 == 0, "").otherwise(F.format_string(" reason %d", number))
    return readings.select(
        F.to_json(
            F.struct(
                alert_id.alias("alertId"),
                severity.alias("severity"),
                reason.alias("reason"),
                F.unix_millis("happenedAt").alias("detectedAt"),
                F.struct(*source).alias("source"),
            )
        ).alias("value"),
        F.lit(TOPIC).alias("topic"),
        (number % TOPIC_PARTITIONS).cast("int").alias("partition"),
        number.alias("offset"),
        F.col("happenedAt").alias("kafkaTimestamp"),
    ).select(*BRONZE.names)


def sample_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages_of(events(spark, sf_dir), regions(spark, sf_dir))


def sample_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_alerts(accepted(decode_alerts(sample_messages(spark, sf_dir))))

