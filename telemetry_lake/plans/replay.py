"""Alerts of a whole bronze archive, without a stream.

    python -m telemetry_lake.plans.replay BRONZE READINGS ALERTS

BRONZE is a landed folder, or `objects:FOLDER` for one object per record.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession

from telemetry_lake.operators.decode import decode_readings, timed_readings
from telemetry_lake.operators.detection import EVENT, Clock, detect
from telemetry_lake.schemas import AlertRules
from telemetry_lake.session import configure
from telemetry_lake.sources.bronze import read_bronze


def replay(
    bronze: DataFrame,
    readings_path: str,
    clock: Clock = EVENT,
    rules: AlertRules = AlertRules(),
    width: int | None = None,
) -> DataFrame:
    """Decode bronze once into a table, then detect over that table's columns."""
    readings = timed_readings(decode_readings(bronze), clock.instant)
    readings.write.mode("overwrite").parquet(readings_path)
    table = bronze.sparkSession.read.schema(readings.schema).parquet(readings_path)
    return detect(table, clock, rules, width)


def main(args: list[str]) -> None:
    bronze_path, readings_path, alerts_path = args
    spark = configure(SparkSession.builder.appName("telemetry-replay").getOrCreate())
    replay(read_bronze(spark, bronze_path), readings_path).write.mode("overwrite").parquet(alerts_path)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
