"""Bronze text to clean silver readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemetry_lake.functions.measures import event_time, load_ratio
from telemetry_lake.schemas import ALERT_STATUSES, READING_FIELDS, READING_TEXT, SILVER, AlertRules


def parse_text_readings(bronze: DataFrame) -> DataFrame:
    """Bronze payloads as all-text reading columns; a payload that is not JSON gives nulls.

    `inline` keeps the parsed struct behind a generator: the validity filter cannot be pushed
    below it, which would repeat the JSON parse once per tested field.
    """
    return bronze.select(F.inline(F.array(F.from_json("value", READING_TEXT))))


def alert_flag(score: Column, status: Column, rules: AlertRules) -> Column:
    """High score or an alerting status. A missing status next to a low score leaves it null."""
    return (score >= F.lit(rules.warning)) | status.isin(*ALERT_STATUSES)


def is_valid() -> Column:
    present = ("sensorId", "transformerId", "eventTime", "region", "voltage", "current", "temperature")
    valid = F.col("load").between(0.0, 1.0) & F.col("failureRiskScore").between(0.0, 1.0)
    for name in present:
        valid = valid & F.col(name).isNotNull()
    return valid


def to_silver(readings: DataFrame, rules: AlertRules = AlertRules()) -> DataFrame:
    """Normalise, derive event time and alert flag, and drop invalid rows (map-side only).

    Takes reading columns of any type; a column that is missing counts as null.
    """
    have = set(readings.columns)
    raw = {name: F.col(name) if name in have else F.lit(None).cast("string") for name in READING_FIELDS}

    def number(name: str) -> Column:
        return raw[name].try_cast("double")

    def key(name: str) -> Column:
        return F.lower(F.trim(raw[name].cast("string")))

    cleaned = F.struct(
        key("sensorId").alias("sensorId"),
        key("transformerId").alias("transformerId"),
        raw["timestamp"].cast("string").alias("timestamp"),
        key("region").alias("region"),
        number("voltage").alias("voltage"),
        number("current").alias("current"),
        number("temperature").alias("temperature"),
        load_ratio(number("load")).alias("load"),
        number("failureRiskScore").alias("failureRiskScore"),
        F.upper(F.trim(raw["status"].cast("string"))).alias("status"),
        event_time(raw["timestamp"].cast("string")).alias("eventTime"),
    )
    # `inline` again keeps the filter from repeating every cast it tests.
    return (
        readings.select(F.inline(F.array(cleaned)))
        .filter(is_valid())
        .withColumn("isAlert", alert_flag(F.col("failureRiskScore"), F.col("status"), rules))
        .select(*SILVER.names)
    )
