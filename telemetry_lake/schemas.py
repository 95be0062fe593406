"""Schemas and the tunable constants of the alert rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

NUMBER_FIELDS = ("voltage", "current", "temperature", "load", "failureRiskScore")

# Field order of one reading on the wire.
READING_FIELDS = (
    "sensorId",
    "transformerId",
    "timestamp",
    "region",
    "voltage",
    "current",
    "temperature",
    "load",
    "failureRiskScore",
    "status",
)


def _reading(number: T.DataType) -> T.StructType:
    return T.StructType(
        [T.StructField(name, number if name in NUMBER_FIELDS else T.StringType()) for name in READING_FIELDS]
    )


READING = _reading(T.DoubleType())
# Numbers stay text until `try_cast`, so "50" and 50 are both accepted and "x" becomes null.
READING_TEXT = _reading(T.StringType())

ALERT = T.StructType(
    [
        T.StructField("alertId", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("detectedAt", T.LongType()),
        T.StructField("source", READING),
    ]
)

STORED_ALERT = T.StructType(
    [
        T.StructField("alertId", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("originalSeverity", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("detectedAt", T.LongType()),
        T.StructField("source", READING),
    ]
)

# Alert history: the stored alert plus its normalised region and where it came from.
HISTORY = T.StructType(
    [
        *STORED_ALERT.fields,
        T.StructField("region", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("createdAt", T.TimestampType()),
    ]
)

BRONZE = T.StructType(
    [
        T.StructField("value", T.StringType()),
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("kafkaTimestamp", T.TimestampType()),
    ]
)

SILVER = T.StructType(
    [
        *READING.fields,
        T.StructField("eventTime", T.TimestampType()),
        T.StructField("isAlert", T.BooleanType()),
    ]
)

GOLD = T.StructType(
    [
        T.StructField("transformerId", T.StringType()),
        T.StructField("windowStart", T.TimestampType()),
        T.StructField("windowEnd", T.TimestampType()),
        T.StructField("region", T.StringType()),
        T.StructField("voltage", T.DoubleType()),
        T.StructField("current", T.DoubleType()),
        T.StructField("temperature", T.DoubleType()),
        T.StructField("load", T.DoubleType()),
        T.StructField("failureRiskScore", T.DoubleType()),
        T.StructField("maxFailureRiskScore", T.DoubleType()),
        T.StructField("alertCount", T.LongType()),
        T.StructField("measurementCount", T.LongType()),
        T.StructField("status", T.StringType()),
    ]
)

# Append-only log of notification states; the highest `revision` of an alert is its state.
LEDGER = T.StructType(
    [
        T.StructField("alertId", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("updatedAt", T.TimestampType()),
        T.StructField("revision", T.LongType()),
    ]
)

# What the detector remembers about a transformer between micro-batches.
STREAK = T.StructType(
    [
        T.StructField("transformerId", T.StringType()),
        T.StructField("since", T.LongType()),
        T.StructField("lastMillis", T.LongType()),
    ]
)


@dataclass(frozen=True)
class AlertRules:
    """Thresholds are inclusive; a warning needs a streak of at least `window_millis`."""

    # Fixed values of the alert rule.
    warning: float = 0.8
    critical: float = 0.9
    window_millis: int = 30_000


# The statuses that flag a reading whatever its score.
ALERT_STATUSES = ("ALERT", "WARNING", "CRITICAL", "OVERLOAD", "OVERHEATING")
