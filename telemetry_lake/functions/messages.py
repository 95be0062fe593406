"""Texts shown to people: log lines and notification subject and body.

All take the columns of a stored alert (`alertId, severity, originalSeverity, reason,
detectedAt, source`). The layouts are fixed formats.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from telemetry_lake.functions.severity import CRITICAL, WARNING, severity_word
from telemetry_lake.functions.text import (
    UNKNOWN_REGION,
    UNKNOWN_SENSOR,
    UNKNOWN_STATUS,
    UNKNOWN_TRANSFORMER,
    or_fallback,
)

# Fixed formats.
WARNING_LINE = "[WARNING] alert=%s transformer=%s region=%s reason=%s"
UNKNOWN_LINE = "[UNKNOWN SEVERITY] alert=%s severity=%s region=%s reason=%s"
CRITICAL_BLOCK = (
    "============================================================\n"
    "[CRITICAL] SMART GRID ALERT\n"
    "Alert id    : %s\n"
    "Transformer : %s\n"
    "Region      : %s\n"
    "Reason      : %s\n"
    "Risk score  : %s\n"
    "Temperature : %s\n"
    "Voltage     : %s\n"
    "Load        : %s\n"
    "============================================================"
)
SUBJECT = "[CRITICAL] Smart Grid alert in %s"
BODY = (
    "Alert id: %s\n"
    "Severity: %s\n"
    "Reason: %s\n"
    "Detected at: %s\n"
    "\n"
    "Sensor: %s\n"
    "Transformer: %s\n"
    "Region: %s\n"
    "Failure risk score: %s\n"
    "Temperature: %s\n"
    "Voltage: %s\n"
    "Current: %s\n"
    "Load: %s\n"
    "Status: %s\n"
    "\n"
    "Recommended action:\n"
    "Inspect the impacted grid equipment."
)


def _number(name: str) -> Column:
    return F.col(f"source.{name}").cast("string")


def _region() -> Column:
    return or_fallback(F.col("source.region"), UNKNOWN_REGION)


def log_line() -> Column:
    transformer = F.col("source.transformerId")
    critical = F.format_string(
        CRITICAL_BLOCK,
        "alertId",
        transformer,
        _region(),
        "reason",
        _number("failureRiskScore"),
        _number("temperature"),
        _number("voltage"),
        _number("load"),
    )
    return (
        F.when(
            F.col("severity") == WARNING,
            F.format_string(WARNING_LINE, "alertId", transformer, _region(), "reason"),
        )
        .when(F.col("severity") == CRITICAL, critical)
        .otherwise(
            F.format_string(
                UNKNOWN_LINE, "alertId", severity_word(F.col("originalSeverity")), _region(), "reason"
            )
        )
    )


def notification_subject() -> Column:
    return F.format_string(SUBJECT, _region())


def notification_body() -> Column:
    return F.format_string(
        BODY,
        "alertId",
        "severity",
        "reason",
        F.col("detectedAt").cast("string"),
        or_fallback(F.col("source.sensorId"), UNKNOWN_SENSOR),
        or_fallback(F.col("source.transformerId"), UNKNOWN_TRANSFORMER),
        _region(),
        _number("failureRiskScore"),
        _number("temperature"),
        _number("voltage"),
        _number("current"),
        _number("load"),
        or_fallback(F.col("source.status"), UNKNOWN_STATUS),
    )


def notification_text(delivery: Column) -> Column:
    """Subject, how it was delivered, and the body: one entry of the notification audit."""
    return F.format_string("Subject: %s\nDelivery: %s\n\n%s", notification_subject(), delivery, notification_body())
