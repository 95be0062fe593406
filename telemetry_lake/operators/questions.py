"""The four questions asked of the gold layer, and their report preview.

Second-level means are unweighted means of the hourly means. Each ranking ends with a unique
key so equal values always come out in the same order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemetry_lake.functions.measures import stable_avg

PREVIEW_ROWS = 20

# How each answer is ordered; a minus stands for descending, and the last key is unique.
ORDERS = {
    "regions-highest-risk": ("-averageRisk", "region"),
    "transformers-most-alerts": ("-alerts", "-averageRisk", "transformerId"),
    "average-load-by-hour": ("hour",),
    "failure-risk-trend": ("windowStart",),
}


def ordering(name: str) -> list[Column]:
    return [F.desc(key[1:]) if key.startswith("-") else F.asc(key) for key in ORDERS[name]]


def regions_highest_risk(gold: DataFrame) -> DataFrame:
    return (
        gold.groupBy("region")
        .agg(
            stable_avg(F.col("failureRiskScore")).alias("averageRisk"),
            F.max("maxFailureRiskScore").alias("highestRisk"),
            F.sum("measurementCount").alias("measurements"),
        )
        .orderBy(*ordering("regions-highest-risk"))
    )


def transformers_most_alerts(gold: DataFrame) -> DataFrame:
    return (
        gold.groupBy("transformerId")
        .agg(
            F.sum("alertCount").alias("alerts"),
            stable_avg(F.col("failureRiskScore")).alias("averageRisk"),
        )
        .orderBy(*ordering("transformers-most-alerts"))
    )


def average_load_by_hour(gold: DataFrame) -> DataFrame:
    return (
        gold.groupBy(F.hour("windowStart").alias("hour"))
        .agg(stable_avg(F.col("load")).alias("averageLoad"))
        .orderBy(*ordering("average-load-by-hour"))
    )


def failure_risk_trend(gold: DataFrame) -> DataFrame:
    return (
        gold.groupBy("windowStart", "windowEnd")
        .agg(stable_avg(F.col("failureRiskScore")).alias("averageRisk"))
        .orderBy(*ordering("failure-risk-trend"))
    )


# Result name (also the folder it is written to) and the question behind it.
QUESTIONS = {
    "regions-highest-risk": regions_highest_risk,
    "transformers-most-alerts": transformers_most_alerts,
    "average-load-by-hour": average_load_by_hour,
    "failure-risk-trend": failure_risk_trend,
}


def _cell(name: str, kind: str) -> Column:
    value = F.col(name)
    if kind in ("double", "float"):
        text = F.format_string("%.3f", value)
    elif kind.startswith("timestamp"):
        plain = value.cast("string")
        text = F.when(F.contains(plain, F.lit(".")), plain).otherwise(F.concat(plain, F.lit(".0")))
    else:
        text = value.cast("string")
    return F.when(value.isNull(), "").otherwise(text).alias(name)


def report_preview(answer: DataFrame, rows: int = PREVIEW_ROWS) -> DataFrame:
    """The first rows of an ordered answer as the report shows them: text cells, 3 decimals."""
    return answer.limit(rows).select(*[_cell(name, kind) for name, kind in answer.dtypes])
