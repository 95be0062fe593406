"""Silver readings to hourly gold aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemetry_lake.functions.measures import added_states, mean_of_state, mean_state, stable_avg
from telemetry_lake.schemas import GOLD

MEAN_COLUMNS = ("voltage", "current", "temperature", "load", "failureRiskScore")


def to_gold(silver: DataFrame, width: str = "1 hour") -> DataFrame:
    """One row per transformer, region and tumbling window.

    Every aggregate has a partial form, so a transformer holding a third of the readings is
    reduced on the map side to one row per window and task before the single shuffle.
    """
    hourly = silver.groupBy(
        "transformerId", "region", F.window("eventTime", width).alias("timeWindow")
    ).agg(
        *[stable_avg(F.col(name)).alias(name) for name in MEAN_COLUMNS],
        F.max("failureRiskScore").alias("maxFailureRiskScore"),
        F.count_if(F.col("isAlert")).alias("alertCount"),
        F.count(F.lit(1)).alias("measurementCount"),
    )
    return (
        hourly.withColumn("windowStart", F.col("timeWindow.start"))
        .withColumn("windowEnd", F.col("timeWindow.end"))
        .withColumn("status", F.when(F.col("alertCount") > 0, "ALERT").otherwise("NORMAL"))
        .select(*GOLD.names)
    )


def gold_states(silver: DataFrame, width: str = "1 hour") -> DataFrame:
    """What gold needs to know of some readings: one row per transformer, region and window, which can be added
    to the rows of other readings. Partial aggregates first, as in `to_gold`."""
    window = F.window("eventTime", width)
    hourly = silver.groupBy("transformerId", "region", window.alias("timeWindow")).agg(
        *[mean_state(F.col(name)).alias(name) for name in MEAN_COLUMNS],
        F.max("failureRiskScore").alias("maxFailureRiskScore"),
        F.count_if(F.col("isAlert")).alias("alertCount"),
        F.count(F.lit(1)).alias("measurementCount"),
    )
    return hourly.select("transformerId", "region", "timeWindow.start", "timeWindow.end", *_STATE_COLUMNS)


_STATE_COLUMNS = (*MEAN_COLUMNS, "maxFailureRiskScore", "alertCount", "measurementCount")


def added_gold_states(states: DataFrame) -> DataFrame:
    """One row per transformer, region and window, whatever number of parts the readings came in."""
    return states.groupBy("transformerId", "region", "start", "end").agg(
        *[added_states(F.col(name)).alias(name) for name in MEAN_COLUMNS],
        F.max("maxFailureRiskScore").alias("maxFailureRiskScore"),
        F.sum("alertCount").alias("alertCount"),
        F.sum("measurementCount").alias("measurementCount"),
    )


def gold_of_states(states: DataFrame) -> DataFrame:
    """Gold of added states: what `to_gold` gives of all their readings together. Nothing is shuffled."""
    return states.select(
        "transformerId",
        F.col("start").alias("windowStart"),
        F.col("end").alias("windowEnd"),
        "region",
        *[mean_of_state(F.col(name)).alias(name) for name in MEAN_COLUMNS],
        "maxFailureRiskScore",
        "alertCount",
        "measurementCount",
        F.when(F.col("alertCount") > 0, "ALERT").otherwise("NORMAL").alias("status"),
    ).select(*GOLD.names)
