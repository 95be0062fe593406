"""The alert history: what is stored, insert-if-absent, and the questions operators ask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemetry_lake.functions.messages import log_line
from telemetry_lake.functions.severity import CRITICAL, WARNING, badge_class, severity_category
from telemetry_lake.functions.text import MISSING_ALERT_ID, NO_REASON, UNKNOWN, or_fallback, region_or_unknown
from telemetry_lake.operators.decode import decode_stored
from telemetry_lake.schemas import HISTORY, NUMBER_FIELDS, READING_FIELDS, STORED_ALERT

RECENT_LIMIT = 500
LATEST_LIMIT = 10

# Fixed values, in the order the handler performs them.
ROUTINE_ACTIONS = ("LogAlert", "StoreAlert", "AddToDashboardState")
CRITICAL_ACTIONS = (
    "LogAlert",
    "StoreAlert",
    "StoreCriticalAlert",
    "SendMailNotification",
    "AddToDashboardState",
)


def stored_alerts(alerts: DataFrame) -> DataFrame:
    """Decoded alert messages with the fallbacks and the severity category they are stored under.

    `alerts` carries `partition`, `offset` and `kafkaTimestamp` of the message. The creation
    time is the message's own, so a retried write repeats the same row.
    """
    return alerts.select(
        or_fallback(F.col("alertId"), MISSING_ALERT_ID).alias("alertId"),
        severity_category(F.col("severity")).alias("severity"),
        or_fallback(F.col("severity"), UNKNOWN).alias("originalSeverity"),
        or_fallback(F.col("reason"), NO_REASON).alias("reason"),
        "detectedAt",
        "source",
        region_or_unknown(F.col("source.region")).alias("region"),
        "partition",
        "offset",
        F.col("kafkaTimestamp").alias("createdAt"),
    )


def payload() -> Column:
    """A stored alert as one JSON text, with every field: a measurement that is no number is written as null."""
    source = F.struct(
        *[
            F.when(~F.isnan(F.col("source")[name]), F.col("source")[name]).alias(name)
            if name in NUMBER_FIELDS
            else F.col("source")[name].alias(name)
            for name in READING_FIELDS
        ]
    )
    own = [name for name in STORED_ALERT.names if name != "source"]
    return F.to_json(F.struct(*own, source.alias("source")), {"ignoreNullFields": "false"})


def read_payloads(rows: DataFrame) -> DataFrame:
    """The stored alerts of JSON texts in `value`. One that cannot be read fails the query, as an answer that
    left it out would be wrong."""
    decoded = decode_stored(rows.select("value"))
    broken = F.raise_error(F.concat(F.lit("Invalid alert payload: "), F.coalesce("value", F.lit("null"))))
    first, *rest = STORED_ALERT.names
    return decoded.select(F.when(F.col("isValid"), F.col(first)).otherwise(broken).alias(first), *rest)


def first_arrivals(stored: DataFrame) -> DataFrame:
    """One row per alert id: the message with the lowest (partition, offset).

    An aggregate, not a ranking: blank ids all share one key, and `min_by` folds them to one row
    per task before the shuffle where a window would sort them in a single task.
    """
    rest = [name for name in HISTORY.names if name != "alertId"]
    return (
        stored.groupBy("alertId")
        .agg(F.min_by(F.struct(*rest), F.struct("partition", "offset")).alias("first"))
        .select("alertId", *[F.col("first")[name].alias(name) for name in rest])
        .select(*HISTORY.names)
    )


def not_yet_stored(arrivals: DataFrame, history: DataFrame) -> DataFrame:
    """Insert-if-absent: the arrivals whose id the history does not hold. One row per id on
    both sides, so no key is heavy; AQE broadcasts the ids only if they turn out small."""
    return arrivals.join(history.select("alertId"), "alertId", "left_anti").select(*HISTORY.names)


def newest_first(history: DataFrame) -> DataFrame:
    return history.orderBy(F.desc("detectedAt"), "alertId")


def recent(history: DataFrame, limit: int = RECENT_LIMIT) -> DataFrame:
    return newest_first(history).limit(limit)


def critical_only(history: DataFrame) -> DataFrame:
    return newest_first(history.filter(F.col("severity") == CRITICAL))


def in_region(history: DataFrame, region: str | None) -> DataFrame:
    """Case-insensitive; a blank argument asks for the alerts without a region."""
    wanted = region_or_unknown(F.lit(region).cast("string"))
    return newest_first(history.filter(F.lower("region") == F.lower(wanted)))


def counts(history: DataFrame) -> DataFrame:
    """One row, also for an empty history."""
    totals = history.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("severity") == WARNING).alias("warning"),
        F.count_if(F.col("severity") == CRITICAL).alias("critical"),
    )
    return totals.withColumn("unknown", F.col("total") - F.col("warning") - F.col("critical"))


def counts_by_region(history: DataFrame) -> DataFrame:
    """Per stored region, which is case-sensitive."""
    return history.groupBy("region").agg(F.count(F.lit(1)).alias("alertCount")).orderBy("region")


def service_summary(history: DataFrame, topic: str) -> DataFrame:
    """Fixed words: the health report of the alert service."""
    return history.agg(F.count(F.lit(1)).alias("totalAlerts")).select(
        F.lit("ok").alias("status"),
        F.lit("alert-handler").alias("service"),
        F.lit(topic).alias("kafkaTopic"),
        "totalAlerts",
    )


def latest_panel(history: DataFrame, limit: int = LATEST_LIMIT) -> DataFrame:
    """The rows of the dashboard's latest-alerts table."""
    return recent(history, limit).select(
        "alertId",
        "severity",
        badge_class(F.col("severity")).alias("badge"),
        "region",
        F.col("source.transformerId").alias("transformerId"),
        "reason",
        "detectedAt",
    )


def actions(stored: DataFrame) -> DataFrame:
    """What the handler does with each alert, in order, one row per action."""

    def names(words: tuple[str, ...]) -> Column:
        return F.array(*[F.lit(word) for word in words])

    todo = F.when(F.col("severity") == CRITICAL, names(CRITICAL_ACTIONS)).otherwise(names(ROUTINE_ACTIONS))
    return stored.select("*", F.posexplode(todo).alias("step", "action"))


def log_lines(stored: DataFrame) -> DataFrame:
    return stored.select("alertId", "severity", "partition", "offset", log_line().alias("logLine"))
