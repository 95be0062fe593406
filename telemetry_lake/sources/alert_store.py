"""The stored alert history: insert-if-absent by an id index, rows by day and region, counters on the side.

Every micro-batch is a part (see `commits`) of four kinds of files, which appear in one step:

* `rows` and `filter`: ids and severities, sorted by the ids' hash, with Bloom filters (see `keyed`). They answer
  which ids are stored without reading alerts.
* `alerts`: the rows, partitioned by day and region and sorted by the time of detection.
* `counts`: alerts by hour, region and severity. They answer every count, and tell how far back the newest
  k alerts reach.

`compact` merges parts of similar size. Whoever reads holds a version, so answers do not change under a merge.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from telemetry_lake.functions.severity import CRITICAL, WARNING
from telemetry_lake.functions.text import region_or_unknown
from telemetry_lake.operators.history import RECENT_LIMIT, newest_first
from telemetry_lake.schemas import HISTORY
from telemetry_lake.sources import commits, keyed
from telemetry_lake.sources.commits import Version, read_kind
from telemetry_lake.sources.lake import through_table

KEY = "alertId"
IDS = StructType([StructField(KEY, StringType()), StructField("severity", StringType())])
COUNTS = StructType(
    [
        StructField("hour", LongType()),
        StructField("region", StringType()),
        StructField("severity", StringType()),
        StructField("alerts", LongType()),
    ]
)
_DAY = StructField("day", IntegerType())
_HOUR_MILLIS = 3_600_000


def _hour() -> Column:
    return F.floor(F.col("detectedAt") / F.lit(_HOUR_MILLIS).cast("decimal(19,0)")).cast("long")


def _day_of(hour: Column) -> Column:
    return F.floor(hour / F.lit(24).cast("decimal(19,0)")).cast("int")


def _write(rows: DataFrame, counts: DataFrame | None, table: str, name: str) -> dict:
    """All files of a part. The alerts are written first, and everything else is read off them."""
    spark = rows.sparkSession
    folder = f"{table}/alerts/part={name}"
    dated = rows.select(*HISTORY.names).withColumn("day", _day_of(_hour()))
    # Ranges of the order itself: a region's crowded day is cut by time, and files of a day do not overlap.
    order = ["day", "region", "detectedAt", KEY]
    dated.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("day", "region").parquet(folder)
    written = spark.read.schema(StructType([*HISTORY.fields, _DAY])).parquet(folder)
    said = keyed.write_part(written.select(*IDS.names), table, name, KEY, IDS)
    if counts is None:
        counts = written.groupBy(_hour().alias("hour"), "region", "severity").agg(F.count("*").alias("alerts"))
    counts.select(*COUNTS.names).write.parquet(f"{table}/counts/part={name}")
    return {**said, "kinds": [*said["kinds"], "alerts", "counts"]}


def stored_ids(spark: SparkSession, table: str, version: Version, ids: DataFrame) -> DataFrame:
    """Those of the ids (one row for each) that the version holds, with the severity stored."""
    return keyed.lookup(spark, table, version.parts, ids, KEY, IDS)


def insert_absent(
    spark: SparkSession, table: str, arrivals: DataFrame, query: str, batch: int, before: Callable[[], None] = lambda: None
) -> Version:
    """Store the alerts (one row per id) whose id is not stored yet, as one batch, and say what the table is then.

    Two writers that bring the same id at the same moment store it once: the one that commits second looks again.
    `before` is called before each commit (tests let others commit there).
    """

    @functools.cache
    def arrived() -> DataFrame:
        """The arrivals as a table: they are looked up, joined and sorted by a sample, each of which would make them again."""
        return through_table(spark, arrivals.select(*HISTORY.names), "arrived")

    def write(version: Version, name: str) -> dict:
        rows = arrived()
        if version.parts:
            known = stored_ids(spark, table, version, rows.select(KEY))
            rows = through_table(spark, rows.join(known.select(KEY), KEY, "left_anti"), "absent")
        said = _write(rows, None, table, name)
        before()
        return said

    return commits.append(spark, table, write, query, batch)


def compact(spark: SparkSession, table: str, fan_in: int = 4) -> Version:
    """Merge parts of similar size until none are due. Readers and writers may go on meanwhile."""
    while True:
        version = commits.latest(spark, table)
        due = commits.merge_due(version.parts, fan_in)
        if not due:
            return version
        counts = read_kind(spark, table, "counts", due, COUNTS).groupBy("hour", "region", "severity")
        counts = counts.agg(F.sum("alerts").alias("alerts"))
        commits.replace(spark, table, due, lambda name: _write(alerts(spark, table, version, due), counts, table, name))


def alerts(spark: SparkSession, table: str, version: Version | None = None, parts: tuple[dict, ...] | None = None) -> DataFrame:
    """The stored alerts of a version (the latest), or of some of its parts."""
    return _dated(spark, table, version, parts).select(*HISTORY.names)


def _dated(spark: SparkSession, table: str, version: Version | None, parts: tuple[dict, ...] | None = None) -> DataFrame:
    if parts is None:
        parts = (version or commits.latest(spark, table)).parts
    return read_kind(spark, table, "alerts", parts, StructType([*HISTORY.fields, _DAY]))


def counters(spark: SparkSession, table: str, version: Version | None = None) -> DataFrame:
    """Alerts by hour, region and severity, of each part."""
    parts = (version or commits.latest(spark, table)).parts
    return read_kind(spark, table, "counts", parts, COUNTS).select(*COUNTS.names)


def counts(counted: DataFrame) -> DataFrame:
    """One row, also for an empty table."""

    def of(severity: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("severity") == severity, F.col("alerts"))), F.lit(0)).cast("long")

    totals = counted.agg(
        F.coalesce(F.sum("alerts"), F.lit(0)).cast("long").alias("total"),
        of(WARNING).alias("warning"),
        of(CRITICAL).alias("critical"),
    )
    return totals.withColumn("unknown", F.col("total") - F.col("warning") - F.col("critical"))


def counts_by_region(counted: DataFrame) -> DataFrame:
    """Per stored region, which is case-sensitive."""
    return counted.groupBy("region").agg(F.sum("alerts").alias("alertCount")).orderBy("region")


def recent(spark: SparkSession, table: str, limit: int = RECENT_LIMIT, version: Version | None = None) -> DataFrame:
    """The newest alerts, read no further back than the hour in which the counters reach `limit`."""
    version = version or commits.latest(spark, table)
    rows = _dated(spark, table, version)
    reach = _reach(counters(spark, table, version), limit)
    if reach is not None:
        rows = rows.where((F.col("day") >= reach // 24) & (F.col("detectedAt") >= reach * _HOUR_MILLIS))
    return newest_first(rows.select(*HISTORY.names)).limit(limit)


def _reach(counted: DataFrame, limit: int) -> int | None:
    """The hour at which the newest hours together hold `limit` alerts; None if all hours do not.

    An hour's count is at least one, so the newest `limit` hours are enough: that many rows reach the driver.
    """
    hours = counted.groupBy("hour").agg(F.sum("alerts").alias("alerts")).orderBy(F.desc("hour")).limit(limit)
    total = 0
    for row in hours.collect():
        total += row["alerts"]
        if total >= limit:
            return row["hour"]
    return None


def in_region(spark: SparkSession, table: str, region: str | None, version: Version | None = None) -> DataFrame:
    """Case-insensitive, reading the folders of that region only; blank asks for the alerts without one."""
    wanted = region_or_unknown(F.lit(region).cast("string"))
    return newest_first(alerts(spark, table, version).where(F.lower("region") == F.lower(wanted)))
