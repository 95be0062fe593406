"""Gold that grows with its readings: states by day, of which a batch replaces the days it touches.

A version (see `commits`) says which part holds each day. A batch adds its states to those of its days and
takes these days over; readings that come late change the old day they belong to and no other. Readers hold a
version, in which every reading counts once, however often a batch was tried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from telemetry_lake.operators.gold import added_gold_states, gold_of_states, gold_states
from telemetry_lake.schemas import SILVER
from telemetry_lake.sources import commits
from telemetry_lake.sources.commits import Version
from telemetry_lake.sources.lake import through_table

_DAY = StructField("day", IntegerType())


def _schema(spark: SparkSession) -> StructType:
    return gold_states(spark.createDataFrame([], SILVER)).schema


def _states(spark: SparkSession, table: str, version: Version, days: set[int] | None = None) -> DataFrame:
    """The states of the version's days, of some if they are named: only their folders are read."""
    folders = [
        f"{table}/states/part={part['name']}/day={day}"
        for part in version.parts
        for day in part["days"]
        if days is None or day in days
    ]
    schema = _schema(spark)
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{table}/states").parquet(*folders).select(*schema.names)


def add_readings(spark: SparkSession, table: str, silver: DataFrame, query: str, batch: int) -> Version:
    """Add the readings to gold as one batch of a query, once. What reaches the driver is the days they touch."""

    def write(version: Version, name: str) -> dict | None:
        states = through_table(spark, gold_states(silver), "gold_states")
        day = F.unix_date(F.to_date("start")).cast("int")
        days = {r.day for r in states.select(day.alias("day")).distinct().collect()}
        if not days:
            return None
        whole = added_gold_states(states.unionByName(_states(spark, table, version, days))).withColumn("day", day)
        dealt = whole.hint("rebalance", F.col("day"))
        dealt.write.partitionBy("day").parquet(f"{table}/states/part={name}")
        return {"kinds": ["states"], "rows": 0, "days": sorted(days)}

    def remains(part: dict, new: dict) -> dict | None:
        days = [day for day in part["days"] if day not in set(new["days"])]
        return {**part, "days": days} if days else None

    return commits.append(spark, table, write, query, batch, remains)


def read_gold(spark: SparkSession, table: str, version: Version | None = None) -> DataFrame:
    """Gold as of a version, the latest if none is given."""
    return gold_of_states(_states(spark, table, version or commits.latest(spark, table)))
