"""Detection that lets late readings change what was said before.

Readings count where their event time puts them, as in the replay, if they come no later than `delay` behind the
newest one. Until then their stretch stays open: a micro-batch evaluates the open readings of the transformers it
brings again, from the streaks at the horizon, publishes the alerts that were not standing, and withdraws
those that no longer hold. What falls behind the horizon is folded into the streaks and settled. A
reading behind the horizon leaves settled streaks alone and alerts only if critical.

What is open lies in the parts of a table (see `sources.commits`): each batch's readings, what it said, and the
streaks it folded. A batch costs the open readings of its transformers, in slices, so a transformer that owns
a third of them is spread over many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from telemetry_lake.operators.decode import apart, decode_readings
from telemetry_lake.operators.detection import EVENT, alerts_of, as_messages, keyed_readings
from telemetry_lake.schemas import BRONZE, READING_FIELDS, STREAK, AlertRules
from telemetry_lake.sources import commits
from telemetry_lake.sources.commits import Version, read_kind
from telemetry_lake.sources.lake import through_table
from telemetry_lake.sources.tables import publish_batch, run_name
from telemetry_lake.streaming.detector import advance

# Batches between two that write the streaks of all transformers.
WHOLE = 16
_STEP = StructField("step", LongType())
_SAID = StructType(
    [
        StructField("alertId", StringType()),
        StructField("transformerId", StringType()),
        StructField("detectedAt", LongType()),
        StructField("holds", BooleanType()),
        _STEP,
    ]
)
_STREAKS = StructType([*STREAK.fields, _STEP])
WITHDRAWN = StructType([StructField("alertId", StringType()), StructField("detectedAt", LongType())])


@dataclass(frozen=True)
class CorrectionPaths:
    messages: str
    withdrawn: str
    quarantine: str
    table: str
    checkpoint: str


def _latest(rows: DataFrame, key: str) -> DataFrame:
    """Of each key the row of the last step."""
    rest = [name for name in rows.columns if name not in (key, "step")]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*rest), "step").alias("last"))
    return last.select(key, "last.*")


def streaks_at(spark: SparkSession, table: str, version: Version) -> DataFrame:
    """The streaks of all transformers at the version's horizon."""
    parts = tuple(part for part in version.parts if part["streaks"])
    return _latest(read_kind(spark, table, "streaks", parts, _STREAKS).select(*_STREAKS.names), "transformerId").select(*STREAK.names)


def standing(spark: SparkSession, table: str, version: Version) -> DataFrame:
    """`alertId`, `transformerId`, `detectedAt` of the alerts that were said and not withdrawn, where still open."""
    parts = tuple(part for part in version.parts if part["open"])
    said = _latest(read_kind(spark, table, "said", parts, _SAID).select(*_SAID.names), "alertId")
    horizon = version.parts[-1]["horizon"] if version.parts else None
    said = said.where("holds").drop("holds")
    return said if horizon is None else said.where(F.col("detectedAt") > horizon)


def take_batch(
    spark: SparkSession,
    paths: CorrectionPaths,
    readings: DataFrame,
    run: str,
    batch: int,
    delay_millis: int,
    rules: AlertRules = AlertRules(),
    width: int | None = None,
) -> Version:
    """Evaluate one batch of timed readings (a table), once; see the module."""
    table, now = paths.table, F.unix_millis("eventTime")
    columns = [*READING_FIELDS, "partition", "offset", "eventTime"]
    schema = readings.select(*columns).schema

    def write(version: Version, name: str) -> dict | None:
        newest = readings.agg(F.max(now).alias("at")).first().at
        if newest is None:
            return None
        step, before = version.number + 1, version.parts[-1]["horizon"] if version.parts else None
        horizon = newest - delay_millis if before is None else max(before, newest - delay_millis)
        is_open = F.lit(True) if before is None else now > before

        new = readings.select(*columns)
        new.where(is_open).write.parquet(f"{table}/open/part={name}")
        parts = tuple(part for part in version.parts if part["open"])
        rows = read_kind(spark, table, "open", (*parts, {"name": name}), schema).select(*columns).where(is_open)
        state = streaks_at(spark, table, version)
        touched = new.where(is_open).select("transformerId").distinct()

        # What is open came after the horizon, and the streaks lie before it: nothing is late.
        entering = state.join(touched, "transformerId", "left_semi")
        found, _ = advance(rows.join(touched, "transformerId", "left_semi"), entering, EVENT, rules, width, in_order=True)
        found = through_table(spark, found, "found")
        said = standing(spark, table, version).join(touched, "transformerId", "left_semi")
        fresh = found.join(said.select("alertId"), "alertId", "left_anti")
        gone = said.join(found.select("alertId"), "alertId", "left_anti")
        settled = keyed_readings(new.where(~is_open), EVENT, rules, width)
        late = alerts_of(settled.withColumns({"late": F.lit(True), "since": F.lit(None).cast("long")}), rules)

        publish_batch(as_messages(fresh.unionByName(late)), paths.messages, run, batch)
        publish_batch(gone.select(*WITHDRAWN.names), paths.withdrawn, run, batch)
        entry = ["alertId", F.col("source.transformerId").alias("transformerId"), "detectedAt", F.lit(True).alias("holds")]
        entries = fresh.select(*entry).unionByName(gone.withColumn("holds", F.lit(False)))
        entries.withColumn("step", F.lit(step).cast("long")).write.parquet(f"{table}/said/part={name}")

        whole = sum(part["streaks"] for part in version.parts) >= WHOLE
        behind = rows.where(now <= horizon)
        known = state if whole else state.join(behind.select("transformerId").distinct(), "transformerId", "left_semi")
        _, folded = advance(behind, known, EVENT, rules, width, closed=True, in_order=True)
        folded.withColumn("step", F.lit(step).cast("long")).write.parquet(f"{table}/streaks/part={name}")

        last = spark.read.schema(_SAID).parquet(f"{table}/said/part={name}").agg(F.max("detectedAt").alias("at")).first().at
        return {
            "kinds": ["open", "said", "streaks"], "rows": 0, "horizon": horizon, "until": max(newest, last or newest),
            "open": True, "streaks": True, "whole": whole,
        }

    def remains(part: dict, new: dict) -> dict | None:
        kept = {"open": part["open"] and part["until"] > new["horizon"], "streaks": part["streaks"] and not new["whole"]}
        return {**part, **kept} if any(kept.values()) else None

    return commits.append(spark, table, write, run, batch, remains)


def detect_corrected(
    records: DataFrame,
    paths: CorrectionPaths,
    delay: int,
    rules: AlertRules = AlertRules(),
    width: int | None = None,
    bounded: bool = False,
) -> StreamingQuery:
    """Publish alert messages, and withdrawals of some, for a stream of sensor records. `delay` is in milliseconds."""
    run = run_name(paths.checkpoint)

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # One pass over the payloads; a table that is read by columns holds both what is taken and what is refused.
        told_apart = through_table(spark, apart(decode_readings(batch), EVENT.instant), "decoded")
        refused = told_apart.where(F.col("refused")).select(*BRONZE.names)
        publish_batch(refused, paths.quarantine, run, batch_id)
        typed = told_apart.where(~F.col("refused")).drop("refused", "value", "topic")
        take_batch(spark, paths, typed, run, batch_id, delay, rules, width)

    writer = records.writeStream.foreachBatch(step).option("checkpointLocation", paths.checkpoint)
    return (writer.trigger(availableNow=True) if bounded else writer).start()


def holding(messages: DataFrame, withdrawn: DataFrame) -> DataFrame:
    """The decoded alerts that hold after all withdrawals: one may be said, withdrawn and said again."""
    back = withdrawn.groupBy("alertId").agg(F.count("*").alias("back"))
    rest = [name for name in messages.columns if name != "alertId"]
    said = messages.groupBy("alertId").agg(F.count("*").alias("said"), F.first(F.struct(*rest)).alias("alert"))
    held = said.join(back, "alertId", "left").where(F.col("said") > F.coalesce("back", F.lit(0)))
    return held.select("alertId", "alert.*").select(*messages.columns)
