"""Sensor topic to alert topic, keeping open streaks between micro-batches.

Each micro-batch runs the sliced detection of `operators.detection`: a keyed state function
would hand all new readings of one busy transformer to one task, while slices spread them. The
open streaks are a table: a batch appends the state of the transformers it brings and reads that of
the same transformers, pruned by a hash of their id; every WHOLE batches it is written as a whole and older
batches go. A batch sees the batches before it only, so repeating it gives the same alerts and state.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from telemetry_lake.operators.decode import decode_readings, quarantined, timed_readings
from telemetry_lake.operators.detection import (
    Clock,
    EVENT,
    alerts_of,
    as_messages,
    chain,
    keyed_readings,
    resolve,
    slice_ends,
    streaks_within_slices,
)
from telemetry_lake.schemas import BRONZE, STREAK, AlertRules
from telemetry_lake.sources.tables import (
    STATE_PLACE,
    buckets_of,
    drop_version,
    publish_batch,
    read_version,
    require_version,
    run_name,
    write_batch,
    write_bucketed,
)

# Batches between two that write the state of all transformers.
WHOLE = 100
MESSAGE_SCHEMA = StructType([StructField("key", StringType()), *BRONZE.fields])


@dataclass(frozen=True)
class DetectorPaths:
    messages: str
    quarantine: str
    readings: str
    streaks: str
    checkpoint: str


def advance(
    readings: DataFrame,
    streaks: DataFrame,
    clock: Clock = EVENT,
    rules: AlertRules = AlertRules(),
    width: int | None = None,
    keep: Callable[[DataFrame], DataFrame] = lambda data: data,
    closed: bool = False,
    in_order: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Alerts of the new readings and the streaks after them.

    A reading older than the last one of its transformer came late: it leaves the streak alone,
    and only a critical one still alerts. `keep` may cache what is used more than once. `closed` keeps
    streaks that ended, to overrule an older state where only changes are stored. `in_order` promises that no
    reading is older than its transformer's state and that `streaks` has a row for a transformer at most, so
    that the state need not be looked up for each slice.
    """
    rows = keyed_readings(readings, clock, rules, width)
    late, state = F.lit(False), streaks
    if not in_order:
        # The old state is handed to slices, not to rows: this join is on (transformer, slice) like
        # the windows after it, so it adds no shuffle of the readings and no heavy key.
        touched = rows.groupBy("transformerId", "slice").agg(F.count(F.lit(1)).alias("rows")).drop("rows")
        state = touched.join(streaks, "transformerId", "left")
        rows = rows.join(state.select("transformerId", "slice", "lastMillis"), ["transformerId", "slice"], "left")
        if clock.can_be_late:
            late = F.coalesce(F.col("now") < F.col("lastMillis"), F.lit(False))
    rows = keep(streaks_within_slices(rows.withColumn("late", late).drop("lastMillis")))

    # An open streak enters the chain as a slice of its own before the first.
    before_all = F.struct(F.lit(-1).alias("part"), F.lit(0).cast("bigint").alias("stretch"))
    entering = state.filter(F.col("since").isNotNull()).select(
        "transformerId", before_all.alias("slice"), F.lit(True).alias("broken"), "since", F.col("lastMillis").alias("now")
    )
    if not in_order:
        entering = entering.distinct()
    chained = keep(chain(slice_ends(rows).unionByName(entering)))
    alerts = alerts_of(resolve(rows, chained.filter("slice.part >= 0")), rules)

    after = chained.groupBy("transformerId").agg(
        F.max_by("open", "slice").alias("newSince"), F.max("now").alias("newMillis")
    )
    updated = streaks.join(after, "transformerId", "full_outer").select(
        "transformerId",
        F.when(F.col("newMillis").isNotNull(), F.col("newSince")).otherwise(F.col("since")).alias("since"),
        F.greatest("lastMillis", "newMillis").alias("lastMillis"),
    )
    if not clock.can_be_late and not closed:
        # Without late readings only open streaks need remembering.
        updated = updated.filter(F.col("since").isNotNull())
    return alerts, updated.select(*STREAK.names)


def streaks_before(
    spark: SparkSession, path: str, run: str, batch: int, readings: DataFrame | None
) -> DataFrame:
    """The state that a batch starts from, of the transformers in `readings` or of all.

    Empty before the first batch; later the batch before must have been written in full.
    """
    if batch == 0:
        return spark.createDataFrame([], STREAK)
    require_version(spark, path, run, batch - 1)
    since = (batch - 1) // WHOLE * WHOLE
    rows = spark.read.schema(StructType([*STREAK.fields, *STATE_PLACE])).parquet(path)
    rows = rows.filter((F.col("run") == run) & F.col("batch").between(since, batch - 1))
    if readings is not None:
        rows = rows.filter(F.col("bucket").isin(buckets_of(readings, "transformerId")))
        rows = rows.join(readings.select("transformerId").distinct(), "transformerId", "left_semi")
    rest = [name for name in STREAK.names if name != "transformerId"]
    latest = rows.groupBy("transformerId").agg(F.max_by(F.struct(*rest), F.col("batch")).alias("state"))
    return latest.select("transformerId", "state.*").select(*STREAK.names)


def detect_stream(
    records: DataFrame,
    paths: DetectorPaths,
    clock: Clock = EVENT,
    rules: AlertRules = AlertRules(),
    width: int | None = None,
    bounded: bool = False,
) -> StreamingQuery:
    """Write alert messages for a stream of sensor records; refused records go to the quarantine
    folder as they came. The message folder can feed `file_stream` of the handler."""
    run = run_name(paths.checkpoint)

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        cached: list[DataFrame] = []

        def keep(data: DataFrame) -> DataFrame:
            cached.append(data.persist())
            return cached[-1]

        decoded = keep(decode_readings(batch))
        try:
            refused = quarantined(decoded, BRONZE.names, clock.instant)
            publish_batch(refused, paths.quarantine, run, batch_id)
            # Detection reads its input twice: give it a narrow typed table.
            typed = timed_readings(decoded, clock.instant)
            write_batch(typed, paths.readings, run, batch_id)
            readings = read_version(spark, paths.readings, typed.schema, run, batch_id)
            whole = batch_id % WHOLE == 0
            before = streaks_before(spark, paths.streaks, run, batch_id, None if whole else readings)
            alerts, after = advance(readings, before, clock, rules, width, keep, closed=not whole)
            publish_batch(as_messages(alerts), paths.messages, run, batch_id)
            write_bucketed(after, paths.streaks, run, batch_id, "transformerId")
            drop_version(spark, paths.readings, run, batch_id)
            if batch_id % WHOLE == 1:
                # The batch before wrote everything; no retry looks further back.
                for version in range(batch_id - 1 - WHOLE, batch_id - 1):
                    drop_version(spark, paths.streaks, run, version)
        finally:
            for data in cached:
                data.unpersist()

    writer = records.writeStream.foreachBatch(step).option("checkpointLocation", paths.checkpoint)
    return (writer.trigger(availableNow=True) if bounded else writer).start()
