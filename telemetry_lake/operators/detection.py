"""Sustained-streak detection: critical scores alert at once, warnings once a streak lasts.

Per transformer and in order, a streak starts at the first reading at or above the warning
threshold and ends at the next one below it. A critical reading always alerts; a warning alerts
when its streak is at least `window_millis` old. Gaps between readings do not end a streak, and
a streak that has alerted keeps alerting.

Order matters, yet one transformer may own a third of all readings, so no task may need a whole
history. Each history is cut into *slices* by the order itself: a stretch of event time, or a
stretch of offsets of one topic partition. Which slice a reading is in is plain arithmetic on its own
columns, whatever the size of the input.

1. Window functions run per (transformer, slice): the one shuffle of the readings.
2. Every slice is summed up in one row, the rows of a transformer are chained, and the streak
   that is open where a slice begins is handed to it through a join on the same two keys.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemetry_lake.functions.severity import at_least, reason_of, severity_of_score
from telemetry_lake.schemas import ALERT, READING_FIELDS, AlertRules

# Widths of a slice: a day of event time in microseconds, and a stretch of offsets. They decide how
# much of one transformer's history meets in a task, never the answer.
EVENT_WIDTH = 24 * 3600 * 1_000_000
OFFSET_WIDTH = 1_000_000


@dataclass(frozen=True)
class Clock:
    """What orders the readings of a transformer, and which instant counts as "now".

    The order ends with `partition` and `offset`, which makes it total.
    """

    order: tuple[str, ...]
    instant: str
    # Only event time can run backwards between micro-batches.
    can_be_late: bool
    # The default width of a slice.
    width: int

    def slice(self, width: int | None = None) -> Column:
        """The slice of a reading: it never falls along the order."""
        stretch = self.width if width is None else width
        if self.can_be_late:
            return F.struct(F.lit(0).alias("part"), _stretch(F.unix_micros("eventTime"), stretch).alias("stretch"))
        return F.struct(F.col("partition").alias("part"), _stretch(F.col("offset"), stretch).alias("stretch"))


def _stretch(place: Column, width: int) -> Column:
    """Whole widths below a place, exact for 64-bit integers."""
    return ((place - F.pmod(place, F.lit(width))) / width).cast("bigint")


# As the readings arrived: replays give the same answer because the topic keeps its timestamps.
ARRIVAL = Clock(order=("partition", "offset"), instant="kafkaTimestamp", can_be_late=False, width=OFFSET_WIDTH)
# As the sensors saw it.
EVENT = Clock(
    order=("eventTime", "sensorId", "partition", "offset"), instant="eventTime", can_be_late=True, width=EVENT_WIDTH
)


def alert_id(*parts: str) -> Column:
    """Same reading, same id: a replay of the sensor topic cannot create a second alert."""
    return F.sha2(F.concat_ws("|", *[F.col(part).cast("string") for part in parts]), 256)


def keyed_readings(readings: DataFrame, clock: Clock, rules: AlertRules, width: int | None = None) -> DataFrame:
    """Key, slice, order, clock and level of each reading, with the reading itself where it may alert.

    Readings below the warning threshold only end streaks, so their payload is dropped before
    anything is shuffled.
    """
    score = F.col("failureRiskScore")
    level = F.when(at_least(score, rules.critical), 2).when(at_least(score, rules.warning), 1).otherwise(0)
    return readings.select(
        "transformerId",
        clock.slice(width).alias("slice"),
        F.struct(*clock.order).alias("seq"),
        F.unix_millis(clock.instant).alias("now"),
        level.alias("level"),
        F.when(level > 0, F.struct(*READING_FIELDS)).alias("source"),
        F.when(
            level > 0, alert_id("transformerId", "sensorId", "timestamp", "partition", "offset")
        ).alias("alertId"),
    )


def streaks_within_slices(rows: DataFrame) -> DataFrame:
    """Adds `since` (start of the open streak as far as the slice knows) and `broken` (a lower
    reading came before in this slice). Late readings are passed over."""
    window = Window.partitionBy("transformerId", "slice").orderBy("seq")
    running = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = F.when(~F.col("late"), F.col("level"))
    before = F.last(counted, ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, -1))
    starts = (counted > 0) & (F.coalesce(before, F.lit(0)) == 0)
    return (
        rows.withColumn("startedAt", F.when(starts, F.col("now")))
        .withColumn("since", F.last("startedAt", ignorenulls=True).over(running))
        .withColumn("broken", F.coalesce(F.max(counted == 0).over(running), F.lit(False)))
        .drop("startedAt")
    )


def slice_ends(rows: DataFrame) -> DataFrame:
    """One row per slice: does it contain a lower reading, and which streak is open at its end."""
    end = F.struct("broken", F.when(F.col("level") > 0, F.col("since")).alias("since"), "now")
    return (
        rows.filter(~F.col("late"))
        .groupBy("transformerId", "slice")
        .agg(F.max_by(end, F.col("seq")).alias("end"))
        .select("transformerId", "slice", "end.*")
    )


# Slices of one block of the tree over slice ends.
FAN = 1024


def chain(ends: DataFrame, levels: int = 0) -> DataFrame:
    """Adds `carried` (streak open where the slice begins) and `open` (where it ends).

    What a stretch of slices does to a streak is summed up like one slice: a lower reading in any of them, and
    the streak open at the end of those behind the last such. This is associative, so the slices of a
    transformer need not meet in one task: with `levels`, each block of FAN slices is scanned by itself and
    summed up in one row, the blocks are chained in the same way, one level less, and what is open where a
    block begins is handed to its slices.
    """
    block = F.struct(F.col("slice.part").alias("part"), _stretch(F.col("slice.stretch"), FAN).alias("stretch"))
    cut = ["transformerId"] + (["block"] if levels else [])
    rows = ends.withColumn("block", block) if levels else ends
    within = Window.partitionBy(*cut).orderBy("slice")
    running = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # A stretch begins at a slice with a lower reading; the first streak in it is the one open at each of its ends.
    rows = rows.withColumn("stretch", F.sum(F.col("broken").cast("int")).over(running))
    same = Window.partitionBy(*cut, "stretch").orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("open", F.first("since", ignorenulls=True).over(same))
    if not levels:
        return rows.withColumn("carried", F.lag("open").over(within)).drop("stretch")

    last = F.max_by(F.struct((F.col("stretch") > 0).alias("broken"), F.col("open").alias("since"), "now"), F.col("slice"))
    blocks = rows.groupBy(*cut).agg(last.alias("end")).select("transformerId", F.col("block").alias("slice"), "end.*")
    handed = chain(blocks, levels - 1).select("transformerId", F.col("slice").alias("block"), F.col("carried").alias("handed"))
    rows = rows.join(handed.where("handed IS NOT NULL"), cut, "left")
    whole = F.when(F.col("stretch") > 0, F.col("open")).otherwise(F.coalesce("handed", "open"))
    rows = rows.withColumn("open", whole)
    first = F.lag(F.struct("open")).over(within)
    carried = F.when(first.isNull(), F.col("handed")).otherwise(first["open"])
    return rows.withColumn("carried", carried).drop("stretch", "block", "handed")


def alerts_of(rows: DataFrame, rules: AlertRules) -> DataFrame:
    """The alert envelope of every reading that alerts, and the reading's place in the topic.
    Needs `since` resolved across slices."""
    lasted = ~F.col("late") & (F.col("now") - F.col("since") >= rules.window_millis)
    score = F.col("source.failureRiskScore")
    return (
        rows.filter((F.col("level") == 2) | ((F.col("level") == 1) & lasted))
        .withColumn("severity", severity_of_score(score, rules))
        .select(
            "alertId",
            "severity",
            reason_of(score, F.col("severity"), rules).alias("reason"),
            F.col("now").alias("detectedAt"),
            "source",
            "seq.partition",
            "seq.offset",
        )
    )


def resolve(rows: DataFrame, carried: DataFrame) -> DataFrame:
    """The readings that may alert, with `since` replaced by the carried streak before the first break of a slice."""
    handed = carried.filter(F.col("carried").isNotNull()).select("transformerId", "slice", "carried")
    joined = rows.filter(F.col("level") > 0).join(handed, ["transformerId", "slice"], "left")
    return joined.withColumn(
        "since", F.when(~F.col("broken") & F.col("carried").isNotNull(), F.col("carried")).otherwise(F.col("since"))
    )


def detect(
    readings: DataFrame,
    clock: Clock = EVENT,
    rules: AlertRules = AlertRules(),
    width: int | None = None,
    levels: int = 0,
) -> DataFrame:
    """All alerts of a complete set of readings (the replay form of the detector).

    `readings` needs the reading fields and the columns of the clock. They are read twice (slice ends
    and alerts), so pass a table rather than undecoded messages. `width` is that of a slice, in
    microseconds of event time or in offsets; `levels` is that of the tree over the slices (see `chain`), which
    narrow slices need.
    """
    # Nothing is late in a complete set.
    return _detected(keyed_readings(readings, clock, rules, width).withColumn("late", F.lit(False)), rules, levels)


def _detected(keyed: DataFrame, rules: AlertRules, levels: int) -> DataFrame:
    # The payload stays behind where only the slice ends are wanted.
    narrow = keyed.select("transformerId", "slice", "seq", "now", "level", "late")
    carried = chain(slice_ends(streaks_within_slices(narrow)), levels)
    return alerts_of(resolve(streaks_within_slices(keyed), carried), rules)


def detect_by_count(
    readings: DataFrame,
    path: str,
    pieces: int,
    clock: Clock = EVENT,
    rules: AlertRules = AlertRules(),
    levels: int = 0,
) -> DataFrame:
    """The same alerts, with slices of equal numbers of readings, wherever these crowd.

    A slice by width holds all that a transformer sent in it, be it everything it ever sent. Here the order itself
    is range-partitioned into `pieces` and written to `path`: a slice is what a transformer has in
    one piece, so no task of the windows gets more than a piece, and every transformer's slices still follow its order.
    """
    keyed = keyed_readings(readings, clock, rules).withColumn("late", F.lit(False))
    ranged = keyed.repartitionByRange(pieces, "transformerId", "seq")
    # What a sample decides may come out otherwise in a second attempt; once written it stays.
    piece = F.struct(F.lit(0).alias("part"), F.spark_partition_id().cast("bigint").alias("stretch"))
    cut = ranged.withColumn("slice", piece)
    cut.write.mode("overwrite").parquet(path)
    return _detected(readings.sparkSession.read.schema(cut.schema).parquet(path), rules, levels)


def as_messages(alerts: DataFrame, topic: str = "ST2") -> DataFrame:
    """Alerts as topic records: `key` is the transformer, `value` the JSON envelope.

    A reading gives at most one alert, so the reading's place also orders and names its message
    where the topic is a folder.
    """
    return alerts.select(
        F.col("source.transformerId").alias("key"),
        F.to_json(F.struct(*ALERT.names)).alias("value"),
        F.lit(topic).alias("topic"),
        "partition",
        "offset",
        F.timestamp_millis("detectedAt").alias("kafkaTimestamp"),
    )
