"""

All queries read the given `events` and `region` tables whole. `telemetry_lake.sources` maps
events to sensor readings and alert messages; the SQL repeats that mapping.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telemetry_lake.functions import scoring, severity, text
from telemetry_lake.operators import history as alerts
from telemetry_lake.operators import outbox as notes
from telemetry_lake.operators import questions
from telemetry_lake.operators.decode import accepted, decode_alerts, decode_readings, quarantined, timed_readings
from telemetry_lake.operators.detection import ARRIVAL, EVENT, Clock, as_messages, detect, detect_by_count
from telemetry_lake.operators.gold import to_gold
from telemetry_lake.operators.silver import parse_text_readings, to_silver
from telemetry_lake.plans.analytics import answer_all
from telemetry_lake.plans.datalake import build_layers, layer_counts
from telemetry_lake.schemas import BRONZE, NUMBER_FIELDS, READING_FIELDS, AlertRules
from telemetry_lake.session import configure, scratch_dir
from telemetry_lake.sources import alert_store, commits, event_alerts, event_readings, gold_store, ledger_store
from telemetry_lake.sources.bronze import bound_of, first_records, object_stream, offset_gaps, read_bronze, read_landed, write_objects
from telemetry_lake.sources.lake import through_table
from telemetry_lake.sources.tables import read_table, run_name
from telemetry_lake.sources.topics import file_stream
from telemetry_lake.streaming.corrections import WITHDRAWN, CorrectionPaths, detect_corrected, holding
from telemetry_lake.streaming.detector import MESSAGE_SCHEMA, DetectorPaths, detect_stream
from telemetry_lake.streaming.handler import HandlerPaths, handle_stream, record_results
from telemetry_lake.streaming.landing import land
from telemetry_lake.streaming.rollup import roll_up

# The folders of the training-data operators may be absent; everything else works without them.
try:
    from telemetry_lake.llm import queries as llm
except ImportError:
    llm = None
try:
    import corpus_pipeline as corpus
except ImportError:
    corpus = None

Query = Callable[[SparkSession, str], DataFrame]

# Readings of one transformer are about 11 hours apart in the sample, so 30 seconds would make
# every second high reading sustained.
SAMPLE_RULES = AlertRules(window_millis=6 * 3600 * 1000)
HALF_DAY = 12 * 3600 * 1_000_000
RECIPIENTS = "ops@example.com; grid@example.com,\n ops@example.com\r\n"
NOW = "2024-02-01 00:00:00"
EARLIER = "2024-01-31 00:00:00"


# ---------------------------------------------------------------- lake and questions


def _silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    return to_silver(parse_text_readings(event_readings.sample_bronze(spark, sf_dir)))


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_gold(_silver(spark, sf_dir))


def _plain_times(data: DataFrame) -> DataFrame:
    """Timestamps without zone, as the SQL side has them."""
    return data.select(
        *[
            F.col(name).cast("timestamp_ntz").alias(name) if kind == "timestamp" else F.col(name)
            for name, kind in data.dtypes
        ]
    )


def silver_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alert flag as text: it has three values, and null must compare as null everywhere."""
    return _plain_times(_silver(spark, sf_dir)).withColumn("isAlert", F.col("isAlert").cast("string"))


def gold_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain_times(_gold(spark, sf_dir))


def _question(ask: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: _plain_times(ask(_gold(spark, sf_dir)))


def _report(ask: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: questions.report_preview(ask(_gold(spark, sf_dir)))


def lake_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold after both layers went through Parquet."""
    configure(spark)
    bronze = event_readings.sample_bronze(spark, sf_dir)
    folder = scratch_dir(spark, "lake")
    _, gold = build_layers(bronze, f"{folder}/silver", f"{folder}/gold")
    return _plain_times(gold)


def gold_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold kept by a stream to which the readings come in four drops, every hour spread over all of them."""
    bronze = through_table(configure(spark), event_readings.sample_bronze(spark, sf_dir), "bronze")
    folder = scratch_dir(spark, "rollup")

    def run() -> None:
        records = file_stream(spark, f"{folder}/topic")
        roll_up(records, f"{folder}/gold", f"{folder}/checkpoint", bounded=True).awaitTermination()

    _in_drops(bronze, f"{folder}/topic", [F.col("offset") % 4 == k for k in (2, 0, 3, 1)], run)
    return _plain_times(gold_store.read_gold(spark, f"{folder}/gold"))


def statistics_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transformer ranking as saved in JSON."""
    saved = answer_all(_gold(spark, sf_dir), scratch_dir(spark, "stats"))
    return saved["transformers-most-alerts"]


def layer_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    bronze = through_table(configure(spark), event_readings.sample_bronze(spark, sf_dir), "bronze")
    folder = scratch_dir(spark, "lake")
    silver, gold = build_layers(bronze, f"{folder}/silver", f"{folder}/gold")
    sizes = layer_counts(bronze, silver, gold)
    return spark.createDataFrame(list(sizes.items()), "layer string, rows bigint")


def gold_wide_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold over voltages of which every fifth is too large for the stable mean's decimals."""
    silver = _silver(spark, sf_dir)
    number = F.regexp_extract("sensorId", r"(\d+)$", 1).cast("bigint")
    wide = F.when(number % 5 == 0, F.col("voltage") * 1e9).otherwise(F.col("voltage"))
    gold = to_gold(silver.withColumn("voltage", wide))
    return _plain_times(
        gold.select("transformerId", "region", "windowStart", F.floor("voltage").alias("voltage"), "measurementCount")
    )


def _topic(spark: SparkSession, sf_dir: str, *parts: Column) -> tuple[str, DataFrame]:
    """A scratch folder whose `topic` holds the given parts of the sample bronze, one file drop each."""
    bronze = through_table(configure(spark), event_readings.sample_bronze(spark, sf_dir), "bronze")
    folder = scratch_dir(spark, "topic")
    for part in parts:
        bronze.filter(part).write.mode("append").parquet(f"{folder}/topic")
    return folder, bronze


def _payload() -> list[Column]:
    """Every field of the raw message, numbers as such."""
    raw = {name: F.get_json_object("value", f"$.{name}") for name in READING_FIELDS}
    return [(c.cast("double") if name in NUMBER_FIELDS else c).alias(name) for name, c in raw.items()]


def _landed(spark: SparkSession, folder: str) -> DataFrame:
    return _plain_times(read_landed(spark, f"{folder}/bronze")).select(
        "topic",
        "partition",
        "offset",
        "kafkaTimestamp",
        *_payload(),
    )


def bronze_two_landings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two checkpoints land overlapping parts of one topic into one folder."""
    day = F.dayofmonth("kafkaTimestamp")
    folder, bronze = _topic(spark, sf_dir, day <= 12)
    bronze.filter(day > 8).write.parquet(f"{folder}/other")
    for source, checkpoint in (("topic", "first"), ("other", "second"), ("topic", "third")):
        stream = file_stream(spark, f"{folder}/{source}")
        land(stream, f"{folder}/bronze", f"{folder}/{checkpoint}", bounded=True).awaitTermination()
    return _landed(spark, folder)


def objects_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The readings as one object per record, landed from there in two batches, and read back; gaps in the
    offsets that a partition should have all of are reported with the records."""
    bronze = through_table(configure(spark), event_readings.sample_bronze(spark, sf_dir), "bronze")
    folder = scratch_dir(spark, "objects")
    for half in (F.col("offset") % 2 == 0, F.col("offset") % 2 == 1):
        write_objects(bronze.filter(half), f"{folder}/objects")
        stream = object_stream(spark, f"{folder}/objects", topic=event_readings.TOPIC)
        land(stream, f"{folder}/bronze", f"{folder}/checkpoint", bounded=True).awaitTermination()
    landed = read_bronze(spark, f"{folder}/bronze")
    missing = offset_gaps(landed).groupBy("partition").agg(F.sum(F.col("high") - F.col("low") + 1).alias("missing"))
    return landed.join(missing, "partition", "left").select(
        "topic", "partition", "offset", *_payload(), F.coalesce("missing", F.lit(0)).alias("missing")
    )


def bounded_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 777 records of bronze, by offset, as silver; an unreadable bound would take all."""
    bronze = through_table(configure(spark), event_readings.sample_bronze(spark, sf_dir), "bronze")
    taken = first_records(first_records(bronze, bound_of("all")), bound_of("777"))
    return _plain_times(taken).select("partition", "offset", *_payload())


def bounded_landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A backlog landed one file a micro-batch."""
    day = F.dayofmonth("kafkaTimestamp")
    folder, _ = _topic(spark, sf_dir, day <= 10, (day > 10) & (day <= 20), day > 20)
    stream = file_stream(spark, f"{folder}/topic", 1)
    land(stream, f"{folder}/bronze", f"{folder}/checkpoint", bounded=True).awaitTermination()
    return _landed(spark, folder)


def fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One topic landed and watched by two queries with a checkpoint each."""
    day = F.dayofmonth("kafkaTimestamp")
    folder, _ = _topic(spark, sf_dir, day <= 16, day > 16)
    paths = DetectorPaths(*[f"{folder}/{name}" for name in ("messages", "quarantine", "readings", "streaks", "watch")])
    queries = [
        land(file_stream(spark, f"{folder}/topic"), f"{folder}/bronze", f"{folder}/land", bounded=True),
        detect_stream(file_stream(spark, f"{folder}/topic"), paths, EVENT, SAMPLE_RULES, bounded=True),
    ]
    for query in queries:
        query.awaitTermination()
    landed = read_landed(spark, f"{folder}/bronze").groupBy("partition").agg(F.count("*").alias("records"))
    alerts = read_table(spark, paths.messages, MESSAGE_SCHEMA).groupBy("partition").agg(F.count("*").alias("alerts"))
    return landed.join(alerts, "partition", "left")


def bronze_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stream the events through the landing query and read bronze back."""
    configure(spark)
    folder = scratch_dir(spark, "landing")
    stream = (
        spark.readStream.schema(event_readings.EVENTS_SCHEMA)
        .option("pathGlobFilter", "events.parquet")
        .parquet(sf_dir)
    )
    records = event_readings.bronze_of(
        event_readings.readings_of(stream, event_readings.regions(spark, sf_dir))
    ).withColumn("value", F.concat(F.lit("\n"), F.col("value"), F.lit("\r\n")))
    land(records, f"{folder}/bronze", f"{folder}/checkpoint", bounded=True).awaitTermination()
    landed = read_landed(spark, f"{folder}/bronze")
    return _plain_times(
        landed.select(
            "topic",
            "partition",
            "offset",
            "kafkaTimestamp",
            *_payload(),
            F.contains("value", F.lit("\n")).alias("hasNewline"),
        )
    )


# ---------------------------------------------------------------- scoring and decoding


def risk_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    readings = event_readings.readings_of(
        event_readings.events(spark, sf_dir), event_readings.regions(spark, sf_dir)
    )
    score = scoring.risk_score(F.col("voltage"), F.col("temperature"), F.col("load"))
    return readings.select("eventId", score.alias("riskScore")).select(
        "eventId",
        "riskScore",
        scoring.round2(F.col("riskScore")).alias("roundedScore"),
        scoring.status_of_score(F.col("riskScore")).alias("status"),
    )


def score_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    readings = event_readings.readings_of(
        event_readings.events(spark, sf_dir), event_readings.regions(spark, sf_dir)
    )
    score = F.col("failureRiskScore")
    return readings.withColumn("severity", severity.severity_of_score(score)).select(
        "eventId",
        "severity",
        F.when(F.col("severity").isNotNull(), severity.reason_of(score, F.col("severity"))).alias("reason"),
    )


def readings_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    decoded = accepted(decode_readings(event_readings.sample_bronze(spark, sf_dir)))
    return decoded.select("partition", "offset", *READING_FIELDS)


def readings_quarantined(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    decoded = decode_readings(event_readings.sample_bronze(spark, sf_dir))
    return quarantined(decoded, BRONZE.names).select("partition", "offset", *_payload())


# ---------------------------------------------------------------- detection


def _flat_alerts(found: DataFrame) -> DataFrame:
    return found.select(
        "alertId",
        "severity",
        "reason",
        "detectedAt",
        F.col("source.transformerId").alias("transformerId"),
        F.col("source.sensorId").alias("sensorId"),
        F.col("source.region").alias("region"),
        F.col("source.failureRiskScore").alias("failureRiskScore"),
    )


def _detect(clock: Clock, **options: int) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bronze = event_readings.sample_bronze(configure(spark), sf_dir)
        readings = through_table(spark, timed_readings(decode_readings(bronze), clock.instant), "readings")
        return _flat_alerts(detect(readings, clock, SAMPLE_RULES, **options))

    return run


def detect_batch_by_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices of equal numbers of readings, chained by a tree."""
    bronze = event_readings.sample_bronze(configure(spark), sf_dir)
    readings = through_table(spark, timed_readings(decode_readings(bronze), EVENT.instant), "readings")
    pieces = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return _flat_alerts(detect_by_count(readings, scratch_dir(spark, "pieces"), pieces, EVENT, SAMPLE_RULES, levels=1))


def _in_drops(bronze: DataFrame, folder: str, parts: list, run: Callable[[], None]) -> None:
    """Append the parts one after the other to `folder`, running the stream after each."""
    for part in parts:
        bronze.filter(part).write.mode("append").parquet(folder)
        run()


def detect_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming detector over bronze that arrives week by week, restarted in between."""
    bronze = through_table(configure(spark), event_readings.sample_bronze(spark, sf_dir), "bronze")
    folder = scratch_dir(spark, "detector")
    paths = DetectorPaths(
        messages=f"{folder}/messages",
        quarantine=f"{folder}/quarantine",
        readings=f"{folder}/readings",
        streaks=f"{folder}/streaks",
        checkpoint=f"{folder}/checkpoint",
    )

    def run() -> None:
        records = file_stream(spark, f"{folder}/topic")
        detect_stream(records, paths, EVENT, SAMPLE_RULES, HALF_DAY, bounded=True).awaitTermination()

    day = F.dayofmonth("kafkaTimestamp")
    weeks = [day <= 8, (day > 8) & (day <= 16), (day > 16) & (day <= 24), day > 24]
    _in_drops(bronze, f"{folder}/topic", weeks, run)
    return _flat_alerts(accepted(decode_alerts(read_table(spark, paths.messages, MESSAGE_SCHEMA))))


def detect_stream_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings that come up to five days late, in drops by arrival: what holds at the end."""
    bronze = through_table(configure(spark), event_readings.sample_bronze(spark, sf_dir), "bronze")
    folder = scratch_dir(spark, "corrections")
    names = ("messages", "withdrawn", "quarantine", "table", "checkpoint")
    paths = CorrectionPaths(*[f"{folder}/{name}" for name in names])

    def run() -> None:
        records = file_stream(spark, f"{folder}/topic")
        delay = 6 * 24 * 3600 * 1000
        detect_corrected(records, paths, delay, SAMPLE_RULES, bounded=True).awaitTermination()

    arrival = F.dayofmonth("kafkaTimestamp") + F.pmod(F.col("offset") * 7, F.lit(5))
    drops = [arrival <= 9, (arrival > 9) & (arrival <= 17), (arrival > 17) & (arrival <= 25), arrival > 25]
    _in_drops(bronze, f"{folder}/topic", drops, run)
    said = accepted(decode_alerts(read_table(spark, paths.messages, MESSAGE_SCHEMA)))
    withdrawn = read_table(spark, paths.withdrawn, WITHDRAWN)
    return _flat_alerts(holding(said.select("alertId", "severity", "reason", "detectedAt", "source"), withdrawn))


def alert_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alert messages by topic key, decoded again, whole."""
    bronze = event_readings.sample_bronze(configure(spark), sf_dir)
    readings = through_table(spark, timed_readings(decode_readings(bronze)), "readings")
    messages = as_messages(detect(readings, EVENT, SAMPLE_RULES))
    decoded = accepted(decode_alerts(messages))
    return decoded.select("key", "topic", "partition", "offset", "alertId", "severity", "reason", "detectedAt", *[F.col("source")[n].alias(n) for n in READING_FIELDS])


def alert_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alert messages by topic key, decoded again."""
    bronze = event_readings.sample_bronze(configure(spark), sf_dir)
    readings = through_table(spark, timed_readings(decode_readings(bronze)), "readings")
    decoded = accepted(decode_alerts(as_messages(detect(readings, ARRIVAL, SAMPLE_RULES))))
    return decoded.groupBy("key").agg(
        F.count(F.lit(1)).alias("messages"),
        F.min("detectedAt").alias("firstDetectedAt"),
        F.max("source.failureRiskScore").alias("highestScore"),
    )


# ---------------------------------------------------------------- history


def _flat_history(rows: DataFrame) -> DataFrame:
    return rows.select(
        "alertId",
        "severity",
        "originalSeverity",
        "reason",
        "detectedAt",
        "region",
        F.col("source.sensorId").alias("sensorId"),
        "partition",
        "offset",
    )


def alert_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_history(alerts.first_arrivals(event_alerts.sample_arrivals(configure(spark), sf_dir)))


# Where the sample's history is stored, by application and data.
_STORES: dict[tuple[str, str], str] = {}


def _stored_history(spark: SparkSession, sf_dir: str) -> str:
    """The folder of the alert history, stored once in a session: the topic's partitions arrive as two batches,
    each of them twice."""
    configure(spark)
    place = spark.sparkContext.applicationId, sf_dir
    if place not in _STORES or not commits.exists(spark, f"{_STORES[place]}/versions"):
        folder = scratch_dir(spark, "history")
        arrived = through_table(spark, event_alerts.sample_arrivals(spark, sf_dir), "arrivals")
        for batch in (0, 0, 1, 1):
            rows = arrived.filter(F.col("partition").between(3 * batch, 3 * batch + 2))
            alert_store.insert_absent(spark, folder, alerts.first_arrivals(rows), "sample", batch)
        _STORES[place] = folder
    return _STORES[place]


def _of_store(ask: Callable[[SparkSession, str], DataFrame], flat: bool = True) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        answer = ask(spark, _stored_history(spark, sf_dir))
        return _flat_history(answer) if flat else answer

    return run


def history_while_merging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts by region as a reader finds them before, during (of the version it holds) and after a merge that
    another batch comes in between."""
    arrived = through_table(configure(spark), event_alerts.sample_arrivals(spark, sf_dir), "arrivals")
    folder = scratch_dir(spark, "history")

    def bring(batch: int) -> commits.Version:
        rows = alerts.first_arrivals(arrived.filter(F.col("partition") == batch))
        return alert_store.insert_absent(spark, folder, rows, "sample", batch)

    for batch in range(5):
        held = bring(batch)
    found = {"before": alert_store.alerts(spark, folder, held)}
    bring(5)
    merged = alert_store.compact(spark, folder, 2)
    found |= {"during": alert_store.alerts(spark, folder, held), "after": alert_store.alerts(spark, folder, merged)}
    parts = [rows.groupBy("region").count().withColumn("moment", F.lit(moment)) for moment, rows in found.items()]
    return functools.reduce(DataFrame.unionByName, parts).select("moment", "region", F.col("count").alias("alerts"))


def claims_of_two_handlers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two handlers claim the same notifications from one state of the ledger, in both orders. One of them had an
    old claim, which is taken over; the results of its sender come late and change nothing."""
    configure(spark)
    arrived = through_table(spark, event_alerts.sample_arrivals(spark, sf_dir), "arrivals")
    history = through_table(spark, alerts.first_arrivals(arrived), "history")
    ids = arrived.filter(F.col("severity") == severity.CRITICAL).select("alertId").distinct()
    old = _old_ledger(history)
    found = []
    for first, second in (("a", "b"), ("b", "a")):
        folder = scratch_dir(spark, "ledger")
        ledger_store.append_step(spark, folder, ids, lambda _: old, "earlier", 0)

        def claim(ledger: DataFrame) -> DataFrame:
            prepared = notes.prepare(ids, ledger, F.lit(NOW))
            return prepared.unionByName(notes.claim(ids, history, ledger, F.lit(NOW), "1 hour"))

        done = []

        def other() -> None:
            # The second handler has read the ledger, and the first commits before it does.
            if not done:
                done.append(first)
                ledger_store.append_step(spark, folder, ids, claim, first, 0)

        last = ledger_store.append_step(spark, folder, ids, claim, second, 0, before=other)
        for owner, revision in (("stale", 0), (first, 2)):
            sent = ledger_store.entries_of(spark, folder, last, ids).filter((F.col("status") == notes.SENDING) & (F.col("revision") == revision))
            results = sent.select("alertId", F.lit(owner).alias("error"), F.lit(0).alias("sequence"), "revision")
            ledger_store.append_step(
                spark, folder, ids, lambda ledger: notes.record(results, history, ledger, F.lit(NOW)), f"results of {owner}", 0
            )
        entries = ledger_store.entries(spark, folder)
        claims = entries.filter((F.col("status") == notes.SENDING) & (F.col("updatedAt") == F.lit(NOW).cast("timestamp")))
        owners = claims.groupBy("alertId").agg(F.count("*").alias("claims"), F.max("owner").alias("owner"))
        state = notes.ledger_state(entries).join(owners, "alertId")
        found.append(state.select(F.lit(first).alias("first"), "alertId", "claims", "owner", "status", "error", "revision"))
    return found[0].unionByName(found[1])


def alerts_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = decode_alerts(event_alerts.sample_messages(configure(spark), sf_dir))
    fields = {name: F.col(name) for name in ("alertId", "severity", "reason", "detectedAt")}
    fields |= {name: F.col("source")[name] for name in READING_FIELDS}
    read = [F.when(F.col("isValid"), value).alias(name) for name, value in fields.items()]
    return decoded.select("partition", "offset", "isValid", *read)


def alert_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored alerts through their JSON texts, as an operator's query gets them."""
    arrived = event_alerts.sample_arrivals(configure(spark), sf_dir)
    alerts_again = alerts.read_payloads(arrived.select(alerts.payload().alias("value")))
    return alerts_again.select(
        "alertId", "severity", "originalSeverity", F.col("reason").alias("why"), "detectedAt", *[F.col("source")[n].alias(n) for n in READING_FIELDS]
    )


def stored_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_history(event_alerts.sample_arrivals(configure(spark), sf_dir))


def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all messages add to a history that already holds the topic's even partitions."""
    arrived = event_alerts.sample_arrivals(configure(spark), sf_dir)
    before = alerts.first_arrivals(arrived.filter(F.col("partition") % 2 == 0))
    return _flat_history(alerts.not_yet_stored(alerts.first_arrivals(arrived), before))


def severity_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrived = event_alerts.sample_arrivals(configure(spark), sf_dir)
    word = F.col("originalSeverity")
    return arrived.select(
        "offset",
        severity.severity_category(word).alias("category"),
        severity.severity_display(word).alias("display"),
        severity.badge_class(F.col("severity")).alias("badge"),
    )


def alert_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrived = event_alerts.sample_arrivals(configure(spark), sf_dir)
    return alerts.actions(arrived).select("alertId", "offset", "step", "action")


def alert_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.log_lines(event_alerts.sample_arrivals(configure(spark), sf_dir)).select("offset", "logLine")


# ---------------------------------------------------------------- notifications


def address_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.format_string(" u%d@x.org;v%d@x.org,\n\r%s ,u%d@x.org", "user_id", "user_id", "event_type", "user_id")
    return event_readings.events(configure(spark), sf_dir).select(
        "event_id", F.array_join(text.address_list(raw), " ").alias("addresses")
    )


def _old_ledger(history: DataFrame) -> DataFrame:
    """Earlier notifications of the critical alerts: one in four each SENT, FAILED, SENDING, none."""
    quarter = F.col("offset") % 4
    status = F.when(quarter == 0, notes.SENT).when(quarter == 1, notes.FAILED).when(quarter == 2, notes.SENDING)
    return (
        history.filter(F.col("severity") == severity.CRITICAL)
        .select(
            "alertId",
            status.alias("status"),
            F.when(quarter == 1, "mailbox unavailable").alias("error"),
            F.lit(EARLIER).cast("timestamp").alias("updatedAt"),
            F.lit(0).cast("bigint").alias("revision"),
        )
        .filter(F.col("status").isNotNull())
    )


def _notified(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """History, notifications due, and the ledger after one round of prepare, claim and delivery."""
    configure(spark)
    arrived = through_table(spark, event_alerts.sample_arrivals(spark, sf_dir), "arrivals")
    history = through_table(spark, alerts.first_arrivals(arrived), "history")
    ledger = _old_ledger(history)
    # The topic's messages arrive once more as one batch.
    critical = arrived.filter(F.col("severity") == severity.CRITICAL)
    now = F.lit(NOW)
    prepared = notes.prepare(critical, ledger, now)
    claimed = through_table(spark, notes.claim(critical, history, ledger, now), "claims")
    failed = F.when(F.col("offset") % 3 == 0, "connection refused")
    results = history.join(claimed.select("alertId"), "alertId", "left_semi").select(
        "alertId", failed.alias("error"), F.lit(2).alias("sequence")
    )
    # Some deliveries were tried before with another outcome; the last one counts.
    early = F.when(F.col("sequence") % 2 == 0, F.when(F.col("error").isNull(), "timeout"))
    results = results.unionByName(results.select("alertId", early.alias("error"), F.lit(1).alias("sequence")))
    ledger = ledger.unionByName(prepared).unionByName(claimed)
    due = notes.outbox(claimed, critical, RECIPIENTS)
    return history, due, ledger.unionByName(notes.record(results, history, ledger, now))


def notification_outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, due, _ = _notified(spark, sf_dir)
    return due.withColumn("recipients", F.array_join("recipients", " "))


def outbox_after_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed notifications whose alerts arrive again with another region: the new payload is sent."""
    configure(spark)
    arrived = through_table(spark, event_alerts.sample_arrivals(spark, sf_dir), "arrivals")
    history = through_table(spark, alerts.first_arrivals(arrived), "history")
    failed = history.filter(F.col("severity") == severity.CRITICAL).select(
        "alertId",
        F.lit(notes.FAILED).alias("status"),
        F.lit("timeout").alias("error"),
        F.lit(EARLIER).cast("timestamp").alias("updatedAt"),
        F.lit(0).cast("bigint").alias("revision"),
    )
    place = F.concat(F.lit("new "), F.col("region"))
    again = arrived.filter(F.col("severity") == severity.CRITICAL).withColumn(
        "source", F.col("source").withField("region", place)
    )
    claims = notes.claim(again, history, failed, F.lit(NOW))
    return notes.outbox(claims, again, RECIPIENTS).select("alertId", "detectedAt", "subject")


def notification_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    history, _, ledger = _notified(spark, sf_dir)
    return _plain_times(notes.ledger_report(history, ledger))


def notification_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    history, _, ledger = _notified(spark, sf_dir)
    return notes.notification_audit(history, ledger, "FILE notification written").select("alertId", "entry")


def handler_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming handler over messages in two drops, replayed whole by a second query, with
    the deliveries of the first query recorded in between."""
    messages = through_table(configure(spark), event_alerts.sample_messages(spark, sf_dir), "messages")
    folder = scratch_dir(spark, "handler")

    def paths(name: str) -> HandlerPaths:
        return HandlerPaths(
            history=f"{folder}/history",
            ledger=f"{folder}/ledger",
            outbox=f"{folder}/outbox",
            quarantine=f"{folder}/quarantine",
            checkpoint=f"{folder}/{name}",
        )

    def run(name: str) -> None:
        records = file_stream(spark, f"{folder}/topic")
        handle_stream(records, paths(name), RECIPIENTS, F.lit(NOW), bounded=True).awaitTermination()

    early = F.dayofmonth("kafkaTimestamp") <= 15
    _in_drops(messages, f"{folder}/topic", [early, ~early], lambda: run("first"))
    outbox = spark.read.parquet(f"{folder}/outbox")
    results = outbox.select("alertId", F.lit(None).cast("string").alias("error"), F.lit(0).alias("sequence"))
    record_results(results, paths("first"), run_name("deliveries"), 0, F.lit(NOW))
    run("second")
    history = alert_store.alerts(spark, f"{folder}/history")
    ledger = ledger_store.entries(spark, f"{folder}/ledger")
    return notes.ledger_report(history, ledger).select("alertId", "severity", "detectedAt", "status")


# ---------------------------------------------------------------- contract


def entry(spark: SparkSession) -> DataFrame:
    """Flagship query: regions ranked by failure risk."""
    return queries()["regions_highest_risk"](spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Query]:
    """All registered queries; the training-data ones only where their code is present."""
    return _lake_queries() | (llm.QUERIES if llm else {}) | ({"pipeline": corpus.run} if corpus else {})


def _lake_queries() -> dict[str, Query]:
    return {
        "silver_clean": silver_clean,
        "gold_hourly": gold_hourly,
        "regions_highest_risk": _question(questions.regions_highest_risk),
        "transformers_most_alerts": _question(questions.transformers_most_alerts),
        "average_load_by_hour": _question(questions.average_load_by_hour),
        "failure_risk_trend": _question(questions.failure_risk_trend),
        "report_regions": _report(questions.regions_highest_risk),
        "report_transformers": _report(questions.transformers_most_alerts),
        "report_load": _report(questions.average_load_by_hour),
        "report_trend": _report(questions.failure_risk_trend),
        "lake_round_trip": lake_round_trip,
        "statistics_round_trip": statistics_round_trip,
        "layer_counts": layer_sizes,
        "gold_wide_values": gold_wide_values,
        "gold_incremental": gold_incremental,
        "bronze_round_trip": bronze_round_trip,
        "bronze_two_landings": bronze_two_landings,
        "bounded_landing": bounded_landing,
        "bounded_records": bounded_records,
        "objects_round_trip": objects_round_trip,
        "fan_out": fan_out,
        "risk_score": risk_score,
        "score_severity": score_severity,
        "readings_accepted": readings_accepted,
        "readings_quarantined": readings_quarantined,
        "detect_batch": _detect(EVENT),
        "detect_batch_small_slices": _detect(EVENT, width=HALF_DAY),
        "detect_batch_arrival": _detect(ARRIVAL),
        "detect_batch_by_count": detect_batch_by_count,
        "detect_stream": detect_streamed,
        "detect_stream_late": detect_stream_late,
        "alert_envelopes": alert_envelopes,
        "alert_messages": alert_messages,
        "alerts_decoded": alerts_decoded,
        "alert_payloads": alert_payloads,
        "stored_alerts": stored_alerts,
        "alert_history": alert_history,
        "history_stored": _of_store(alert_store.alerts),
        "insert_if_absent": insert_if_absent,
        "history_while_merging": history_while_merging,
        "alerts_newest_first": _of_store(lambda spark, folder: alerts.newest_first(alert_store.alerts(spark, folder))),
        "alerts_recent": _of_store(alert_store.recent),
        "alerts_latest_panel": _of_store(
            lambda spark, folder: alerts.latest_panel(alert_store.recent(spark, folder, alerts.LATEST_LIMIT)), flat=False
        ),
        "alerts_critical": _of_store(lambda spark, folder: alerts.critical_only(alert_store.alerts(spark, folder))),
        "alerts_by_region": _of_store(lambda spark, folder: alert_store.in_region(spark, folder, " europe")),
        "alerts_without_region": _of_store(lambda spark, folder: alert_store.in_region(spark, folder, "  ")),
        "alert_counts": _of_store(
            lambda spark, folder: alert_store.counts(alert_store.counters(spark, folder)), flat=False
        ),
        "alert_counts_by_region": _of_store(
            lambda spark, folder: alert_store.counts_by_region(alert_store.counters(spark, folder)), flat=False
        ),
        "service_summary": _of_store(
            lambda spark, folder: alerts.service_summary(alert_store.alerts(spark, folder), event_alerts.TOPIC), flat=False
        ),
        "severity_words": severity_words,
        "alert_actions": alert_actions,
        "alert_log_lines": alert_log_lines,
        "address_lists": address_lists,
        "notification_outbox": notification_outbox,
        "outbox_after_failure": outbox_after_failure,
        "notification_ledger": notification_ledger,
        "notification_audit": notification_audit,
        "claims_of_two_handlers": claims_of_two_handlers,
        "handler_stream": handler_streamed,
    }


# ---------------------------------------------------------------- SQL for comparison

_READINGS = """
readings AS (
  SELECT event_id, user_id, ts, user_id % 6 AS topic_partition,
         ' S-' || event_id || ' ' AS sensor_id,
         'TR-' || user_id AS transformer_id,
         strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS ts_text,
         r_name,
         215.0E0 + ((event_id * 7) % 3000) / 100.0E0 AS voltage,
         5.0E0 + k * 0.945E0 AS amperes,
         40.0E0 + least(value, 80.0E0) AS temperature,
         k * 1.05E0 AS load_percent,
         least(1.0E0, value / 50.0E0) AS score,
         CASE event_type WHEN 'error' THEN 'overheating' WHEN 'purchase' THEN ' Overload '
                         WHEN 'view' THEN 'normal' WHEN 'click' THEN 'ONLINE' END AS status
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
  JOIN region ON r_regionkey = user_id % 5
)"""

_SILVER = (
    _READINGS
    + """,
silver AS (
  SELECT lower(trim(sensor_id)) AS "sensorId", lower(trim(transformer_id)) AS "transformerId",
         ts_text AS "timestamp", lower(trim(r_name)) AS region, voltage, amperes AS "current",
         temperature, ratio AS "load", score AS "failureRiskScore", upper(trim(status)) AS status,
         ts AS "eventTime",
         (score >= 0.8E0 OR upper(trim(status)) IN
           ('ALERT', 'WARNING', 'CRITICAL', 'OVERLOAD', 'OVERHEATING')) AS "isAlert"
  FROM (SELECT *, CASE WHEN load_percent > 1.0E0 AND load_percent <= 100.0E0
                       THEN load_percent / 100.0E0 ELSE load_percent END AS ratio FROM readings)
  WHERE ratio BETWEEN 0.0E0 AND 1.0E0 AND score BETWEEN 0.0E0 AND 1.0E0
)"""
)


def _mean(column: str) -> str:
    exact = f'CAST({column} AS DECIMAL(20,10))'
    return f"CAST(sum({exact}) AS DOUBLE) / count({exact})"


_GOLD = (
    _SILVER
    + f""",
gold AS (
  SELECT *, "windowStart" + INTERVAL 1 HOUR AS "windowEnd",
         CASE WHEN "alertCount" > 0 THEN 'ALERT' ELSE 'NORMAL' END AS status
  FROM (
    SELECT "transformerId", region, date_trunc('hour', "eventTime") AS "windowStart",
           {_mean('voltage')} AS voltage, {_mean('"current"')} AS "current",
           {_mean('temperature')} AS temperature, {_mean('"load"')} AS "load",
           {_mean('"failureRiskScore"')} AS "failureRiskScore",
           max("failureRiskScore") AS "maxFailureRiskScore",
           CAST(count(*) FILTER (WHERE "isAlert") AS BIGINT) AS "alertCount",
           CAST(count(*) AS BIGINT) AS "measurementCount"
    FROM silver GROUP BY 1, 2, 3)
)"""
)

_FIELDS = """sensor_id AS "sensorId", transformer_id AS "transformerId", ts_text AS "timestamp", r_name AS region,
  voltage, amperes AS "current", temperature, load_percent AS "load", score AS "failureRiskScore", status"""
_RAW = f"""'ST' AS topic, CAST(topic_partition AS INTEGER) AS "partition", event_id AS "offset",
  ts AS "kafkaTimestamp", {_FIELDS}"""


def _cell(column: str) -> str:
    """Three decimals as the report prints them: half up on the decimal digits of the double
    (C's printf rounds its binary value, which differs where the fourth decimal is a final 5)."""
    return f"CAST(CAST(CAST({column} AS VARCHAR) AS DECIMAL(38,18)) AS DECIMAL(20,3)) :: VARCHAR"


_REGIONS = f"""SELECT region, {_mean('"failureRiskScore"')} AS "averageRisk",
  max("maxFailureRiskScore") AS "highestRisk", CAST(sum("measurementCount") AS BIGINT) AS measurements
  FROM gold GROUP BY region"""
_TRANSFORMERS = f"""SELECT "transformerId", CAST(sum("alertCount") AS BIGINT) AS alerts,
  {_mean('"failureRiskScore"')} AS "averageRisk" FROM gold GROUP BY 1"""
_LOAD = f"""SELECT CAST(hour("windowStart") AS INTEGER) AS hour, {_mean('"load"')} AS "averageLoad"
  FROM gold GROUP BY 1"""
_TREND = f"""SELECT "windowStart", "windowEnd", {_mean('"failureRiskScore"')} AS "averageRisk"
  FROM gold GROUP BY 1, 2"""

_DETECTED = (
    _READINGS
    + """,
marked AS (
  SELECT *, score >= 0.8E0 AS high, epoch_us(ts) // 1000 AS now_ms FROM readings WHERE status IS NOT NULL
), runs AS (
  SELECT *, sum(CASE WHEN high THEN 0 ELSE 1 END)
    OVER (PARTITION BY transformer_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM marked
), streaks AS (
  SELECT *, min(CASE WHEN high THEN now_ms END)
    OVER (PARTITION BY transformer_id, run ORDER BY ts ROWS UNBOUNDED PRECEDING) AS since FROM runs
), detected AS (
  SELECT sha256(concat_ws('|', transformer_id, sensor_id, ts_text, topic_partition, event_id)) AS "alertId",
         severity, 'failureRiskScore=' || score || ' -> ' || severity || ' (warn>=0.8, crit>=0.9)' AS reason,
         now_ms AS "detectedAt", transformer_id AS "transformerId", sensor_id AS "sensorId",
         r_name AS region, score AS "failureRiskScore"
  FROM (SELECT *, CASE WHEN score >= 0.9E0 THEN 'CRITICAL' ELSE 'WARNING' END AS severity FROM streaks)
  WHERE high AND (score >= 0.9E0 OR now_ms - since >= 21600000)
)"""
)

_STORED = (
    _READINGS
    + """,
messages AS (
  SELECT *, event_id % 6 AS message_partition,
         CASE WHEN event_id % 10 = 0 THEN '' WHEN event_id % 10 <= 2
              THEN 'alert-' || (event_id // 10) || '-d' ELSE 'alert-' || event_id END AS id,
         CASE status WHEN 'overheating' THEN 'critical' WHEN ' Overload ' THEN 'Warning'
                     WHEN 'normal' THEN 'minor' WHEN 'ONLINE' THEN '' END AS word,
         CASE WHEN event_id % 4 = 0 THEN '' ELSE 'reason ' || event_id END AS why,
         CASE WHEN event_id % 7 = 0 THEN 'unknown-region' ELSE r_name END AS place
  FROM readings
), stored AS (
  SELECT CASE WHEN id = '' THEN 'missing-alert-id' ELSE id END AS "alertId",
         CASE upper(word) WHEN 'CRITICAL' THEN 'CRITICAL' WHEN 'WARNING' THEN 'WARNING'
                          ELSE 'UNKNOWN' END AS severity,
         CASE WHEN word = '' THEN 'UNKNOWN' ELSE word END AS "originalSeverity",
         CASE WHEN why = '' THEN 'No reason provided' ELSE why END AS reason,
         epoch_us(ts) // 1000 AS "detectedAt", place AS region, sensor_id AS "sensorId",
         CAST(message_partition AS INTEGER) AS "partition", event_id AS "offset",
         transformer_id, score, temperature, voltage, amperes, load_percent, status
  FROM messages WHERE word IS NOT NULL
), history AS (
  SELECT * FROM stored
  QUALIFY row_number() OVER (PARTITION BY "alertId" ORDER BY "partition", "offset") = 1
)"""
)
_FLAT = 'SELECT "alertId", severity, "originalSeverity", reason, "detectedAt", region, "sensorId", "partition", "offset"'
_NEWEST = ' ORDER BY "detectedAt" DESC, "alertId"'
# Java prints small doubles in scientific form; sample scores below 0.001 have one digit.
_SCORE_TEXT = "CASE WHEN score < 0.001E0 THEN CAST(round(score * 10000) AS INTEGER) || '.0E-4' ELSE CAST(score AS VARCHAR) END"

_NOTIFIED = (
    _STORED
    + f""",
earlier AS (
  SELECT *, CASE WHEN severity = 'CRITICAL' AND "offset" % 4 = 0 THEN 'SENT'
                 WHEN severity = 'CRITICAL' AND "offset" % 4 = 1 THEN 'FAILED'
                 WHEN severity = 'CRITICAL' AND "offset" % 4 = 2 THEN 'SENDING'
                 ELSE 'NOT_REQUIRED' END AS before,
         "alertId" IN (SELECT "alertId" FROM stored WHERE severity = 'CRITICAL') AS arrived
  FROM history
), notified AS (
  SELECT *, arrived AND before IN ('NOT_REQUIRED', 'FAILED') AS prepared,
         arrived AND before IN ('NOT_REQUIRED', 'FAILED') AND severity = 'CRITICAL' AS claimed,
         chr(10) AS nl, {_SCORE_TEXT} AS score_text
  FROM earlier
), rendered AS (
  SELECT *, '[CRITICAL] Smart Grid alert in ' || region AS subject,
    'Alert id: ' || "alertId" || nl || 'Severity: ' || severity || nl || 'Reason: ' || reason || nl ||
    'Detected at: ' || "detectedAt" || nl || nl || 'Sensor: ' || trim("sensorId") || nl ||
    'Transformer: ' || transformer_id || nl || 'Region: ' || region || nl ||
    'Failure risk score: ' || score_text || nl || 'Temperature: ' || temperature || nl ||
    'Voltage: ' || voltage || nl || 'Current: ' || amperes || nl || 'Load: ' || load_percent || nl ||
    'Status: ' || trim(status) || nl || nl || 'Recommended action:' || nl ||
    'Inspect the impacted grid equipment.' AS body,
    CASE WHEN claimed AND "offset" % 3 = 0 THEN 'FAILED' WHEN claimed THEN 'SENT'
         WHEN prepared THEN 'PENDING' ELSE before END AS final
  FROM notified
)"""
)


def oracle_sql() -> dict[str, str]:
    """The SQL of every query that has one."""
    return _lake_sql() | (llm.SQL if llm else {}) | ({"pipeline": corpus.ORACLE_SQL} if corpus and corpus.ORACLE_SQL else {})


def _lake_sql() -> dict[str, str]:
    detected = f"WITH {_DETECTED} SELECT * FROM detected"
    gold = (
        f'WITH {_GOLD} SELECT "transformerId", "windowStart", "windowEnd", region, voltage, "current", '
        'temperature, "load", "failureRiskScore", "maxFailureRiskScore", "alertCount", '
        '"measurementCount", status FROM gold'
    )
    transformers = f'WITH {_GOLD} {_TRANSFORMERS}'
    hour_text = "strftime({}, '%Y-%m-%d %H:%M:%S') || '.0'"
    routine = "['LogAlert', 'StoreAlert', 'AddToDashboardState']"
    full = "['LogAlert', 'StoreAlert', 'StoreCriticalAlert', 'SendMailNotification', 'AddToDashboardState']"
    rule = "=" * 60
    return {
        "silver_clean": f'WITH {_SILVER} SELECT * REPLACE (CAST("isAlert" AS VARCHAR) AS "isAlert") FROM silver',
        "gold_hourly": gold,
        "lake_round_trip": gold,
        "gold_incremental": gold,
        "regions_highest_risk": f'WITH {_GOLD} {_REGIONS} ORDER BY "averageRisk" DESC, region',
        "transformers_most_alerts": transformers + ' ORDER BY alerts DESC, "averageRisk" DESC, 1',
        "statistics_round_trip": transformers + ' ORDER BY alerts DESC, "averageRisk" DESC, 1',
        "average_load_by_hour": f"WITH {_GOLD} {_LOAD} ORDER BY hour",
        "failure_risk_trend": f'WITH {_GOLD} {_TREND} ORDER BY "windowStart"',
        "report_regions": f"""WITH {_GOLD}, answer AS ({_REGIONS})
            SELECT region, {_cell('"averageRisk"')} AS "averageRisk",
                   {_cell('"highestRisk"')} AS "highestRisk",
                   CAST(measurements AS VARCHAR) AS measurements
            FROM (SELECT * FROM answer ORDER BY "averageRisk" DESC, region LIMIT 20)""",
        "report_transformers": f"""WITH {_GOLD}, answer AS ({_TRANSFORMERS})
            SELECT "transformerId", CAST(alerts AS VARCHAR) AS alerts,
                   {_cell('"averageRisk"')} AS "averageRisk"
            FROM (SELECT * FROM answer ORDER BY alerts DESC, answer."averageRisk" DESC, "transformerId" LIMIT 20)""",
        "report_load": f"""WITH {_GOLD}, answer AS ({_LOAD})
            SELECT CAST(hour AS VARCHAR) AS hour, {_cell('"averageLoad"')} AS "averageLoad"
            FROM (SELECT * FROM answer ORDER BY hour LIMIT 20)""",
        "report_trend": f"""WITH {_GOLD}, answer AS ({_TREND})
            SELECT {hour_text.format('"windowStart"')} AS "windowStart",
                   {hour_text.format('"windowEnd"')} AS "windowEnd",
                   {_cell('"averageRisk"')} AS "averageRisk"
            FROM (SELECT * FROM answer ORDER BY "windowStart" LIMIT 20)""",
        "layer_counts": f"""WITH {_GOLD}
            SELECT 'bronze' AS layer, CAST(count(*) AS BIGINT) AS "rows" FROM readings
            UNION ALL SELECT 'silver', CAST(count(*) AS BIGINT) FROM silver
            UNION ALL SELECT 'gold', CAST(count(*) AS BIGINT) FROM gold""",
        "bronze_round_trip": f"""WITH {_READINGS}
            SELECT {_RAW}, false AS "hasNewline" FROM readings""",
        "bronze_two_landings": f"WITH {_READINGS} SELECT {_RAW} FROM readings",
        "bounded_landing": f"WITH {_READINGS} SELECT {_RAW} FROM readings",
        "bounded_records": f"""WITH {_READINGS}
            SELECT * FROM (SELECT CAST(topic_partition AS INTEGER) AS "partition", event_id AS "offset", {_FIELDS}
                           FROM readings ORDER BY event_id, topic_partition LIMIT 777)""",
        "objects_round_trip": f"""WITH {_READINGS}
            SELECT 'ST' AS topic, CAST(topic_partition AS INTEGER) AS "partition", event_id AS "offset", {_FIELDS},
                   CAST(max(event_id) OVER place - min(event_id) OVER place + 1 - count(*) OVER place AS BIGINT) AS missing
            FROM readings WINDOW place AS (PARTITION BY topic_partition)""",
        "fan_out": f"""WITH {_DETECTED}
            SELECT CAST(topic_partition AS INTEGER) AS "partition", CAST(count(*) AS BIGINT) AS records,
                   any_value(found) AS alerts
            FROM readings LEFT JOIN (
              SELECT CAST(substr("transformerId", 4) AS BIGINT) % 6 AS place, CAST(count(*) AS BIGINT) AS found
              FROM detected GROUP BY 1) ON place = topic_partition
            GROUP BY 1""",
        "gold_wide_values": f"""WITH {_SILVER}, wide AS (
              SELECT *, date_trunc('hour', "eventTime") AS "windowStart",
                     CASE WHEN CAST(substr("sensorId", 3) AS BIGINT) % 5 = 0 THEN voltage * 1e9 ELSE voltage END AS v
              FROM silver)
            SELECT "transformerId", region, "windowStart", CAST(count(*) AS BIGINT) AS "measurementCount",
                   CAST(floor(CASE WHEN max(v) >= 1e10 THEN avg(v)
                              ELSE {_mean("CASE WHEN v < 1e10 THEN v END")} END) AS BIGINT) AS voltage
            FROM wide GROUP BY 1, 2, 3""",
        "risk_score": f"""WITH {_READINGS}, parts AS (
              SELECT event_id,
                greatest(0.0E0, least(1.0E0, (temperature - 60.0E0) / 40.0E0)) AS t,
                greatest(0.0E0, least(1.0E0, (load_percent - 70.0E0) / 30.0E0)) AS l,
                greatest(0.0E0, least(1.0E0, abs(voltage - 230.0E0) / 30.0E0)) AS v
              FROM readings), scored AS (
              SELECT event_id, greatest(0.0E0, least(1.0E0, 0.5E0 * t + 0.3E0 * l + 0.2E0 * v)) AS s FROM parts)
            SELECT event_id AS "eventId", s AS "riskScore",
                   floor(s * 100.0E0 + 0.5E0) / 100.0E0 AS "roundedScore",
                   CASE WHEN s >= 0.9E0 THEN 'CRITICAL' WHEN s >= 0.8E0 THEN 'WARNING'
                        ELSE 'NORMAL' END AS status FROM scored""",
        "score_severity": f"""WITH {_READINGS}, words AS (
              SELECT *, CASE WHEN score >= 0.9E0 THEN 'CRITICAL' WHEN score >= 0.8E0 THEN 'WARNING' END AS severity
              FROM readings)
            SELECT event_id AS "eventId", severity,
                   'failureRiskScore=' || score || ' -> ' || severity || ' (warn>=0.8, crit>=0.9)' AS reason
            FROM words""",
        "readings_accepted": f"""WITH {_READINGS}
            SELECT CAST(topic_partition AS INTEGER) AS "partition", event_id AS "offset",
                   {_FIELDS} FROM readings WHERE status IS NOT NULL""",
        "readings_quarantined": f"""WITH {_READINGS}
            SELECT CAST(topic_partition AS INTEGER) AS "partition", event_id AS "offset", {_FIELDS}
            FROM readings WHERE status IS NULL""",
        "detect_batch": detected,
        "detect_batch_small_slices": detected,
        "detect_batch_arrival": detected,
        "detect_batch_by_count": detected,
        "detect_stream": detected,
        "detect_stream_late": detected,
        "alert_envelopes": f"""WITH {_DETECTED}
            SELECT "transformerId" AS "key", CAST(count(*) AS BIGINT) AS messages,
                   min("detectedAt") AS "firstDetectedAt", max("failureRiskScore") AS "highestScore"
            FROM detected GROUP BY 1""",
        "alert_messages": f"""WITH {_DETECTED}
            SELECT d."transformerId" AS key, 'ST2' AS topic, CAST(topic_partition AS INTEGER) AS "partition",
                   event_id AS "offset", d."alertId", d.severity, d.reason, d."detectedAt", {_FIELDS}
            FROM detected d JOIN readings ON d."sensorId" = sensor_id""",
        "alerts_decoded": f"""WITH {_STORED}, raw AS (
              SELECT *, word IS NOT NULL AS valid,
                CASE WHEN event_id % 10 = 0 THEN '  ' WHEN event_id % 10 <= 2 THEN 'alert-' || (event_id // 10) || '-d'
                     ELSE chr(9) || 'alert-' || event_id || ' ' END AS raw_id,
                CASE status WHEN 'overheating' THEN 'critical' WHEN ' Overload ' THEN ' Warning '
                            WHEN 'normal' THEN 'minor' WHEN 'ONLINE' THEN chr(9) END AS raw_word,
                CASE WHEN event_id % 4 = 0 THEN '' ELSE ' reason ' || event_id END AS raw_reason,
                CASE WHEN event_id % 7 = 0 THEN ' ' ELSE r_name END AS raw_region FROM messages)
            SELECT CAST(message_partition AS INTEGER) AS "partition", event_id AS "offset", valid AS "isValid",
                   CASE WHEN valid THEN raw_id END AS "alertId", raw_word AS severity,
                   CASE WHEN valid THEN raw_reason END AS reason, CASE WHEN valid THEN epoch_us(ts) // 1000 END AS "detectedAt",
                   CASE WHEN valid THEN sensor_id END AS "sensorId", CASE WHEN valid THEN transformer_id END AS "transformerId",
                   CASE WHEN valid THEN ts_text END AS "timestamp", CASE WHEN valid THEN raw_region END AS region,
                   CASE WHEN valid THEN voltage END AS voltage, CASE WHEN valid THEN amperes END AS "current",
                   CASE WHEN valid THEN temperature END AS temperature, CASE WHEN valid THEN load_percent END AS "load",
                   CASE WHEN valid THEN score END AS "failureRiskScore", CASE WHEN valid THEN status END AS status
            FROM raw""",
        "alert_payloads": f"""WITH {_STORED}
            SELECT "alertId", severity, "originalSeverity", reason AS why, "detectedAt", "sensorId",
                   transformer_id AS "transformerId", ts_text AS "timestamp",
                   CASE WHEN event_id % 7 = 0 THEN ' ' ELSE r_name END AS region, voltage, amperes AS "current",
                   temperature, load_percent AS "load", score AS "failureRiskScore", status
            FROM stored JOIN (SELECT event_id, ts_text, r_name FROM readings) ON "offset" = event_id""",
        "stored_alerts": f"WITH {_STORED} {_FLAT} FROM stored",
        "alert_history": f"WITH {_STORED} {_FLAT} FROM history",
        "history_stored": f"WITH {_STORED} {_FLAT} FROM history",
        "insert_if_absent": f"""WITH {_STORED} {_FLAT} FROM history
            WHERE "alertId" NOT IN (SELECT "alertId" FROM stored WHERE "partition" % 2 = 0)""",
        "alerts_newest_first": f"WITH {_STORED} {_FLAT} FROM history{_NEWEST}",
        "alerts_recent": f"WITH {_STORED} {_FLAT} FROM history{_NEWEST} LIMIT 500",
        "alerts_latest_panel": f"""WITH {_STORED}
            SELECT "alertId", severity, lower(severity) AS badge, region,
                   transformer_id AS "transformerId", reason, "detectedAt"
            FROM history{_NEWEST} LIMIT 10""",
        "alerts_critical": f"WITH {_STORED} {_FLAT} FROM history WHERE severity = 'CRITICAL'{_NEWEST}",
        "alerts_by_region": f"WITH {_STORED} {_FLAT} FROM history WHERE lower(region) = 'europe'{_NEWEST}",
        "alerts_without_region": f"WITH {_STORED} {_FLAT} FROM history WHERE region = 'unknown-region'{_NEWEST}",
        "alert_counts": f"""WITH {_STORED}
            SELECT CAST(count(*) AS BIGINT) AS total,
                   CAST(count(*) FILTER (WHERE severity = 'WARNING') AS BIGINT) AS warning,
                   CAST(count(*) FILTER (WHERE severity = 'CRITICAL') AS BIGINT) AS critical,
                   CAST(count(*) FILTER (WHERE severity NOT IN ('WARNING', 'CRITICAL')) AS BIGINT) AS unknown
            FROM history""",
        "alert_counts_by_region": f"""WITH {_STORED}
            SELECT region, CAST(count(*) AS BIGINT) AS "alertCount" FROM history GROUP BY region ORDER BY region""",
        "service_summary": f"""WITH {_STORED}
            SELECT 'ok' AS status, 'alert-handler' AS service, 'ST2' AS "kafkaTopic",
                   CAST(count(*) AS BIGINT) AS "totalAlerts" FROM history""",
        "severity_words": f"""WITH {_STORED}
            SELECT "offset", severity AS category,
                   CASE WHEN severity = 'UNKNOWN' THEN 'UNKNOWN(' || upper("originalSeverity") || ')'
                        ELSE severity END AS display,
                   lower(severity) AS badge FROM stored""",
        "alert_actions": f"""WITH {_STORED}, listed AS (
              SELECT "alertId", "offset", CASE WHEN severity = 'CRITICAL' THEN {full} ELSE {routine} END AS names
              FROM stored), numbered AS (
              SELECT *, unnest(generate_series(1, len(names))) AS n FROM listed)
            SELECT "alertId", "offset", CAST(n - 1 AS INTEGER) AS step, names[n] AS action FROM numbered""",
        "alert_log_lines": f"""WITH {_STORED}, lined AS (
              SELECT *, chr(10) AS nl, {_SCORE_TEXT} AS score_text FROM stored)
            SELECT "offset", CASE severity
              WHEN 'WARNING' THEN '[WARNING] alert=' || "alertId" || ' transformer=' || transformer_id ||
                ' region=' || region || ' reason=' || reason
              WHEN 'CRITICAL' THEN '{rule}' || nl || '[CRITICAL] SMART GRID ALERT' || nl ||
                'Alert id    : ' || "alertId" || nl || 'Transformer : ' || transformer_id || nl ||
                'Region      : ' || region || nl || 'Reason      : ' || reason || nl ||
                'Risk score  : ' || score_text || nl || 'Temperature : ' || temperature || nl ||
                'Voltage     : ' || voltage || nl || 'Load        : ' || load_percent || nl || '{rule}'
              ELSE '[UNKNOWN SEVERITY] alert=' || "alertId" || ' severity=' || upper("originalSeverity") ||
                ' region=' || region || ' reason=' || reason END AS "logLine"
            FROM lined""",
        "address_lists": """SELECT event_id, 'u' || user_id || '@x.org v' || user_id || '@x.org ' || event_type
            AS addresses FROM events""",
        "notification_outbox": f"""WITH {_NOTIFIED}
            SELECT "alertId", "detectedAt", subject, body, 'ops@example.com grid@example.com' AS recipients
            FROM rendered WHERE claimed""",
        "outbox_after_failure": f"""WITH {_STORED}, again AS (
              SELECT * FROM stored WHERE severity = 'CRITICAL'
              QUALIFY row_number() OVER (PARTITION BY "alertId" ORDER BY "partition", "offset") = 1)
            SELECT "alertId", "detectedAt", '[CRITICAL] Smart Grid alert in new ' || region AS subject FROM again
            WHERE "alertId" IN (SELECT "alertId" FROM history WHERE severity = 'CRITICAL')""",
        "notification_ledger": f"""WITH {_NOTIFIED}
            SELECT "alertId", severity, "detectedAt", final AS status,
                   CASE WHEN final <> 'FAILED' THEN NULL WHEN claimed THEN 'connection refused'
                        ELSE 'mailbox unavailable' END AS error,
                   CASE WHEN prepared THEN TIMESTAMP '{NOW}'
                        WHEN before <> 'NOT_REQUIRED' THEN TIMESTAMP '{EARLIER}' END AS "updatedAt"
            FROM rendered""",
        "notification_audit": f"""WITH {_NOTIFIED}
            SELECT "alertId", 'Subject: ' || subject || nl || 'Delivery: FILE notification written' || nl || nl ||
                   body AS entry FROM rendered WHERE final = 'SENT'""",
        "history_while_merging": f"""WITH {_STORED}, partial AS (
              SELECT * FROM stored WHERE "partition" < 5
              QUALIFY row_number() OVER (PARTITION BY "alertId" ORDER BY "partition", "offset") = 1)
            SELECT moment, region, CAST(count(*) AS BIGINT) AS alerts FROM partial, (VALUES ('before'), ('during')) AS m(moment)
            GROUP BY ALL
            UNION ALL SELECT 'after', region, CAST(count(*) AS BIGINT) FROM history GROUP BY ALL""",
        "claims_of_two_handlers": f"""WITH {_NOTIFIED}
            SELECT first, "alertId", CAST(1 AS BIGINT) AS claims, first || '/0' AS owner, 'FAILED' AS status,
                   first AS error, CAST(3 AS BIGINT) AS revision
            FROM notified, (VALUES ('a'), ('b')) AS o(first)
            WHERE arrived AND severity = 'CRITICAL' AND before <> 'SENT'""",
        "handler_stream": f"""WITH {_STORED}
            SELECT "alertId", severity, "detectedAt",
                   CASE WHEN "alertId" NOT IN (SELECT "alertId" FROM stored WHERE severity = 'CRITICAL')
                        THEN 'NOT_REQUIRED' WHEN severity = 'CRITICAL' THEN 'SENT' ELSE 'PENDING' END AS status
            FROM history""",
    }
