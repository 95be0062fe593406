from __future__ import annotations

from datetime import timezone

import pytest
from pyspark.sql import functions as F

from telemetry_lake import session
from telemetry_lake.operators import outbox
from telemetry_lake.operators.decode import accepted, decode_alerts, decode_readings, timed_readings
from telemetry_lake.operators.detection import ARRIVAL, EVENT, detect
from telemetry_lake.schemas import BRONZE, STREAK, AlertRules
from telemetry_lake.sources import alert_store, commits, ledger_store
from telemetry_lake.sources.bronze import read_bronze, read_landed
from telemetry_lake.sources.tables import buckets_of, read_before, read_table, read_version, run_name, write_bucketed
from telemetry_lake.sources.topics import file_stream
from telemetry_lake.streaming import detector as detector_module
from telemetry_lake.streaming import handler as handler_module
from telemetry_lake.streaming.detector import MESSAGE_SCHEMA, DetectorPaths, detect_stream, streaks_before
from telemetry_lake.streaming.handler import HandlerPaths, handle_stream, record_results
from telemetry_lake.streaming.landing import land
from tests.samples import alert, at, reading, topic

def now():
    return F.lit("2026-06-25 13:00:00")


def send(rows, folder):
    rows.write.mode("append").parquet(str(folder))


def test_landing_strips_line_breaks_and_restarts_without_copies(spark, tmp_path):
    source, lake, checkpoint = tmp_path / "in", str(tmp_path / "bronze"), str(tmp_path / "cp")
    send(topic(spark, ["a\r\nb", "c\n"], partition=2), source)

    def run():
        land(file_stream(spark, str(source)), lake, checkpoint, bounded=True).awaitTermination()

    run()
    run()
    assert {(r.value, r.partition, r.offset) for r in read_landed(spark, lake).collect()} == {("ab", 2, 0), ("c", 2, 1)}
    send(topic(spark, ["d"], partition=3, start=9), source)
    run()
    assert read_landed(spark, lake).count() == 3
    assert {p.name for p in (tmp_path / "bronze").glob("run=*/batch=*/partition=*")} == {"partition=2", "partition=3"}


def test_landing_takes_some_files_per_micro_batch(spark, tmp_path):
    for n in range(3):
        send(topic(spark, [str(n)], start=n).coalesce(1), tmp_path / "in")
    query = land(
        file_stream(spark, str(tmp_path / "in"), 1), str(tmp_path / "b"), str(tmp_path / "cp"), bounded=True
    )
    query.awaitTermination()
    assert read_landed(spark, str(tmp_path / "b")).count() == 3


def test_a_second_checkpoint_neither_loses_nor_doubles(spark, tmp_path):
    lake = str(tmp_path / "bronze")
    send(topic(spark, ["a", "b", "c"]), tmp_path / "one")
    send(topic(spark, ["b", "c", "d", "e", "f"], start=1), tmp_path / "two")
    send(topic(spark, ["other"], partition=4), tmp_path / "two")
    for source, checkpoint in (("one", "c1"), ("two", "c2"), ("one", "c3")):
        land(file_stream(spark, str(tmp_path / source)), lake, str(tmp_path / checkpoint), bounded=True).awaitTermination()
    got = sorted((r.partition, r.offset, r.value) for r in read_landed(spark, lake).collect())
    assert got == [(0, n, v) for n, v in enumerate("abcdef")] + [(4, 0, "other")]
    assert read_bronze(spark, lake).count() == 7


def test_a_missing_state_is_an_error(spark, tmp_path):
    assert streaks_before(spark, str(tmp_path), "r", 0, None).count() == 0
    with pytest.raises(FileNotFoundError):
        streaks_before(spark, str(tmp_path), "r", 4, None)


def detector(tmp_path, name="cp"):
    return DetectorPaths(
        messages=str(tmp_path / "messages"), quarantine=str(tmp_path / "quarantine"),
        readings=str(tmp_path / "readings"), streaks=str(tmp_path / "streaks"), checkpoint=str(tmp_path / name),
    )


def records(spark, scores, start=0):
    """One reading per second over two transformers."""
    values = [
        reading(
            transformerId=f"TR-{n % 2}", sensorId=f"s-{n}", failureRiskScore=score,
            timestamp=at(start + n).isoformat() + "Z",
        )
        for n, score in enumerate(scores)
    ]
    return topic(spark, values, start=start)


def test_stream_equals_replay_over_restarts(spark, tmp_path):
    scores = [0.85, 0.1, 0.85, 0.95, 0.82, 0.85, 0.85, 0.85, 0.1, 0.85, 0.85, 0.3, 0.85, 0.9]
    whole, rules, paths = [], AlertRules(window_millis=4000), detector(tmp_path)
    for clock in (EVENT, ARRIVAL):
        paths = detector(tmp_path / str(clock.can_be_late))
        source = tmp_path / str(clock.can_be_late) / "in"
        for first, last in ((0, 5), (5, 6), (6, len(scores))):
            part = records(spark, scores[first:last], first)
            whole.append(part)
            send(part.union(topic(spark, ["junk"], partition=1, start=first)), source)
            detect_stream(
                file_stream(spark, str(source)), paths, clock, rules, 3 if clock is ARRIVAL else 3_000_000, bounded=True
            ).awaitTermination()
        messages = spark.read.schema(MESSAGE_SCHEMA).parquet(paths.messages)
        got = {(r.alertId, r.severity, r.detectedAt) for r in accepted(decode_alerts(messages)).collect()}
        table = whole[0].union(whole[1]).union(whole[2])
        expected = {
            (r.alertId, r.severity, r.detectedAt)
            for r in detect(timed_readings(decode_readings(table)), clock, rules).collect()
        }
        assert got == expected and len({s for _, s, _ in got}) == 2
        assert {r.key for r in messages.collect()} == {"TR-0", "TR-1"}
        assert read_table(spark, paths.quarantine, BRONZE).count() == 3
        whole.clear()


def test_a_batch_writes_the_state_it_touches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(detector_module, "WHOLE", 3)
    paths = detector(tmp_path)
    parts = [records(spark, [0.85, 0.85]), *[records(spark, [0.85], start=2 * n) for n in range(1, 5)]]
    for part in parts:
        send(part, tmp_path / "in")
        detect_stream(file_stream(spark, str(tmp_path / "in")), paths, bounded=True).awaitTermination()
    run = run_name(paths.checkpoint)
    kept = {p.name for p in (tmp_path / "streaks" / f"run={run}").glob("batch=*")}
    assert kept == {"batch=3", "batch=4"}  # batch 3 wrote everything, and batch 4 dropped what came before
    assert [r.transformerId for r in read_version(spark, paths.streaks, STREAK, run, 4).collect()] == ["TR-0"]
    state = {r.transformerId: r.since for r in streaks_before(spark, paths.streaks, run, 5, None).collect()}
    start = round(at(0).replace(tzinfo=timezone.utc).timestamp() * 1000)
    assert state == {"TR-0": start, "TR-1": start + 1000}


def test_a_batch_reads_the_partitions_of_its_ids(spark, tmp_path):
    rows = spark.range(500).select(F.format_string("id-%d", "id").alias("alertId"))
    write_bucketed(rows, str(tmp_path / "t"), "r", 0, "alertId")
    some = rows.filter("alertId IN ('id-7', 'id-8')")
    got = read_before(spark, str(tmp_path / "t"), rows.schema, "r", 1, buckets_of(some, "alertId"))
    assert got.filter("alertId IN ('id-7', 'id-8')").count() == 2 and got.count() < 100
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.partition("PartitionFilters")[2]


def handler(tmp_path, name):
    return HandlerPaths(
        history=str(tmp_path / "history"), ledger=str(tmp_path / "ledger"), outbox=str(tmp_path / "outbox"),
        quarantine=str(tmp_path / "quarantine"), checkpoint=str(tmp_path / name),
    )


def test_handler_replay_changes_nothing(spark, tmp_path):
    source = tmp_path / "in"

    def run(name):
        handle_stream(
            file_stream(spark, str(source)), handler(tmp_path, name), "a@b.c", now(), bounded=True
        ).awaitTermination()

    send(topic(spark, [alert("a"), alert("b", "WARNING"), "junk", alert("a", reason="copy")]), source)
    run("first")
    send(topic(spark, [alert("a", reason="late copy"), alert("c", "minor"), alert("d")], start=4), source)
    run("first")
    history = lambda: {(r.alertId, r.reason, r.severity) for r in alert_store.alerts(spark, str(tmp_path / "history")).collect()}
    reason = "score too high"
    expected = {("a", reason, "CRITICAL"), ("b", reason, "WARNING"), ("c", reason, "UNKNOWN"), ("d", reason, "CRITICAL")}
    assert history() == expected
    sent = [r.alertId for r in spark.read.parquet(str(tmp_path / "outbox")).collect()]
    assert sorted(sent) == ["a", "d"]

    results = spark.createDataFrame([("a", None, 0), ("d", "refused", 0)], "alertId string, error string, sequence int")
    record_results(results, handler(tmp_path, "first"), "deliveries", 0, now())
    before = alert_store.alerts(spark, str(tmp_path / "history")).count()
    run("second")
    assert history() == expected and alert_store.alerts(spark, str(tmp_path / "history")).count() == before
    # The replay sends again only what had failed.
    sent = [r.alertId for r in spark.read.parquet(str(tmp_path / "outbox")).collect()]
    assert sorted(sent) == ["a", "d", "d"]
    state = outbox.ledger_state(ledger_store.entries(spark, str(tmp_path / "ledger")))
    assert {r.alertId: r.status for r in state.collect()} == {"a": "SENT", "d": "SENDING"}
    assert read_table(spark, str(tmp_path / "quarantine"), BRONZE).count() == 2


def test_readings_to_history_end_to_end(spark, tmp_path):
    source = tmp_path / "in"
    send(records(spark, [0.95, 0.85, 0.95, 0.2, 0.85, 0.99]), source)
    paths = detector(tmp_path / "detector")
    detect_stream(file_stream(spark, str(source)), paths, bounded=True).awaitTermination()
    messages = file_stream(spark, f"{paths.messages}/run=*/batch=*")
    handle_stream(messages, handler(tmp_path / "handler", "cp"), "a@b.c", now(), bounded=True).awaitTermination()
    stored = alert_store.alerts(spark, str(tmp_path / "handler" / "history"))
    assert {(r.severity, r.source.sensorId) for r in stored.collect()} == {
        ("CRITICAL", "s-0"), ("CRITICAL", "s-2"), ("CRITICAL", "s-5"),
    }
    assert spark.read.parquet(str(tmp_path / "handler" / "outbox")).count() == 3


def test_the_handler_caches_no_rows_and_leaves_no_decoded_batch(spark, tmp_path, monkeypatch):
    cached, made, insert_absent = [], [], alert_store.insert_absent
    held = spark.sparkContext._jsc.getPersistentRDDs().size()

    def insert(own, table, arrivals, *rest):
        cached.append(own.sparkContext._jsc.getPersistentRDDs().size())
        plan = arrivals._jdf.queryExecution().executedPlan().toString()
        assert "InMemoryTableScan" not in plan and f"{made[-1]}]" in plan
        rows = spark.read.parquet(made[-1])
        # Payloads of refused messages only.
        assert rows.filter("isValid <> (value IS NULL)").count() == 0 and rows.count() == 3
        return insert_absent(own, table, arrivals, *rest)

    monkeypatch.setattr(alert_store, "insert_absent", insert)
    monkeypatch.setattr(handler_module, "scratch_dir", lambda *a: made.append(session.scratch_dir(*a)) or made[-1], raising=False)
    send(topic(spark, [alert("a"), "junk", alert("b", "WARNING")]), tmp_path / "in")
    handle_stream(file_stream(spark, str(tmp_path / "in")), handler(tmp_path, "cp"), "a@b.c", now(), bounded=True).awaitTermination()
    assert cached == [held] and len(made) == 1 and not commits.exists(spark, made[0])
    refused = read_table(spark, str(tmp_path / "quarantine"), BRONZE).collect()
    assert [(r.value, r.topic, r.partition, r.offset, r.kafkaTimestamp) for r in refused] == [("junk", "ST", 0, 1, at(1))]
    assert alert_store.alerts(spark, str(tmp_path / "history")).count() == 2
