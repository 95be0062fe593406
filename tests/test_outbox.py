from __future__ import annotations

from pyspark.sql import functions as F

from telemetry_lake.functions.messages import notification_text
from telemetry_lake.operators import history, outbox
from telemetry_lake.operators.decode import accepted, decode_alerts
from telemetry_lake.schemas import LEDGER
from tests.samples import alert, topic

def now():
    return F.lit("2026-06-25 13:00:00")


def arrivals(spark, *values):
    return history.stored_alerts(accepted(decode_alerts(topic(spark, values))))


def ledger(spark, *rows):
    return spark.createDataFrame(
        [(i, s, e, None, n) for n, (i, s, e) in enumerate(rows)], LEDGER
    ).withColumn("updatedAt", F.lit("2026-06-25 12:00:00").cast("timestamp"))


def statuses(entries):
    return {r.alertId: r.status for r in entries.collect()}


def critical(rows):
    return rows.filter("severity = 'CRITICAL'")


def test_notification_text_carries_the_reading(spark):
    rows = arrivals(spark, alert())
    body = rows.select(notification_text(F.lit("not sent yet")).alias("x")).first().x
    assert body.startswith("Subject: [CRITICAL] Smart Grid alert in Hillside West\nDelivery: not sent yet\n\nAlert id: ")
    assert "\nTransformer: unit-b17\n" in body and "\nFailure risk score: 0.97\n" in body
    assert body.endswith("Recommended action:\nInspect the impacted grid equipment.")


def test_prepare_resets_only_waiting_and_failed(spark):
    rows = critical(arrivals(spark, *[alert(i) for i in "abcde"], alert("a")))
    old = ledger(spark, ("b", "FAILED", "x"), ("c", "SENT", None), ("d", "SENDING", None), ("e", "PENDING", None))
    entries = outbox.prepare(rows, old, now())
    assert statuses(entries) == {"a": "PENDING", "b": "PENDING"}
    assert [r.error for r in entries.collect()] == [None, None]


def test_claim_skips_sent_and_sending(spark):
    rows = arrivals(spark, *[alert(i) for i in "abcde"])
    old = ledger(spark, ("b", "FAILED", "x"), ("c", "SENT", None), ("d", "SENDING", None), ("e", "PENDING", None))
    claims = outbox.claim(critical(rows), history.first_arrivals(rows), old, now())
    assert statuses(claims) == {"a": "SENDING", "b": "SENDING", "e": "SENDING"}


def test_stale_claims_are_taken_over_on_request(spark):
    rows = arrivals(spark, alert("d"))
    old = ledger(spark, ("d", "SENDING", None))
    stored = history.first_arrivals(rows)
    assert statuses(outbox.claim(rows, stored, old, now(), "15 minutes")) == {"d": "SENDING"}
    assert statuses(outbox.claim(rows, stored, old, now(), "2 hours")) == {}


def test_stored_severity_decides(spark):
    rows = arrivals(spark, alert("a", "WARNING"), alert("a", "CRITICAL"))
    stored = history.first_arrivals(rows)
    empty = spark.createDataFrame([], LEDGER)
    assert statuses(outbox.prepare(critical(rows), empty, now())) == {"a": "PENDING"}
    assert statuses(outbox.claim(critical(rows), stored, empty, now())) == {}


def test_record_and_report(spark):
    rows = arrivals(spark, alert("a"), alert("b"), alert("c", "WARNING"), alert("d"))
    stored = history.first_arrivals(rows)
    results = spark.createDataFrame(
        [("a", "timeout", 1), ("a", None, 2), ("b", "refused", 9), ("b", None, 3), ("ghost", "x", 1)],
        "alertId string, error string, sequence int",
    )
    entries = outbox.record(results, stored, spark.createDataFrame([], LEDGER), now())
    assert statuses(entries) == {"a": "SENT", "b": "FAILED"}
    report = {r.alertId: (r.status, r.error) for r in outbox.ledger_report(stored, entries).collect()}
    assert report == {"a": ("SENT", None), "b": ("FAILED", "refused"), "c": ("NOT_REQUIRED", None), "d": ("NOT_REQUIRED", None)}
    assert [r.alertId for r in outbox.notification_audit(stored, entries, "FILE").collect()] == ["a"]


def test_latest_revision_is_the_state(spark):
    log = ledger(spark, ("a", "PENDING", None), ("a", "SENDING", None), ("a", "FAILED", "x"), ("b", "PENDING", None))
    assert statuses(outbox.ledger_state(log.repartition(3))) == {"a": "FAILED", "b": "PENDING"}


def test_outbox_rows(spark):
    rows = arrivals(spark, alert("a"), alert("b"))
    stored = history.first_arrivals(rows)
    claims = outbox.claim(rows.filter("alertId = 'b'"), stored, spark.createDataFrame([], LEDGER), now())
    (row,) = outbox.outbox(claims, critical(rows), "x@y.z; x@y.z\nq@y.z").collect()
    assert (row.alertId, row.subject) == ("b", "[CRITICAL] Smart Grid alert in Hillside West")
    assert row.recipients == ["x@y.z", "q@y.z"] and "Alert id: b" in row.body


def test_the_arriving_alert_is_rendered(spark):
    stored = history.first_arrivals(arrivals(spark, alert("a", region="Old")))
    again = arrivals(spark, alert("a", region="New"), alert("a", region="Newer"))
    claims = outbox.claim(again, stored, ledger(spark, ("a", "FAILED", "x")), now())
    assert [r.subject for r in outbox.outbox(claims, again, "x@y.z").collect()] == ["[CRITICAL] Smart Grid alert in New"]
