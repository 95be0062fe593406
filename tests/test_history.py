from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from telemetry_lake.operators import history
from telemetry_lake.operators.decode import accepted, decode_alerts
from telemetry_lake.schemas import HISTORY, STORED_ALERT
from tests.samples import alert, topic


def stored(spark, *values, start=0):
    return history.stored_alerts(accepted(decode_alerts(topic(spark, values, start=start))))


@pytest.mark.parametrize(
    ("severity", "names"),
    [
        ("WARNING", ["LogAlert", "StoreAlert", "AddToDashboardState"]),
        ("CRITICAL", ["LogAlert", "StoreAlert", "StoreCriticalAlert", "SendMailNotification", "AddToDashboardState"]),
        ("INFO", ["LogAlert", "StoreAlert", "AddToDashboardState"]),
    ],
)
def test_actions_in_order(spark, severity, names):
    rows = history.actions(stored(spark, alert(severity=severity))).orderBy("step").collect()
    assert [r.action for r in rows] == names


def test_fallbacks(spark):
    (row,) = stored(spark, alert(alert_id=" ", severity="\t", reason="", region="  ")).collect()
    assert (row.alertId, row.severity, row.originalSeverity) == ("missing-alert-id", "UNKNOWN", "UNKNOWN")
    assert (row.reason, row.region, row.source.region) == ("No reason provided", "unknown-region", "  ")
    (row,) = stored(spark, alert(severity=" minor ")).collect()
    assert (row.severity, row.originalSeverity) == ("UNKNOWN", "minor")


def test_first_arrival_wins(spark):
    rows = stored(spark, alert("a", reason="one"), alert(" a ", reason="two"), alert("b"), alert(""), alert(" "))
    first = history.first_arrivals(rows.repartition(4))
    assert first.columns == HISTORY.names
    assert {(r.alertId, r.reason if r.alertId == "a" else r.offset) for r in first.collect()} == {
        ("a", "one"), ("b", 2), ("missing-alert-id", 3),
    }


def test_insert_if_absent(spark):
    old = history.first_arrivals(stored(spark, alert("a", reason="old")))
    new = history.first_arrivals(stored(spark, alert("a", reason="new"), alert("b"), start=5))
    assert [r.alertId for r in history.not_yet_stored(new, old).collect()] == ["b"]


def sample(spark):
    return stored(
        spark,
        alert("n-1", "WARNING"),
        alert("n-2", "CRITICAL", region="Harbour"),
        alert("n-3", "INFO", region=" "),
        alert("n-4", "CRITICAL", region="harbour"),
    ).withColumn("detectedAt", F.col("offset"))


def test_region_filter_ignores_case_and_blanks(spark):
    rows = sample(spark)
    assert [r.alertId for r in history.in_region(rows, "hillside west").collect()] == ["n-1"]
    assert [r.alertId for r in history.in_region(rows, " HARBOUR\n").collect()] == ["n-4", "n-2"]
    assert [r.alertId for r in history.in_region(rows, None).collect()] == ["n-3"]


def test_order_limit_and_panel(spark):
    rows = sample(spark)
    assert [r.alertId for r in history.newest_first(rows).collect()] == ["n-4", "n-3", "n-2", "n-1"]
    assert [r.alertId for r in history.recent(rows, 2).collect()] == ["n-4", "n-3"]
    assert [r.alertId for r in history.critical_only(rows).collect()] == ["n-4", "n-2"]
    panel = history.latest_panel(rows).collect()
    assert [(r.badge, r.region) for r in panel] == [
        ("critical", "harbour"), ("unknown", "unknown-region"), ("critical", "Harbour"), ("warning", "Hillside West"),
    ]
    assert "TakeOrderedAndProject" in history.recent(rows)._jdf.queryExecution().executedPlan().toString()


def test_counts(spark):
    rows = sample(spark)
    assert history.counts(rows).first().asDict() == {"total": 4, "warning": 1, "critical": 2, "unknown": 1}
    assert [tuple(r) for r in history.counts_by_region(rows).collect()] == [
        ("Harbour", 1), ("Hillside West", 1), ("harbour", 1), ("unknown-region", 1),
    ]
    assert history.service_summary(rows, "ST2").first().asDict() == {
        "status": "ok", "service": "alert-handler", "kafkaTopic": "ST2", "totalAlerts": 4,
    }


def test_empty_history(spark):
    empty = spark.createDataFrame([], HISTORY)
    assert history.counts(empty).first().asDict() == {"total": 0, "warning": 0, "critical": 0, "unknown": 0}
    assert history.counts_by_region(empty).count() == 0 and history.latest_panel(empty).count() == 0


def test_log_lines(spark):
    rows = stored(spark, alert("a", "warning"), alert("b", "critical"), alert("c", "minor", region=""))
    lines = {r.alertId: r.logLine for r in history.log_lines(rows).collect()}
    assert lines["a"] == (
        "[WARNING] alert=a transformer=unit-b17 region=Hillside West reason=score too high"
    )
    assert lines["b"].splitlines()[1:4] == [
        "[CRITICAL] SMART GRID ALERT", "Alert id    : b", "Transformer : unit-b17",
    ]
    assert lines["b"].splitlines()[0] == lines["b"].splitlines()[-1] == "=" * 60
    assert lines["c"].startswith("[UNKNOWN SEVERITY] alert=c severity=MINOR region=unknown-region")


def test_payloads_read_back_whole(spark):
    rows = history.stored_alerts(accepted(decode_alerts(topic(spark, [alert("a", reason="q\"é\n"), alert("b", "minor", voltage=None)]))))
    texts = rows.select(history.payload().alias("value"))
    back = history.read_payloads(texts)
    assert back.columns == STORED_ALERT.names
    want = sorted(map(repr, rows.select(*STORED_ALERT.names).collect()))
    assert sorted(map(repr, back.collect())) == want and "nan" in "".join(want)
    assert all(json.loads(r.value).keys() == set(STORED_ALERT.names) for r in texts.collect())


@pytest.mark.parametrize("broken", ["{", "{}", None, '{"alertId": 3}'])
def test_a_broken_payload_fails_the_query(spark, broken):
    rows = history.stored_alerts(accepted(decode_alerts(topic(spark, [alert("a")]))))
    texts = rows.select(history.payload().alias("value")).union(spark.createDataFrame([(broken,)], "value string"))
    with pytest.raises(Exception, match="Invalid alert payload"):
        history.read_payloads(texts).collect()
