from __future__ import annotations

import json
import math

import pytest

from telemetry_lake.operators.decode import accepted, apart, decode_alerts, decode_readings, quarantined, timed_readings
from telemetry_lake.schemas import BRONZE
from tests.samples import READING, alert, reading, topic


def decoded(spark, *values):
    return accepted(decode_readings(topic(spark, values))).collect()


def test_reading_keeps_its_text_untouched(spark):
    (row,) = decoded(spark, reading(sensorId=" S-1 ", failureRiskScore=5.0))
    assert (row.sensorId, row.failureRiskScore, row.load) == (" S-1 ", 5.0, 50.0)


@pytest.mark.parametrize("missing", list(READING))
def test_every_field_is_needed(spark, missing):
    assert decoded(spark, json.dumps({k: v for k, v in READING.items() if k != missing})) == []


@pytest.mark.parametrize(
    "value",
    ["", "nope", "[]", f"[{reading()}]", reading(sensorId=5), reading(status=None), reading(voltage="x"),
     reading(voltage=True), reading(voltage=float("nan")), reading(region={"a": 1}), reading(load=" 5"),
     reading(region=[1]), reading(region=False), reading(region=float("nan")), reading(region=-1.5e3)],
)
def test_refused(spark, value):
    raw = topic(spark, [value, reading()])
    messages = decode_readings(raw)
    assert accepted(messages).count() == 1
    assert [r.value for r in quarantined(messages, BRONZE.names).collect()] == [value]


@pytest.mark.parametrize("region", ["75", "true", "NaN", "[a]", "", "null", "-1e5"])
def test_text_that_looks_like_another_type_is_text(spark, region):
    assert [r.region for r in decoded(spark, reading(region=region))] == [region]


def test_numeric_text_extra_fields_and_null_numbers_are_taken(spark):
    (row,) = decoded(spark, reading(load="8.5e1", failureRiskScore=None, more=[1]))
    assert row.load == 85.0 and math.isnan(row.failureRiskScore)


def test_alert_round_trip(spark):
    (row,) = accepted(decode_alerts(topic(spark, [alert()]))).collect()
    assert (row.alertId, row.severity, row.detectedAt) == ("n-1", "CRITICAL", 1801627506000)
    assert (row.source.region, row.source.failureRiskScore) == ("Hillside West", 0.97)


@pytest.mark.parametrize(
    "value",
    [alert(severity=None), alert(alert_id=7), alert(region=None), alert(load="x"), "{}",
     json.dumps({"alertId": "a", "severity": "b", "reason": "c", "detectedAt": 1})],
)
def test_alert_refused(spark, value):
    assert [r.isValid for r in decode_alerts(topic(spark, [value])).collect()] == [False]


def test_blank_alert_fields_are_accepted(spark):
    assert accepted(decode_alerts(topic(spark, [alert(alert_id="", severity=" ", reason="")]))).count() == 1


def test_told_apart_in_one_pass(spark):
    raw = topic(spark, ["nope", reading(), reading(status=None), reading(timestamp="no time")])
    messages = decode_readings(raw)
    both = apart(messages, "eventTime")
    refused = both.where("refused").select(*BRONZE.names)
    assert sorted(refused.collect()) == sorted(quarantined(messages, BRONZE.names, "eventTime").collect())
    taken, timed = both.where("NOT refused"), timed_readings(messages, "eventTime")
    assert taken.where("value IS NOT NULL OR topic IS NOT NULL").count() == 0
    assert sorted(taken.select(*timed.columns).collect()) == sorted(timed.collect()) and taken.count() == 2
