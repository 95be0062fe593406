from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from telemetry_lake.operators import questions
from telemetry_lake.operators.gold import to_gold
from telemetry_lake.operators.silver import to_silver
from telemetry_lake.schemas import GOLD
from tests.samples import READING


def gold_of(spark, *changes):
    rows = [tuple({**READING, **change}[name] for name in READING) for change in changes]
    schema = ", ".join(
        f"{name} {'string' if isinstance(value, str) else 'double'}" for name, value in READING.items()
    )
    rows = [tuple(float(v) if isinstance(v, int) else v for v in row) for row in rows]
    return to_gold(to_silver(spark.createDataFrame(rows, schema)))


def test_hourly_window_is_half_open_and_aligned(spark):
    gold = gold_of(
        spark,
        {"timestamp": "2026-06-25T12:00:00Z", "voltage": 220.0, "failureRiskScore": 0.2},
        {"timestamp": "2026-06-25T12:59:59.999999Z", "voltage": 230.0, "failureRiskScore": 0.9},
        {"timestamp": "2026-06-25T13:00:00Z"},
    )
    assert gold.columns == GOLD.names
    first, second = gold.orderBy("windowStart").withColumn(
        "windowStart", F.col("windowStart").cast("timestamp_ntz")
    ).collect()
    assert (first.windowStart, second.windowStart) == (datetime(2026, 6, 25, 12), datetime(2026, 6, 25, 13))
    assert (first.voltage, first.maxFailureRiskScore) == (225.0, 0.9)
    assert (first.alertCount, first.measurementCount, first.status) == (1, 2, "ALERT")
    assert (second.alertCount, second.status) == (0, "NORMAL")


def test_null_flag_counts_as_no_alert(spark):
    (row,) = gold_of(spark, {"status": None}, {"status": "ALERT"}).collect()
    assert (row.alertCount, row.measurementCount) == (1, 2)


def test_groups_split_by_region(spark):
    assert gold_of(spark, {"region": "A"}, {"region": " a "}, {"region": "b"}).count() == 2


def test_region_mean_is_unweighted_over_hours(spark):
    gold = gold_of(
        spark,
        *[{"timestamp": f"2026-06-25T12:0{n}:00Z", "failureRiskScore": 0.9} for n in range(3)],
        {"timestamp": "2026-06-25T13:00:00Z", "failureRiskScore": 0.1},
        {"region": "Z", "failureRiskScore": 0.5},
    )
    rows = questions.regions_highest_risk(gold).collect()
    assert [(r.region, round(r.averageRisk, 9), r.highestRisk, r.measurements) for r in rows] == [
        ("r1", 0.5, 0.9, 4), ("z", 0.5, 0.5, 1),
    ]


def test_transformer_ranking_breaks_ties(spark):
    gold = gold_of(
        spark,
        {"transformerId": "b", "failureRiskScore": 0.85},
        {"transformerId": "a", "failureRiskScore": 0.85},
        {"transformerId": "c", "failureRiskScore": 0.95},
        {"transformerId": "d", "failureRiskScore": 0.1},
    )
    assert [r.transformerId for r in questions.transformers_most_alerts(gold).collect()] == ["c", "a", "b", "d"]


def test_hours_and_trend_are_ordered(spark):
    gold = gold_of(
        spark,
        {"timestamp": "2026-06-26T01:10:00Z", "load": 20},
        {"timestamp": "2026-06-25T23:10:00Z", "load": 40},
        {"timestamp": "2026-06-25T01:20:00Z", "load": 60},
    )
    assert [(r.hour, r.averageLoad) for r in questions.average_load_by_hour(gold).collect()] == [(1, 0.4), (23, 0.4)]
    assert questions.failure_risk_trend(gold).count() == 3


def test_preview_formats_cells_and_keeps_order(spark):
    answer = spark.createDataFrame(
        [(f"k{n:02d}", n / 3, n, datetime(2026, 6, 25, 12), None) for n in range(30)],
        "name string, mean double, n bigint, at timestamp_ntz, gap double",
    ).orderBy("name")
    rows = questions.report_preview(answer).collect()
    assert len(rows) == 20
    assert tuple(rows[2]) == ("k02", "0.667", "2", "2026-06-25 12:00:00.0", "")


def test_empty_gold_gives_empty_answers(spark):
    empty = spark.createDataFrame([], GOLD)
    assert all(ask(empty).count() == 0 for ask in questions.QUESTIONS.values())


def test_partial_aggregation_precedes_the_only_shuffle(spark):
    plan = gold_of(spark, {})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "partial_sum" in plan
