from __future__ import annotations

import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from telemetry_lake.functions import measures, scoring, severity, text


def values(spark, rows, schema, expression):
    data = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], f"i int, {schema}")
    return [r[0] for r in data.orderBy("i").select(expression.alias("x")).collect()]


def test_score_severity_thresholds_are_inclusive(spark):
    scores = [(0.5,), (0.8,), (0.85,), (0.9,), (0.95,), (float("nan"),), (None,)]
    assert values(spark, scores, "s double", severity.severity_of_score(F.col("s"))) == [
        None, "WARNING", "WARNING", "CRITICAL", "CRITICAL", None, None,
    ]


def test_reason_names_score_and_severity(spark):
    got = values(spark, [(0.95,)], "s double", severity.reason_of(F.col("s"), F.lit("CRITICAL")))
    assert got == ["failureRiskScore=0.95 -> CRITICAL (warn>=0.8, crit>=0.9)"]


def test_severity_words(spark):
    words = [("WARNING",), (" warning ",), ("\tCRITICAL\n",), ("critical",), ("minor",), ("  ",), (None,)]
    assert values(spark, words, "w string", severity.severity_category(F.col("w"))) == [
        "WARNING", "WARNING", "CRITICAL", "CRITICAL", "UNKNOWN", "UNKNOWN", "UNKNOWN",
    ]
    assert values(spark, words, "w string", severity.severity_display(F.col("w")))[4:] == [
        "UNKNOWN(MINOR)", "UNKNOWN(UNKNOWN)", "UNKNOWN(UNKNOWN)",
    ]
    category = severity.severity_category(F.col("w"))
    assert values(spark, words, "w string", severity.badge_class(category))[2:5] == ["critical", "critical", "unknown"]


def test_blank_trimming_reaches_control_characters_but_not_no_break_space(spark):
    rows = [(" a ",), ("\t\r\na b\x00\x1f",), (" a",), ("",), (None,)]
    assert values(spark, rows, "t string", text.or_fallback(F.col("t"), "none")) == [
        "a", "a b", " a", "none", "none",
    ]


def test_address_list_splits_trims_and_keeps_first_occurrence(spark):
    rows = [("ops@grid.test;\n night@grid.test , ops@grid.test",), (" ; ,\r\n",), (None,)]
    assert values(spark, rows, "t string", text.address_list(F.col("t"))) == [
        ["ops@grid.test", "night@grid.test"], [], [],
    ]


def test_round2_sends_ties_up(spark):
    rows = [(1.005,), (0.125,), (-0.125,), (2.0,), (float("nan"),)]
    assert values(spark, rows, "x double", scoring.round2(F.col("x"))) == [1.0, 0.13, -0.12, 2.0, 0.0]


def test_clamp_keeps_nan(spark):
    low, high, inside, odd = values(
        spark, [(-1.0,), (3.0,), (0.4,), (float("nan"),)], "x double", scoring.clamp01(F.col("x"))
    )
    assert (low, high, inside) == (0.0, 1.0, 0.4) and math.isnan(odd)


@pytest.mark.parametrize(
    ("reading", "score", "status"),
    [
        ((230.0, 60.0, 70.0), 0.0, "NORMAL"),
        ((260.0, 100.0, 100.0), 1.0, "CRITICAL"),
        ((200.0, 100.0, 85.0), 0.85, "WARNING"),
        ((230.0, 80.0, 100.0), 0.55, "NORMAL"),
        ((400.0, 500.0, 400.0), 1.0, "CRITICAL"),
    ],
)
def test_risk_score(spark, reading, score, status):
    expression = scoring.risk_score(F.col("v"), F.col("t"), F.col("l"))
    (got,) = values(spark, [reading], "v double, t double, l double", expression)
    assert got == pytest.approx(score)
    rounded = scoring.status_of_score(scoring.round2(expression))
    assert values(spark, [reading], "v double, t double, l double", rounded) == [status]


def test_load_ratio(spark):
    rows = [(0.5,), (1.0,), (1.5,), (100.0,), (100.01,), (-1.0,), (None,)]
    assert values(spark, rows, "x double", measures.load_ratio(F.col("x"))) == [
        0.5, 1.0, 0.015, 1.0, 100.01, -1.0, None,
    ]


def test_event_time(spark):
    rows = [
        ("2026-06-25T12:00:00Z",), ("2026-06-25 12:00:00.123456789",), ("2026-06-25T12:00:00+02:00",),
        ("2026-06-25",), ("2026",), ("12:30",), ("T12:30Z",), ("zz",), ("2026-06-25T12:00:00 UTC",), (None,),
    ]
    got = values(spark, rows, "t string", measures.event_time(F.col("t")).cast("timestamp_ntz"))
    assert got == [
        datetime(2026, 6, 25, 12), datetime(2026, 6, 25, 12, 0, 0, 123456), datetime(2026, 6, 25, 10),
        datetime(2026, 6, 25), datetime(2026, 1, 1), None, None, None, None, None,
    ]


def test_stable_avg_ignores_order_and_loses_no_value(spark):
    numbers = [0.1, 0.2, 0.3, 1e9, -1e9, 0.7]
    up = spark.createDataFrame([(x,) for x in numbers], "x double").coalesce(1)
    down = spark.createDataFrame([(x,) for x in reversed(numbers)], "x double").repartition(3)
    mean = measures.stable_avg(F.col("x"))
    assert up.agg(mean).first()[0] == down.agg(mean).first()[0] == pytest.approx(1.3 / 6)
    odd = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double")
    assert odd.agg(mean).first()[0] != odd.agg(mean).first()[0]
    assert odd.limit(0).agg(mean).first()[0] is None
    wide = spark.createDataFrame([(1.0,), (3e10,), (None,)], "x double")
    assert wide.agg(mean).first()[0] == (1.0 + 3e10) / 2
    assert spark.createDataFrame([(float("inf"),), (1.0,)], "x double").agg(mean).first()[0] == float("inf")
