from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from telemetry_lake.operators.silver import parse_text_readings, to_silver
from telemetry_lake.schemas import SILVER
from tests.samples import READING, reading, topic


def silver_rows(spark, *values):
    return to_silver(parse_text_readings(topic(spark, values))).collect()


def test_clean_reading(spark):
    (row,) = silver_rows(spark, reading(sensorId=" S-1 ", region=" Ile-de-France ", status=" overload "))
    assert row.asDict() | {"eventTime": None} == {
        "sensorId": "s-1", "transformerId": "tr-1", "timestamp": "2027-02-03T04:00:00Z",
        "region": "ile-de-france", "voltage": 230.0, "current": 10.0, "temperature": 40.0, "load": 0.5,
        "failureRiskScore": 0.5, "status": "OVERLOAD", "eventTime": None, "isAlert": True,
    }


@pytest.mark.parametrize(
    ("change", "load"),
    [({"load": 0.5}, 0.5), ({"load": 1.0}, 1.0), ({"load": 100}, 1.0), ({"load": "50"}, 0.5),
     ({"sensorId": "  "}, 0.5), ({"extra": 1}, 0.5), ({"failureRiskScore": "0.5"}, 0.5), ({"region": 75}, 0.5)],
)
def test_kept(spark, change, load):
    (row,) = silver_rows(spark, reading(**change))
    assert row.load == load


@pytest.mark.parametrize(
    "change",
    [{"load": 100.01}, {"load": -1}, {"load": "x"}, {"load": None}, {"failureRiskScore": 1.1},
     {"failureRiskScore": float("nan")}, {"voltage": float("nan")}, {"timestamp": "zz"},
     {"timestamp": "12:30"}, {"sensorId": None}, {"region": None}, {"temperature": None}],
)
def test_dropped(spark, change):
    assert silver_rows(spark, reading(**change)) == []


def test_not_json_is_dropped(spark):
    assert silver_rows(spark, "not json", "{}", "", "[1]") == []


def test_flag_has_three_values(spark):
    rows = silver_rows(
        spark,
        reading(sensorId="a", status=None),
        reading(sensorId="b", status=None, failureRiskScore=0.8),
        reading(sensorId="c", status="online"),
        reading(sensorId="d", status="overheating"),
    )
    assert {r.sensorId: r.isAlert for r in rows} == {"a": None, "b": True, "c": False, "d": True}


def test_missing_column_counts_as_null(spark):
    no_status = spark.createDataFrame([READING]).drop("status")
    (row,) = to_silver(no_status).collect()
    assert row.status is None and row.isAlert is None
    assert to_silver(no_status.drop("region")).count() == 0


def test_schema_and_single_parse(spark):
    silver = to_silver(parse_text_readings(topic(spark, [reading()])))
    assert [(f.name, f.dataType) for f in silver.schema] == [(f.name, f.dataType) for f in SILVER]
    plan = silver._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1
    assert "Exchange" not in silver._jdf.queryExecution().executedPlan().toString()
    assert silver.select(F.col("load")).first()[0] == 0.5
