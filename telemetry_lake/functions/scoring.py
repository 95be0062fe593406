"""The failure-risk score of a reading and the status word it maps to."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from telemetry_lake.functions.severity import severity_of_score
from telemetry_lake.schemas import AlertRules

# Fixed values of the scoring rule: weight, level without risk, span up to full risk.
TEMPERATURE = (0.5, 60.0, 40.0)
LOAD_PERCENT = (0.3, 70.0, 30.0)
VOLTAGE = (0.2, 230.0, 30.0)


def clamp01(value: Column) -> Column:
    """Limit to [0, 1]; NaN stays NaN, which `least` alone would turn into 1."""
    return F.when(F.isnan(value), value).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def round2(value: Column) -> Column:
    """Two decimals, ties toward positive infinity (`F.round` sends negative ties down)."""
    return F.floor(value * F.lit(100.0) + F.lit(0.5)) / F.lit(100.0)


def risk_score(voltage: Column, temperature: Column, load_percent: Column) -> Column:
    def part(distance: Column, span: float) -> Column:
        return clamp01(distance / F.lit(span))

    weight_t, base_t, span_t = TEMPERATURE
    weight_l, base_l, span_l = LOAD_PERCENT
    weight_v, base_v, span_v = VOLTAGE
    return clamp01(
        F.lit(weight_t) * part(temperature - F.lit(base_t), span_t)
        + F.lit(weight_l) * part(load_percent - F.lit(base_l), span_l)
        + F.lit(weight_v) * part(F.abs(voltage - F.lit(base_v)), span_v)
    )


def status_of_score(score: Column, rules: AlertRules = AlertRules()) -> Column:
    return F.coalesce(severity_of_score(score, rules), F.lit("NORMAL"))
