"""Severity words: of a score, of a free-text message field, and for display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from telemetry_lake.functions.text import UNKNOWN, or_fallback
from telemetry_lake.schemas import AlertRules

WARNING = "WARNING"
CRITICAL = "CRITICAL"


def at_least(score: Column, threshold: float) -> Column:
    """`score >= threshold`, with NaN counting as below (Spark orders NaN above every number)."""
    return ~F.isnan(score) & (score >= F.lit(threshold))


def severity_of_score(score: Column, rules: AlertRules = AlertRules()) -> Column:
    return F.when(at_least(score, rules.critical), CRITICAL).when(at_least(score, rules.warning), WARNING)


def reason_of(score: Column, severity: Column, rules: AlertRules = AlertRules()) -> Column:
    return F.format_string(
        f"failureRiskScore=%s -> %s (warn>={rules.warning}, crit>={rules.critical})",
        score.cast("string"),
        severity,
    )


def severity_word(text: Column) -> Column:
    """Trimmed upper-case word of a message; blank or missing reads as UNKNOWN."""
    return F.upper(or_fallback(text, UNKNOWN))


def severity_category(text: Column) -> Column:
    word = severity_word(text)
    return F.when(word.isin(WARNING, CRITICAL), word).otherwise(UNKNOWN)


def severity_display(text: Column) -> Column:
    word = severity_word(text)
    return F.when(word.isin(WARNING, CRITICAL), word).otherwise(F.concat(F.lit("UNKNOWN("), word, F.lit(")")))


def badge_class(category: Column) -> Column:
    return (
        F.when(category == CRITICAL, "critical").when(category == WARNING, "warning").otherwise("unknown")
    )
