"""Numeric and time helpers of the lake layers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _exact(value: Column) -> Column:
    return value.try_cast("decimal(20,10)")


def stable_avg(value: Column) -> Column:
    """Mean that does not depend on summation order, so retries and other engines agree bit for bit.

    Values are summed as decimals with 10 places. Where a value has no such form (NaN, infinities
    and magnitudes of 10^10 and more), the mean is the plain one, and NaN spreads as it always does.
    """
    exact = _exact(value)
    stable = F.sum(exact).cast("double") / F.count(exact)
    return F.when(F.count(exact) == F.count(value), stable).otherwise(F.avg(value))


def mean_state(value: Column) -> Column:
    """What `stable_avg` needs to know of some values, so that it can be added to that of others."""
    exact = _exact(value)
    return F.struct(
        F.sum(exact).cast("decimal(38,10)").alias("total"),
        F.count(exact).alias("exact"),
        F.sum(value).alias("plain"),
        F.count(value).alias("values"),
    )


def added_states(state: Column) -> Column:
    """The states of several sets of values as that of all of them."""
    return F.struct(
        F.sum(state["total"]).cast("decimal(38,10)").alias("total"),
        F.sum(state["exact"]).alias("exact"),
        F.sum(state["plain"]).alias("plain"),
        F.sum(state["values"]).alias("values"),
    )


def mean_of_state(state: Column) -> Column:
    """The mean that `stable_avg` gives of the values."""
    stable = state["total"].cast("double") / state["exact"]
    return F.when(state["exact"] == state["values"], stable).otherwise(state["plain"] / state["values"])


def load_ratio(load: Column) -> Column:
    """Percentages above 1 and up to 100 become ratios; everything else is kept."""
    return F.when((load > F.lit(1.0)) & (load <= F.lit(100.0)), load / F.lit(100.0)).otherwise(load)


def event_time(text: Column) -> Column:
    """Instant of an ISO-8601 text, null where it has none.

    "T" becomes a space and "Z" is dropped, so the rest reads in the session zone (UTC). Texts
    that do not start with a year would parse as a time of *today* and are refused.
    """
    plain = F.translate(text, "TZ", " ")
    return F.when(plain.rlike(r"^\s*[+-]?\d{4}"), F.try_to_timestamp(plain))
