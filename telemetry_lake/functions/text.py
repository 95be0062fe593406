"""Text clean-up used by the alert handler, which trims control characters as well as spaces."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANKS = "".join(chr(code) for code in range(0x21))

# What replaces a blank field.
UNKNOWN_REGION = "unknown-region"
UNKNOWN_SENSOR = "unknown-sensor"
UNKNOWN_TRANSFORMER = "unknown-transformer"
UNKNOWN_STATUS = "unknown-status"
MISSING_ALERT_ID = "missing-alert-id"
NO_REASON = "No reason provided"
UNKNOWN = "UNKNOWN"


def trim_blanks(text: Column) -> Column:
    """Strip every leading and trailing character up to U+0020."""
    return F.btrim(text, F.lit(_BLANKS))


def or_fallback(text: Column, fallback: str) -> Column:
    return F.coalesce(F.nullif(trim_blanks(text), F.lit("")), F.lit(fallback))


def region_or_unknown(region: Column) -> Column:
    return or_fallback(region, UNKNOWN_REGION)


def address_list(raw: Column) -> Column:
    """Addresses separated by commas, semicolons or line breaks, without blanks or repeats."""
    parts = F.transform(F.split(F.coalesce(raw, F.lit("")), r"[,;\r\n]+"), trim_blanks)
    return F.array_distinct(F.filter(parts, lambda part: part != ""))
