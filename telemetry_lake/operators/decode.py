"""Strict decoding of sensor and alert messages.

A message is accepted only if it is a JSON object and every field is there with the right type:
text fields must be JSON strings, numbers may be JSON numbers or numeric strings, and an
explicit `null` measurement reads as NaN. Anything else is refused, never repaired.

Parsing into text fields is cheap but loses the JSON types. Only a message it leaves in doubt (a
text that looks like another type, a field that is null or missing) is parsed again into VARIANT
fields, which keep them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemetry_lake.functions.measures import event_time
from telemetry_lake.schemas import NUMBER_FIELDS, READING_FIELDS

_JSON_NUMBER = r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$"
_MAYBE_NOT_TEXT = r"^(-?[0-9.]+([eE][-+]?[0-9]+)?|true|false|[\[{].*)$"
# Plain JSON only: no bare NaN, no single quotes.
_PLAIN_JSON = {"allowNonNumericNumbers": "false", "allowSingleQuotes": "false"}

_ALERT_TEXTS = ("alertId", "severity", "reason")
_STORED_TEXTS = ("alertId", "severity", "originalSeverity", "reason")


def _reading_schema(kind: str) -> str:
    return ", ".join(f"{name} {kind}" for name in READING_FIELDS)


def _alert_schema(kind: str, texts: tuple[str, ...]) -> str:
    own = ", ".join(f"{name} {kind}" for name in (*texts, "detectedAt"))
    return f"{own}, source struct<{_reading_schema(kind)}>"


# ---- first parse: every field as text


def _number(text: Column, kind: str = "double") -> Column:
    return F.when(text.rlike(_JSON_NUMBER), text.try_cast(kind))


def _reading(parsed: Column) -> list[Column]:
    return [
        (_number(parsed[name]) if name in NUMBER_FIELDS else parsed[name]).alias(name)
        for name in READING_FIELDS
    ]


def _doubts(parsed: Column) -> list[Column]:
    return [
        parsed[name].isNull() if name in NUMBER_FIELDS else _doubt(parsed[name]) for name in READING_FIELDS
    ]


def _doubt(text: Column) -> Column:
    return text.isNull() | text.rlike(_MAYBE_NOT_TEXT)


# ---- second parse: every field as a VARIANT


def _typed_text(field: Column) -> Column:
    return F.when(F.schema_of_variant(field) == "STRING", F.try_variant_get(field, "$", "string"))


def _typed_number(field: Column) -> Column:
    return F.when(F.is_variant_null(field), F.lit(float("nan"))).otherwise(
        _number(F.try_variant_get(field, "$", "string"))
    )


def _typed_reading(typed: Column) -> list[Column]:
    return [
        (_typed_number if name in NUMBER_FIELDS else _typed_text)(typed[name]).alias(name)
        for name in READING_FIELDS
    ]


# ---- messages


def _decode(
    raw: DataFrame,
    schema: str,
    typed_schema: str,
    fields: list[Column],
    typed_fields: list[Column],
    doubts: list[Column],
    needed: list[str],
) -> DataFrame:
    """Fields read `_parsed`, typed fields `_typed`.

    One step per column: each becomes a compiled method of its own, small enough for the JIT.
    The decoded struct sits behind a generator, so a filter on `isValid` cannot pull the
    decoding below itself and repeat it.
    """
    json_object = F.when(F.ltrim("value").startswith("{"), F.col("value"))
    again = F.from_json(F.when(F.col("_doubt"), json_object), typed_schema, _PLAIN_JSON)
    present = reduce(Column.__and__, [F.col(name).isNotNull() for name in needed])
    return (
        raw.withColumn("_parsed", F.from_json(json_object, schema, _PLAIN_JSON))
        .withColumn("_doubt", reduce(Column.__or__, doubts))
        .withColumn("_typed", again)
        .withColumn("_exact", F.when(F.col("_doubt"), F.struct(*typed_fields)))
        .select(
            *raw.columns,
            F.inline(F.array(F.when(F.col("_doubt"), F.col("_exact")).otherwise(F.struct(*fields)))),
        )
        .withColumn("isValid", present)
    )


def decode_readings(raw: DataFrame) -> DataFrame:
    """`raw` (with a JSON `value` column) plus the 10 reading fields and `isValid`."""
    parsed, typed = F.col("_parsed"), F.col("_typed")
    return _decode(
        raw,
        _reading_schema("string"),
        _reading_schema("variant"),
        _reading(parsed),
        _typed_reading(typed),
        _doubts(parsed),
        list(READING_FIELDS),
    )


def decode_alerts(raw: DataFrame) -> DataFrame:
    """`raw` plus `alertId, severity, reason, detectedAt, source` and `isValid`."""
    return _decode_envelopes(raw, _ALERT_TEXTS)


def decode_stored(raw: DataFrame) -> DataFrame:
    """Stored payloads in `value`, by the same rules: `raw` plus `alertId, severity, originalSeverity, reason,
    detectedAt, source` and `isValid`."""
    return _decode_envelopes(raw, _STORED_TEXTS)


def _decode_envelopes(raw: DataFrame, texts: tuple[str, ...]) -> DataFrame:
    parsed, typed = F.col("_parsed"), F.col("_typed")
    fields = [
        *[parsed[name].alias(name) for name in texts],
        _number(parsed["detectedAt"], "bigint").alias("detectedAt"),
        F.struct(*_reading(parsed["source"])).alias("source"),
    ]
    typed_fields = [
        *[_typed_text(typed[name]).alias(name) for name in texts],
        _number(F.try_variant_get(typed["detectedAt"], "$", "string"), "bigint").alias("detectedAt"),
        F.struct(*_typed_reading(typed["source"])).alias("source"),
    ]
    doubts = [*[_doubt(parsed[name]) for name in texts], *_doubts(parsed["source"])]
    needed = [*texts, "detectedAt", *[f"source.{name}" for name in READING_FIELDS]]
    return _decode(raw, _alert_schema("string", texts), _alert_schema("variant", texts), fields, typed_fields, doubts, needed)


def accepted(decoded: DataFrame) -> DataFrame:
    return decoded.filter("isValid").drop("isValid")


def _with_event_time(decoded: DataFrame) -> DataFrame:
    """A reading whose own timestamp cannot be read counts at the time of its record."""
    return decoded.withColumn("eventTime", F.coalesce(event_time(F.col("timestamp")), F.col("kafkaTimestamp")))


def timed_readings(decoded: DataFrame, instant: str = "eventTime") -> DataFrame:
    """Accepted readings with their place in the topic and an event time, without the payload.

    Readings without the instant that the clock goes by (`eventTime` or `kafkaTimestamp`) are left to
    `quarantined`; the other instant may be missing.
    """
    timed = _with_event_time(accepted(decoded))
    return timed.filter(F.col(instant).isNotNull()).drop("value", "topic")


def quarantined(decoded: DataFrame, raw_columns: list[str], instant: str | None = None) -> DataFrame:
    """The untouched input rows of messages that were refused; with `instant` also those of readings
    that have no such time."""
    if instant is None:
        return decoded.filter(~F.col("isValid")).select(*raw_columns)
    timed = _with_event_time(decoded)
    return timed.filter(~F.col("isValid") | F.col(instant).isNull()).select(*raw_columns)


def apart(decoded: DataFrame, instant: str) -> DataFrame:
    """Every row with its event time and `refused`: what `quarantined` gives, the others being those of `timed_readings`.

    Only refused rows keep their payload and topic, so a table of this holds no payload twice.
    """
    timed = _with_event_time(decoded)
    refused = ~F.col("isValid") | F.col(instant).isNull()
    return _payloads_where(timed.withColumn("refused", refused), F.col("refused")).drop("isValid")


def only_refused_payloads(decoded: DataFrame) -> DataFrame:
    """Every row, of which only the refused ones keep their payload and topic: what `quarantined` gives, and what is
    decoded of the others."""
    return _payloads_where(decoded, ~F.col("isValid"))


def _payloads_where(rows: DataFrame, kept: Column) -> DataFrame:
    return rows.withColumns({name: F.when(kept, F.col(name)) for name in ("value", "topic")})
