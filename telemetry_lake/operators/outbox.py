"""Notification outbox and its ledger.

The ledger is an append-only log of states; the highest revision of an alert is its state, and
an alert without an entry is NOT_REQUIRED. Revisions count per alert. Each step returns only the
entries to append, so an update writes as much as the alerts it touches, not the whole ledger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemetry_lake.functions.messages import notification_body, notification_subject, notification_text
from telemetry_lake.functions.severity import CRITICAL
from telemetry_lake.functions.text import address_list
from telemetry_lake.operators.history import first_arrivals
from telemetry_lake.schemas import LEDGER

# The states of a notification.
NOT_REQUIRED = "NOT_REQUIRED"
PENDING = "PENDING"
SENDING = "SENDING"
SENT = "SENT"
FAILED = "FAILED"
CLAIMABLE = (PENDING, FAILED, NOT_REQUIRED)


def ledger_state(ledger: DataFrame) -> DataFrame:
    """The current state per alert."""
    return (
        ledger.groupBy("alertId")
        .agg(F.max_by(F.struct("status", "error", "updatedAt", "revision"), F.col("revision")).alias("state"))
        .select("alertId", "state.*")
    )


def _state_of(alert_ids: DataFrame, ledger: DataFrame) -> DataFrame:
    """Distinct ids with their state; entries of other alerts are dropped before the grouping."""
    ids = alert_ids.select("alertId").distinct()
    touched = ledger_state(ledger.join(ids, "alertId", "left_semi"))
    return ids.join(touched, "alertId", "left").withColumns(
        {
            "status": F.coalesce(F.col("status"), F.lit(NOT_REQUIRED)),
            "revision": F.coalesce(F.col("revision"), F.lit(0)),
        }
    )


def _entries(state: DataFrame, status: Column, error: Column, now: Column, step: int) -> DataFrame:
    """New entries, `step` revisions after the state they follow."""
    return state.select(
        "alertId",
        status.alias("status"),
        error.cast("string").alias("error"),
        now.cast("timestamp").alias("updatedAt"),
        (F.col("revision") + step).cast("bigint").alias("revision"),
    ).select(*LEDGER.names)


def prepare(critical_arrivals: DataFrame, ledger: DataFrame, now: Column) -> DataFrame:
    """PENDING for every alert that arrived as critical and is not under way or done."""
    waiting = _state_of(critical_arrivals, ledger).filter(F.col("status").isin(NOT_REQUIRED, FAILED))
    return _entries(waiting, F.lit(PENDING), F.lit(None), now, 1)


def claim(
    critical_arrivals: DataFrame,
    history: DataFrame,
    ledger: DataFrame,
    now: Column,
    reclaim_after: str | None = None,
) -> DataFrame:
    """SENDING for every alert that may be sent now, prepared in this round or not.

    The stored severity must be critical too: the first message of an id decides, so an id first
    stored as a warning is prepared but never sent. `reclaim_after` (an interval such as
    "15 minutes") also takes over claims whose sender died; by default they stay claimed.
    """
    state = _state_of(critical_arrivals, ledger)
    free = F.col("status").isin(*CLAIMABLE)
    if reclaim_after is not None:
        stale = F.col("updatedAt") < now.cast("timestamp") - F.expr(f"INTERVAL {reclaim_after}")
        free = free | ((F.col("status") == SENDING) & stale)
    critical_ids = history.filter(F.col("severity") == CRITICAL).select("alertId")
    claimed = state.filter(free).join(critical_ids, "alertId", "left_semi")
    return _entries(claimed, F.lit(SENDING), F.lit(None), now, 2)


def outbox(claims: DataFrame, critical_arrivals: DataFrame, recipients: str) -> DataFrame:
    """The claimed notifications as they are to be sent: the first critical arrival of each claimed id.

    What arrived is rendered, not what is stored: an id may come again with another payload.
    """
    arrived = first_arrivals(critical_arrivals.join(claims.select("alertId"), "alertId", "left_semi"))
    return arrived.select(
        "alertId",
        "detectedAt",
        notification_subject().alias("subject"),
        notification_body().alias("body"),
        address_list(F.lit(recipients)).alias("recipients"),
    )


def record(results: DataFrame, history: DataFrame, ledger: DataFrame, now: Column) -> DataFrame:
    """Entries for delivery results `(alertId, error, sequence)`: FAILED with its text, or SENT.

    Results for alerts that were never stored change nothing. Of several results for one alert
    the one with the highest sequence counts. Results may name the `revision` of the claim they are of; such a
    result counts only while that claim is the alert's state, so that a sender whose claim was taken over
    changes nothing.
    """
    held = "revision" in results.columns
    last = F.max_by(F.struct("error", *(["revision"] if held else [])), F.col("sequence")).alias("last")
    outcome = (
        results.groupBy("alertId")
        .agg(last)
        .select("alertId", F.col("last.error").alias("failure"), *([F.col("last.revision").alias("follows")] if held else []))
        .join(history.select("alertId"), "alertId", "left_semi")
    )
    state = _state_of(outcome, ledger).join(outcome, "alertId")
    if held:
        state = state.filter((F.col("status") == SENDING) & (F.col("revision") == F.col("follows")))
    status = F.when(F.col("failure").isNull(), SENT).otherwise(FAILED)
    return _entries(state, status, F.col("failure"), now, 1)


def ledger_report(history: DataFrame, ledger: DataFrame) -> DataFrame:
    """Every stored alert with its notification state."""
    return (
        history.select("alertId", "severity", "detectedAt")
        .join(ledger_state(ledger).drop("revision"), "alertId", "left")
        .withColumn("status", F.coalesce(F.col("status"), F.lit(NOT_REQUIRED)))
    )


def notification_audit(history: DataFrame, ledger: DataFrame, delivery: str) -> DataFrame:
    """One audit text per notification that was sent, oldest first."""
    sent = ledger_state(ledger).filter(F.col("status") == SENT).select("alertId", "updatedAt")
    return (
        history.join(sent, "alertId")
        .select("alertId", "updatedAt", notification_text(F.lit(delivery)).alias("entry"))
        .orderBy("updatedAt", "alertId")
    )
