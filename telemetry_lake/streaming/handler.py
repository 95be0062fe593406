"""Alert topic to history, ledger and outbox."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from telemetry_lake.functions.severity import CRITICAL
from telemetry_lake.operators import outbox as notifications
from telemetry_lake.operators.decode import accepted, decode_alerts, only_refused_payloads, quarantined
from telemetry_lake.operators.history import first_arrivals, stored_alerts
from telemetry_lake.schemas import BRONZE, LEDGER
from telemetry_lake.session import scratch_dir
from telemetry_lake.sources import alert_store, commits, ledger_store
from telemetry_lake.sources.lake import held
from telemetry_lake.sources.tables import publish_batch, run_name

# Parts of one size that are merged into one.
FAN_IN = 8


@dataclass(frozen=True)
class HandlerPaths:
    history: str
    ledger: str
    outbox: str
    quarantine: str
    checkpoint: str


def handle_stream(
    messages: DataFrame,
    paths: HandlerPaths,
    recipients: str,
    now: Column | None = None,
    reclaim_after: str | None = None,
    bounded: bool = False,
) -> StreamingQuery:
    """Store every new alert once and claim a notification for every critical one.

    History and ledger are tables of committed parts (see `sources.alert_store`, `sources.ledger_store`). A
    batch looks its ids up through their filters, and commits once: a retry finds what it had committed, a replay
    under a new checkpoint finds every id stored, and of two handlers at work on one topic one claims a
    notification. Notifications and refused messages are published once per batch.
    """
    run = run_name(paths.checkpoint)
    instant = F.current_timestamp() if now is None else now

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        with held(only_refused_payloads(decode_alerts(batch)), scratch_dir(spark, "decoded")) as decoded:
            publish_batch(quarantined(decoded, BRONZE.names), paths.quarantine, run, batch_id)
            arrived = stored_alerts(accepted(decoded))
            stored = alert_store.insert_absent(spark, paths.history, first_arrivals(arrived), run, batch_id)

            critical = arrived.filter(F.col("severity") == CRITICAL)
            ids = critical.select("alertId").distinct()
            history = alert_store.stored_ids(spark, paths.history, stored, ids)

            def claim(ledger: DataFrame) -> DataFrame:
                prepared = notifications.prepare(ids, ledger, instant)
                return prepared.unionByName(notifications.claim(ids, history, ledger, instant, reclaim_after))

            ledger = ledger_store.append_step(spark, paths.ledger, ids, claim, run, batch_id)
            due = ledger_store.claims_of(spark, paths.ledger, ledger, ids, run, batch_id)
            notes = notifications.outbox(due, critical, recipients)
            publish_batch(notes.join(due.select("alertId", "revision"), "alertId"), paths.outbox, run, batch_id)
            alert_store.compact(spark, paths.history, FAN_IN)
            ledger_store.compact(spark, paths.ledger, FAN_IN)

    writer = messages.writeStream.foreachBatch(step).option("checkpointLocation", paths.checkpoint)
    return (writer.trigger(availableNow=True) if bounded else writer).start()


def record_results(results: DataFrame, paths: HandlerPaths, run: str, batch: int, now: Column) -> None:
    """Append the delivery results `(alertId, error, sequence)` of one send to the ledger, once.

    With the `revision` that the outbox names, a result counts only while its claim holds.
    """
    spark = results.sparkSession
    ids = results.select("alertId").distinct()
    history = alert_store.stored_ids(spark, paths.history, commits.latest(spark, paths.history), ids)

    def record(ledger: DataFrame) -> DataFrame:
        return notifications.record(results, history, ledger.select(*LEDGER.names), now)

    ledger_store.append_step(spark, paths.ledger, ids, record, run, batch)
