"""Bronze to gold as records arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from telemetry_lake.operators.silver import parse_text_readings, to_silver
from telemetry_lake.schemas import AlertRules
from telemetry_lake.sources.gold_store import add_readings
from telemetry_lake.sources.tables import run_name


def roll_up(
    records: DataFrame, path: str, checkpoint: str, rules: AlertRules = AlertRules(), bounded: bool = False
) -> StreamingQuery:
    """Keep hourly gold up to date with a stream of bronze records, each of which must come once (as landing
    gives them). A micro-batch costs its own readings and the states of the days they fall on."""
    run = run_name(checkpoint)

    def step(batch: DataFrame, batch_id: int) -> None:
        add_readings(batch.sparkSession, path, to_silver(parse_text_readings(batch), rules), run, batch_id)

    writer = records.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if bounded else writer).start()
