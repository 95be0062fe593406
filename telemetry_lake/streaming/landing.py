"""Sensor topic to bronze."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from telemetry_lake.schemas import BRONZE
from telemetry_lake.sources.bronze import to_bronze
from telemetry_lake.sources.lake import held
from telemetry_lake.sources.tables import publish_batch, read_before, run_name

_PLACE = ["topic", "partition", "offset"]


def unlanded(records: DataFrame, bronze: DataFrame) -> DataFrame:
    """The records, each once, whose place in the topic bronze does not hold yet.

    Bronze is pruned to the topic partitions and the range of offsets that the records span: one row
    per topic partition reaches the driver.
    """
    spans = records.groupBy("partition").agg(F.min("offset").alias("low"), F.max("offset").alias("high")).collect()
    if not spans:
        return records
    low, high = min(s.low for s in spans), max(s.high for s in spans)
    near = bronze.filter(F.col("partition").isin([s.partition for s in spans]) & F.col("offset").between(low, high))
    return records.dropDuplicates(_PLACE).join(near.select(*_PLACE), _PLACE, "left_anti").select(*BRONZE.names)


def land(records: DataFrame, path: str, checkpoint: str, bounded: bool = False) -> StreamingQuery:
    """Append every record to bronze once, by topic partition, some files per micro-batch.

    A micro-batch owns its folder and leaves out what other batches have landed, so neither a retry, a
    restart nor a second query with a checkpoint of its own loses a record or adds one twice. Two queries
    that land the same record at the same moment may both add it; `read_bronze` takes it once.
    `bounded` stops once everything there at the start has landed.
    """
    run = run_name(checkpoint)

    def step(batch: DataFrame, batch_id: int) -> None:
        # Objects are opened and payloads cleaned once: the rows are read for their places, and to be landed.
        with held(to_bronze(batch), f"{path}/_attempts/{uuid.uuid4().hex}") as rows:
            bronze = read_before(batch.sparkSession, path, BRONZE, run, batch_id)
            publish_batch(unlanded(rows, bronze), path, run, batch_id, "partition")

    writer = records.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if bounded else writer).start()
