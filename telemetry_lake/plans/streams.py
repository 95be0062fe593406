"""The streaming services, from Kafka or from folders of records.

    python -m telemetry_lake.plans.streams land    SOURCE BRONZE CHECKPOINT
    python -m telemetry_lake.plans.streams gold    BRONZE GOLD CHECKPOINT
    python -m telemetry_lake.plans.streams detect  SOURCE ROOT CHECKPOINT
    python -m telemetry_lake.plans.streams handle  SOURCE ROOT CHECKPOINT RECIPIENTS [RECLAIM_AFTER]
    python -m telemetry_lake.plans.streams publish MESSAGES kafka:SERVERS/TOPIC CHECKPOINT

SOURCE is a folder, `objects:FOLDER` for one object per record, or `kafka:SERVERS/TOPIC` where the Kafka package is installed; `?max=N` behind it
sets how many files or offsets a micro-batch takes at most, so a backlog is worked off in bounded
steps. Landing and detection of one topic are two queries with a checkpoint each, so either can be
stopped alone. `gold` follows the folder that landing writes and keeps hourly gold. `publish` sends the detector's messages to a topic. RECLAIM_AFTER is an interval such as
"15 minutes" after which a claimed notification may be claimed again.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from telemetry_lake.session import configure
from telemetry_lake.sources.bronze import object_stream
from telemetry_lake.sources.topics import file_stream, kafka_sink, kafka_stream
from telemetry_lake.streaming.detector import MESSAGE_SCHEMA, DetectorPaths, detect_stream
from telemetry_lake.streaming.handler import HandlerPaths, handle_stream
from telemetry_lake.streaming.landing import land
from telemetry_lake.streaming.rollup import roll_up


# What a micro-batch takes where the source does not say.
MAX_OFFSETS = 5_000_000
MAX_FILES = 1_000


def _topic_of(source: str) -> tuple[str, str]:
    servers, _, topic = source.removeprefix("kafka:").rpartition("/")
    return servers, topic


def records(spark: SparkSession, source: str) -> DataFrame:
    source, _, bound = source.partition("?max=")
    if source.startswith("kafka:"):
        return kafka_stream(spark, *_topic_of(source), int(bound or MAX_OFFSETS))
    if source.startswith("objects:"):
        return object_stream(spark, source.removeprefix("objects:"), int(bound or MAX_FILES))
    return file_stream(spark, source, int(bound or MAX_FILES))


def handler_paths(root: str, checkpoint: str) -> HandlerPaths:
    folders = (f"{root}/{name}" for name in ("history", "ledger", "outbox", "quarantine"))
    return HandlerPaths(*folders, checkpoint)


def start(spark: SparkSession, service: str, source: str, target: str, checkpoint: str, *rest: str) -> StreamingQuery:
    if service == "publish":
        messages = file_stream(spark, f"{source}/run=*/batch=*", MAX_FILES, MESSAGE_SCHEMA)
        return kafka_sink(messages, *_topic_of(target), checkpoint).start()
    stream = records(spark, source)
    if service == "land":
        return land(stream, target, checkpoint)
    if service == "gold":
        return roll_up(stream, target, checkpoint)
    if service == "detect":
        paths = DetectorPaths(
            messages=f"{target}/messages",
            quarantine=f"{target}/quarantine",
            readings=f"{target}/readings",
            streaks=f"{target}/streaks",
            checkpoint=checkpoint,
        )
        return detect_stream(stream, paths)
    if service == "handle":
        recipients, *reclaim_after = rest
        paths = handler_paths(target, checkpoint)
        return handle_stream(stream, paths, recipients, reclaim_after=reclaim_after[0] if reclaim_after else None)
    raise ValueError(f"unknown service: {service}")


def main(args: list[str]) -> None:
    spark = configure(SparkSession.builder.appName(f"telemetry-{args[0]}").getOrCreate())
    start(spark, *args).awaitTermination()


if __name__ == "__main__":
    main(sys.argv[1:])
