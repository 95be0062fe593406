"""Merge the parts of the stored tables and remove what nobody reads any more.

    python -m telemetry_lake.plans.maintain ROOT [KEEP]

ROOT is the handler's. The last KEEP versions (100) of its history and ledger stay readable; parts that only older
ones list are removed. It may run beside the handler, whose own merges it does not disturb.
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from telemetry_lake.session import configure
from telemetry_lake.sources import alert_store, commits, ledger_store

KEEP = 100


def maintain(spark: SparkSession, history: str, ledger: str, keep: int = KEEP, fan_in: int = 4) -> dict[str, int]:
    """The number of live parts of each table afterwards."""
    left = {}
    for table, compact in ((history, alert_store.compact), (ledger, ledger_store.compact)):
        version = compact(spark, table, fan_in)
        commits.expire(spark, table, version.number + 1 - keep)
        left[table] = len(version.parts)
    return left


def main(args: list[str]) -> None:
    root, *keep = args
    spark = configure(SparkSession.builder.appName("telemetry-maintain").getOrCreate())
    print("[maintain]", maintain(spark, f"{root}/history", f"{root}/ledger", int(keep[0]) if keep else KEEP))
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
