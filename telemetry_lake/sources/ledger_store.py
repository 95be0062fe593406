"""The stored notification ledger: entries of alerts, claimed by one writer only.

What a step appends is computed from the version it is committed after, so it names the revision that it follows
in fact: where two handlers claim from one state, the second to commit sees the first one's claims, and claims
nothing. Each entry names its owner, so a batch that is retried finds what it had claimed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from telemetry_lake.operators.outbox import SENDING
from telemetry_lake.schemas import LEDGER
from telemetry_lake.sources import commits, keyed
from telemetry_lake.sources.commits import Version
from telemetry_lake.sources.lake import through_table

KEY = "alertId"
ENTRIES = StructType([*LEDGER.fields, StructField("owner", StringType())])


def owner_of(query: str, batch: int) -> str:
    return f"{query}/{batch}"


def entries(spark: SparkSession, table: str, version: Version | None = None) -> DataFrame:
    """All entries of a version, the latest if none is given."""
    return keyed.read_parts(spark, table, (version or commits.latest(spark, table)).parts, ENTRIES)


def entries_of(spark: SparkSession, table: str, version: Version, ids: DataFrame) -> DataFrame:
    """The entries of the given alerts (one row for each id); only buckets that may hold one are opened."""
    return keyed.lookup(spark, table, version.parts, ids, KEY, ENTRIES)


def append_step(
    spark: SparkSession,
    table: str,
    ids: DataFrame,
    step: Callable[[DataFrame], DataFrame],
    query: str,
    batch: int,
    before: Callable[[], None] = lambda: None,
) -> Version:
    """Commit the entries that `step` makes of the ledger of `ids`, as one batch of a query.

    `step` runs again on the newer ledger whenever another writer was first. `before` is called before each commit
    (tests let others commit there).
    """

    def write(version: Version, name: str) -> dict | None:
        ledger = entries_of(spark, table, version, ids).select(*LEDGER.names)
        new = step(ledger).withColumn("owner", F.lit(owner_of(query, batch)))
        said = keyed.write_part(through_table(spark, new, "entries"), table, name, KEY, ENTRIES)
        before()
        return said

    return commits.append(spark, table, write, query, batch)


def claims_of(spark: SparkSession, table: str, version: Version, ids: DataFrame, query: str, batch: int) -> DataFrame:
    """The claims that a batch holds still: entries of its own that nothing has followed."""
    mine = (F.col("owner") == owner_of(query, batch)) & (F.col("status") == SENDING)
    return entries_of(spark, table, version, ids).where(mine).select(*LEDGER.names)


def compact(spark: SparkSession, table: str, fan_in: int = 4) -> Version:
    """Merge parts of similar size until none are due. All entries stay: they are the audit of the notifications."""
    while True:
        version = commits.latest(spark, table)
        due = commits.merge_due(version.parts, fan_in)
        if not due:
            return version
        rows = keyed.read_parts(spark, table, due, ENTRIES)
        commits.replace(spark, table, due, lambda name: keyed.write_part(rows, table, name, KEY, ENTRIES))
