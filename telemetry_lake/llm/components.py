"""Connected components of an edge table, by alternating stars on DataFrames.

Each round hangs every node's larger neighbours under its smallest one, then does the same with
the smaller neighbours; the edges shrink to one star per component in a number of rounds that
grows with the logarithm of the longest chain. No node's neighbours are gathered in one place:
a round is two aggregations with map-side combine and two joins that can be split when a node
has a large share of the edges. Every round is a written table, so a lost executor repeats at
most one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemetry_lake.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame) -> DataFrame:
    """`node`, `component` (its smallest reachable node) for every node of the edges `a`, `b` (long).

    Loops, repeated edges and either direction are fine; null ends are ignored. No edges: no rows.
    """
    now = stored(edges.select("a", "b").where("a <> b").distinct(), "edges")
    state = _state(now)
    while state[0]:
        now = stored(_small_star(_large_star(now)), "edges")
        before, state = state, _state(now)
        if state == before:
            break
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
