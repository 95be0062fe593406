"""Operator 2: near duplicates by SimHash, compared exactly tile against tile.

Fingerprints are 64 bits of word shingles. Distinct fingerprints are laid out in tiles by the
population counts of their four 16-bit quarters. Two fingerprints differ in at least as many
bits as the counts of their quarters differ in sum, so only pairs of tiles within the radius are
compared; what remains is compared whole with numpy's exclusive-or and bit count. Nothing is
missed, whatever the data.

Cost: text is read once and not shuffled. The comparison grows with the square of the number of
distinct fingerprints, times the share of tile pairs within the radius (some 5 % for
random fingerprints). Exact copies are one fingerprint. From a pair of tiles only the edges of a
spanning forest are sent on, so a group of near copies costs rows in proportion to its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telemetry_lake.llm.common import configure, hex_digits, long_lists, stored, table, texts
from telemetry_lake.llm.components import connected_components

SHINGLE = 3
RADIUS = 3
SEED = 42
TILE = 1024
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_hashes(text: str, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of every shingle, repeats included, in the order of the text."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    size = min(size, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    return np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)


def fingerprint_of(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in over half of the hashes."""
    columns = np.ascontiguousarray(hashes.astype("<u8")).view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(columns[:, k], minlength=256) @ _BITS for k in range(8)])
    bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """`doc_id`, `fp` (long) for every row; null text counts as empty, and empty gives zero."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = [fingerprint_of(shingle_hashes(text, size)) for text in texts(part.column(1))]
            yield pa.record_batch([part.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(batches, "doc_id long, fp long")


def _cell(column: Column) -> Column:
    """The population counts of the four quarters, five bits for each, with room below and above."""
    quarters = [F.bit_count(F.shiftrightunsigned(column, 16 * k).bitwiseAND(F.lit(0xFFFF))) for k in range(4)]
    return sum((q.cast("long") + 4) * 32**k for k, q in enumerate(quarters))


def _offsets(radius: int) -> list[int]:
    """One of each two opposite steps between cells whose counts differ by the radius or less in sum."""
    steps = np.stack(np.meshgrid(*[np.arange(-radius, radius + 1)] * 4, indexing="ij"), -1).reshape(-1, 4)
    steps = steps[np.abs(steps).sum(axis=1) <= radius]
    codes = steps @ 32 ** np.arange(4)
    return sorted(int(c) for c in codes if c >= 0)


def forest(hit: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its component) for the links hit[i, j] of left[i] and right[j]."""
    rows, columns = np.flatnonzero(hit.any(axis=1)), np.flatnonzero(hit.any(axis=0))
    hit, left, right = hit[np.ix_(rows, columns)], left[rows], right[columns]
    far = np.iinfo(np.int64).max
    low_left, low_right = left, right
    while True:
        new_left = np.minimum(low_left, np.where(hit, low_right[None, :], far).min(axis=1, initial=far))
        new_right = np.minimum(low_right, np.where(hit, new_left[:, None], far).min(axis=0, initial=far))
        if (new_left == low_left).all() and (new_right == low_right).all():
            break
        low_left, low_right = new_left, new_right
    nodes, lows = np.concatenate((left, right)), np.concatenate((low_left, low_right))
    return nodes[nodes != lows], lows[nodes != lows]


def links(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """A spanning set of links `a`, `b` between the representatives of `fp`, `rep` (one row per fingerprint)."""
    if not 0 <= radius <= 3:
        raise ValueError("the cells have room for a radius of 0 to 3")
    # At most 17**4 cells of two numbers each, whatever the input: that bounds both broadcasts.
    sized = classes.withColumn("cell", _cell(F.col("fp")))
    cells = sized.groupBy("cell").agg(F.ceil(F.count("*") / TILE).alias("tiles"))
    tile = F.pmod(F.xxhash64("fp"), F.col("tiles"))
    tiles = stored(
        sized.join(F.broadcast(cells), "cell")
        .groupBy("cell", tile.alias("tile"))
        .agg(F.collect_list(F.struct("fp", "rep")).alias("rows"))
        .select("cell", "tile", F.col("rows.fp").alias("fps"), F.col("rows.rep").alias("reps")),
        "tiles",
    )
    other = cells.select(F.col("cell").alias("near"), F.col("tiles").alias("near_tiles"))
    steps = F.array(*[F.lit(code).cast("long") for code in _offsets(radius)])
    pairs = (
        tiles.withColumn("step", F.explode(steps))
        .withColumn("near", F.col("cell") + F.col("step"))
        .join(F.broadcast(other), "near")
        .withColumn("near_tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("near_tiles") - 1)))
        .where("step <> 0 OR near_tile >= tile")
        .select("near", "near_tile", "fps", "reps")
        .join(
            tiles.select(
                F.col("cell").alias("near"),
                F.col("tile").alias("near_tile"),
                F.col("fps").alias("near_fps"),
                F.col("reps").alias("near_reps"),
            ),
            ["near", "near_tile"],
        )
        .select("fps", "reps", "near_fps", "near_reps")
    )

    def compare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for fps, reps, near_fps, near_reps in zip(*map(long_lists, part.columns), strict=True):
                differing = fps.view(np.uint64)[:, None] ^ near_fps.view(np.uint64)[None, :]
                hit = np.bitwise_count(differing) <= radius
                hit &= reps[:, None] != near_reps[None, :]
                if hit.any():
                    nodes, lows = forest(hit, reps, near_reps)
                    a.append(nodes)
                    b.append(lows)
            yield pa.record_batch([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return pairs.mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """`doc_id`, `fp`, `component_id` for every row of `doc_id`, `text` (further columns are left out).

    component_id is the smallest doc_id reachable over fingerprints that differ in `radius` bits or
    less. Null and empty texts have fingerprint zero and are linked like any other. Repeated rows
    stay repeated. A null doc_id is never a component's id; its row has the component of its
    fingerprint, null if no other doc_id has that fingerprint. An empty table gives no rows.
    """
    configure(docs.sparkSession)
    rows = stored(fingerprints(docs, size), "fingerprints")
    classes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")).where("rep IS NOT NULL"), "classes")
    found = connected_components(links(classes, radius)).withColumnRenamed("node", "rep")
    named = classes.join(found, "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return rows.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", hex_digits("fp").alias("fingerprint"), "component_id")
