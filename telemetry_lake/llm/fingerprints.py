"""Operator 1: document fingerprints by a threshold-scaled sketch.

A document's sketch is the set of its five-word shingle hashes below a fixed fraction of the hash
range. Which hashes are kept does not depend on the document, so sketches of any two documents
are comparable however unequal their sizes, the sketch of a union is the union of the sketches, and
the share of one sketch found in another estimates containment. So that no text with a word has an
empty sketch, the smallest hash is kept in any case: one above the threshold counts only while
the sketch has nothing else, and merging keeps to that.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telemetry_lake.llm.common import configure, partitions, table, texts
from telemetry_lake.llm.words import shingles, word_hashes

SHINGLE = 5
FRACTION = 1 / 8


def threshold(fraction: float = FRACTION) -> int:
    return min(2**64 - 1, int(fraction * 2**64))


def _held(hashes: np.ndarray, fraction: float) -> np.ndarray:
    """Of sorted distinct hashes those below the threshold, or else the smallest."""
    return hashes[: max(1, int(np.searchsorted(hashes, np.uint64(threshold(fraction)))))]


def sketch(text: str, size: int = SHINGLE, fraction: float = FRACTION) -> np.ndarray:
    """The kept hashes, distinct and sorted; a text without words has none."""
    return _held(np.unique(shingles(word_hashes(text), size)), fraction)


def merge(a: np.ndarray, b: np.ndarray, fraction: float = FRACTION) -> np.ndarray:
    """The sketch of two documents' shingles together."""
    return _held(np.union1d(a, b), fraction)


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity of the shingle sets; two empty sketches are alike."""
    shared = _shared(a, b)
    return shared / (len(a) + len(b) - shared) if len(a) + len(b) else 1.0


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of a's shingles found in b; an empty sketch is contained in anything."""
    return _shared(a, b) / len(a) if len(a) else 1.0


def as_text(hashes: np.ndarray) -> str:
    """16 hex digits for each hash, ascending."""
    return hashes.astype(">u8").tobytes().hex()


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u8").astype(np.uint64)


def fingerprints(docs: DataFrame, size: int = SHINGLE, fraction: float = FRACTION) -> DataFrame:
    """`doc_id`, `n_chars` (code points), `fingerprint` of every row of `doc_id`, `text`.

    A null text counts as empty, and empty gives an empty fingerprint. Repeated rows stay repeated,
    further columns are left out, an empty table gives no rows. Nothing is shuffled.
    """
    configure(docs.sparkSession)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            whole = list(texts(part.column(1)))
            found = [as_text(sketch(text, size, fraction)) for text in whole]
            columns = [part.column(0), pa.array([len(t) for t in whole], pa.int64()), pa.array(found, pa.string())]
            yield pa.record_batch(columns, ["doc_id", "n_chars", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(batches, "doc_id long, n_chars long, fingerprint string")


def _place(key: Column, bounds: list[int]) -> Column:
    """How many bounds are below the key, by a binary search in a literal array."""
    if not bounds:
        return F.lit(0)
    steps = [1 << k for k in reversed(range(max(1, len(bounds).bit_length())))]
    values = F.array(*[F.lit(b).cast("long") for b in bounds])

    def step(at: Column, width: Column) -> Column:
        inside = at + width <= len(bounds)
        # get() is zero-based and null beyond the end; the comparison is then not true.
        return F.when(inside & (F.get(values, at + width - 1) < key), at + width).otherwise(at)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step)


def in_turn(docs: DataFrame) -> tuple[DataFrame, int]:
    """The rows dealt by ranges of descending doc_id, each range with a copy of what follows it.

    Returns (`place`, `follower`, `doc_id`, `text`) and the number of places. Rows with place p hold
    one range of doc_ids, and as followers the rows with the greatest doc_id of the next lower
    range that has any; the last range is followed by the first.

    The bounds are quantiles of doc_id, as many as the session's shuffle partitions. What the driver
    sees are these bounds and the greatest doc_id of each range; both follow that setting, not the rows.
    """
    spark = docs.sparkSession
    key = F.coalesce("doc_id", F.lit(-(2**63)))
    n = 2 * partitions(spark)
    quantiles = [k / n for k in range(1, n)]
    low = docs.agg(F.percentile_approx(key, quantiles, 100 * n)).first()[0]
    bounds = sorted({*(low or [])})
    place = _place(key, bounds).alias("place")
    heads = {r.place: r.head for r in docs.groupBy(place).agg(F.max(key).alias("head")).collect()}
    used = sorted(heads)
    # The greatest doc_id of a range follows the next higher range; that of the highest, the lowest.
    follows = [(heads[p], used[k + 1] if k + 1 < len(used) else used[0]) for k, p in enumerate(used)]
    after = spark.createDataFrame(follows, "head long, place int")
    own = docs.select(place, F.lit(False).alias("follower"), "doc_id", "text")
    copies = docs.join(F.broadcast(after), key == F.col("head")).select("place", F.lit(True), "doc_id", "text")
    return own.union(copies), len(bounds) + 1


def edited_text(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many of the following text."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


EDITED = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, contained_in_edited double, contained_in_next double"
)


def compared_with_edits(docs: DataFrame, size: int = SHINGLE, fraction: float = FRACTION) -> DataFrame:
    """Every row's fingerprint beside that of its edited text and its likeness to the next row's.

    The next row is that with the next lower doc_id, the first follows the last. Null doc_ids come
    last; equal doc_ids follow one another in descending order of their texts. A null text counts as
    empty. A single row is its own next. An empty table gives no rows; further columns are left out.

    Texts are moved once, by ranges of doc_id, and sorted with spilling; of a range one document and
    its successor are held at a time.
    """
    configure(docs.sparkSession)
    rows, places = in_turn(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    order = [F.col("place"), F.col("follower"), F.col("doc_id").desc_nulls_last(), F.col("text").desc()]
    dealt = rows.repartition(places, "place").sortWithinPartitions(*order)

    def finish(batch: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 4]
        columns = list(zip(*batch, strict=True)) or [[]] * len(kinds)
        names = [field.split()[0] for field in EDITED.split(", ")]
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    def compare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for part in parts:
            batch = []
            for place, follower, doc_id, text in zip(*(c.to_pylist() for c in part.columns[:3]), texts(part.column(3)), strict=True):
                if follower and (before is None or before[0] != place or before[1]):
                    continue  # a further row of the same doc_id, or one whose range is done
                now = (place, follower, doc_id, text, sketch(text, size, fraction))
                if before and before[0] == place and not before[1]:
                    batch.append(_compared(before, now, size, fraction))
                before = now
            yield finish(batch)

    return dealt.mapInArrow(compare, EDITED)


def _compared(own: tuple, following: tuple, size: int, fraction: float) -> tuple:
    _, _, doc_id, text, kept = own
    edited = edited_text(text, following[3])
    other = sketch(edited, size, fraction)
    return (
        doc_id,
        len(text),
        hashlib.sha256(edited.encode()).hexdigest(),
        as_text(kept),
        as_text(other),
        likeness(kept, other),
        likeness(kept, following[4]),
        containment(kept, other),
        containment(kept, following[4]),
    )


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared_with_edits(table(spark, sf_dir, "documents", "doc_id", "text"))
