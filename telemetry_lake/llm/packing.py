"""Operator 9: sequences by power-of-two decomposition, none of which crosses documents.

A document of n tokens is cut into pieces whose lengths are the binary digits of n, with as many
pieces of the greatest length as fit, longest first. Every piece is a sequence of its own, its
length is a power of two, and equal lengths form a bucket, so no token of padding is needed and a
batch drawn from one bucket is rectangular.

A document's pieces depend on nothing but the document: one pass over the texts, no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemetry_lake.llm import tokens
from telemetry_lake.llm.common import configure, table

LENGTH = 4096
# Documents of one batch of pieces; their ids' bytes stay far below 2 GB.
DOCUMENTS = 200
PIECES = "doc_id long, start long, length long, doc_tokens long, bucket int, ids binary"


def piece_lengths(n: int, longest: int = LENGTH) -> list[int]:
    """n as a sum of powers of two up to `longest`, the greatest first."""
    return [longest] * (n // longest) + [1 << k for k in reversed(range(longest.bit_length() - 1)) if n % longest >> k & 1]


def _cut(doc_ids: pa.Array, encoded: list[bytes], longest: int) -> pa.RecordBatch:
    """The pieces of some documents, whose ids are given as bytes, one document after another."""
    sizes = np.array([len(ids) // 4 for ids in encoded], np.int64)
    cut = [piece_lengths(n, longest) for n in sizes.tolist()]
    counts = np.array([len(lengths) for lengths in cut], np.int64)
    lengths = np.array([n for some in cut for n in some], np.int64)
    # Pieces follow one another, so their ends are those of the ids put together.
    ends = np.concatenate([[0], np.cumsum(lengths)])
    of = np.repeat(np.arange(len(sizes)), counts)
    columns = [
        doc_ids.cast(pa.int64()).take(pa.array(of)),
        pa.array(ends[:-1] - (np.cumsum(sizes) - sizes)[of]),
        pa.array(lengths),
        pa.array(sizes[of]),
        pa.array(np.log2(lengths).astype(np.int32)),
        pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer((4 * ends).astype(np.int32)), pa.py_buffer(b"".join(encoded))]),
    ]
    return pa.record_batch(columns, ["doc_id", "start", "length", "doc_tokens", "bucket", "ids"])


def pieces(docs: DataFrame, longest: int = LENGTH, vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    """The sequences of every row of `doc_id`, `text` (further columns are left out).

    Per sequence: doc_id, start (ids of the document before it), length, doc_tokens (ids of the
    document with its end id), bucket (binary logarithm of the length), ids (little-endian
    unsigned 32-bit), sequence_id. A null or empty text is the end id alone. Repeated rows, and
    rows with a null doc_id, are packed one by one. An empty table gives no rows.

    sequence_id is unique and depends on where a row lies in the input files only.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest sequence must be a power of two")
    configure(docs.sparkSession)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Some hundred documents' pieces to a batch."""
        try:
            for doc_ids, encoded in tokens.encoded(parts, vocabulary):
                for at in range(0, len(encoded), DOCUMENTS):
                    yield _cut(doc_ids.slice(at, DOCUMENTS), encoded[at : at + DOCUMENTS], longest)
        finally:
            tokens.forget(vocabulary)

    found = docs.select("doc_id", "text").mapInArrow(batches, PIECES)
    return found.withColumn("sequence_id", F.monotonically_increasing_id())


def write_buckets(found: DataFrame, path: str) -> None:
    """One folder per length, to draw batches of equal lengths from."""
    found.write.partitionBy("bucket").parquet(path)


def digest(found: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids; a piece starts its sequence."""
    return found.select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        F.lit(0).cast("long").alias("offset"),
        "bucket",
    )


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pieces(table(spark, sf_dir, "documents", "doc_id", "text")))
