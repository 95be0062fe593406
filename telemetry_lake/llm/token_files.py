"""Operator 3: token ids in files of fixed-width packed bits.

A file holds the documents of one range of doc_ids in ascending order:

    magic "TKP1"
    blocks: BLOCK ids each (the last one may be shorter), every id in the vocabulary's least
            number of bits, least significant bit first; BLOCK is a multiple of eight, so every
            block but the last starts and ends on a byte
    document table: doc_id, first id, number of ids (three rows of 64-bit integers), one byte each
            for a null doc_id
    block offsets: 64-bit integers, one more than blocks
    footer: JSON with bits, block, ids, documents and the places of the two tables; its length in
            eight bytes; magic

Any run of ids is read by a range read of its blocks and unpacked with numpy alone. A file is
written under a name of its own attempt and then renamed, so a repeated or speculative task
replaces a file by the same file. The number of ids in a file is only known when it is written;
where its first id stands among all ids follows from the manifest, one row per file.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from telemetry_lake.llm import tokens
from telemetry_lake.llm.common import configure, file_store, partitions, table
from telemetry_lake.session import scratch_dir

MAGIC = b"TKP1"
BLOCK = 4096
# Ids unpacked at a time when a file is read through.
READ = 256 * BLOCK


def bits_for(size: int) -> int:
    """The least bits that hold 0 to size - 1."""
    return max(1, (size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Each id in `bits` bits, least significant first; the last byte is filled with zeros."""
    if bits == 16:
        return ids.astype("<u2").tobytes()
    spread = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(spread[:, :bits].ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    """The first n ids of packed bytes, as unsigned 32-bit integers."""
    if bits == 16:
        return np.frombuffer(data, "<u2", n).astype("<u4")
    spread = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, :bits] = spread
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()


class Writer:
    """Streams documents into one file; holds one block and the document table."""

    def __init__(self, folder: str, name: str, bits: int):
        self.store, base = file_store(folder)
        self.store.create_dir(base, recursive=True)
        self.final, self.draft = f"{base}/{name}", f"{base}/_{name}-{uuid.uuid4().hex}"
        self.out, self.bits = self.store.open_output_stream(self.draft), bits
        self.rest, self.written, self.docs, self.ids = [], 0, [], 0
        self.held = 0
        self._write(MAGIC)
        self.offsets = [self.written]

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.written += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, self.ids, len(ids)))
        self.ids += len(ids)
        self.rest.append(ids)
        self.held += len(ids)
        if self.held >= 16 * BLOCK:
            self._flush(self.held // BLOCK * BLOCK)

    def _flush(self, n: int) -> None:
        held = np.concatenate(self.rest) if self.rest else np.zeros(0, np.uint32)
        for at in range(0, n, BLOCK):
            self._write(pack(held[at : min(n, at + BLOCK)], self.bits))
            self.offsets.append(self.written)
        self.rest, self.held = [held[n:]], len(held) - n

    def close(self) -> dict:
        self._flush(self.held)
        at_docs = self.written
        columns = np.array([[d or 0, a, n] for d, a, n in self.docs], "<i8").reshape(-1, 3)
        self._write(np.ascontiguousarray(columns.T).tobytes())
        self._write(bytes(d is None for d, _, _ in self.docs))
        at_blocks = self.written
        self._write(np.array(self.offsets, "<i8").tobytes())
        about = {"bits": self.bits, "block": BLOCK, "ids": self.ids, "documents": len(self.docs)}
        footer = json.dumps(about | {"at_docs": at_docs, "at_blocks": at_blocks}).encode()
        self._write(footer + len(footer).to_bytes(8, "little") + MAGIC)
        self.out.close()
        self.store.move(self.draft, self.final)
        return about


class Reader:
    """Random access to the ids of one file."""

    def __init__(self, folder: str, name: str):
        store, base = file_store(folder)
        self.file = store.open_input_file(f"{base}/{name}")
        size = self.file.size()
        tail = self._at(size - 12, 12)
        if tail[8:] != MAGIC:
            raise ValueError(f"{name} is not a token file or was cut short")
        length = int.from_bytes(tail[:8], "little")
        about = json.loads(self._at(size - 12 - length, length))
        self.bits, self.block, self.ids, n = (about[k] for k in ("bits", "block", "ids", "documents"))
        blocks = -(-self.ids // self.block)
        self.offsets = np.frombuffer(self._at(about["at_blocks"], 8 * (blocks + 1)), "<i8")
        self.doc_ids, self.starts, self.lengths = np.frombuffer(self._at(about["at_docs"], 24 * n), "<i8").reshape(3, n)
        self.null = np.frombuffer(self._at(about["at_docs"] + 24 * n, n), bool)

    def _at(self, place: int, n: int) -> bytes:
        return self.file.read_at(n, place) if n else b""

    def read(self, start: int, n: int) -> np.ndarray:
        """n ids from the given place on, by one range read of the blocks that hold them."""
        if n <= 0:
            return np.zeros(0, "<u4")
        first, last = start // self.block, (start + n - 1) // self.block + 1
        data = self._at(int(self.offsets[first]), int(self.offsets[last] - self.offsets[first]))
        held = min(self.ids, last * self.block) - first * self.block
        return unpack(data, self.bits, held)[start - first * self.block :][:n]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """doc_id, place in the file and ids of every document; holds READ ids, or one long document."""
        low, held = 0, np.zeros(0, "<u4")
        for doc_id, null, start, n in zip(self.doc_ids.tolist(), self.null, self.starts.tolist(), self.lengths.tolist(), strict=True):
            if start + n > low + len(held):
                low, held = start, self.read(start, min(self.ids - start, max(n, READ)))
            yield None if null else doc_id, start, held[start - low : start - low + n]


@dataclass(frozen=True)
class TokenFiles:
    """A folder of token files, and one row per file: part, name, documents, ids, base (ids before it)."""

    folder: str
    manifest: DataFrame


def write(docs: DataFrame, folder: str, vocabulary: str = tokens.VOCABULARY) -> TokenFiles:
    """Encode every row of `doc_id`, `text` and write the ids in ascending doc_id order.

    Null doc_ids come first; rows with equal doc_ids are in the order of their texts. A null or
    empty text is the end id alone. An empty table gives no file. Further columns are left out.

    The texts are dealt by ranges of doc_id, which moves them once; a range is sorted with spilling
    and streamed into its file.
    """
    spark = docs.sparkSession
    configure(spark)
    bits = bits_for(max(tokens.vocabulary_size(vocabulary), tokens.END_ID + 1))

    def write_part(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        name, writer = f"part-{number:06d}.tkp", None
        for doc_ids, encoded in tokens.encoded(parts, vocabulary):
            for doc_id, ids in zip(doc_ids, encoded, strict=True):
                writer = writer or Writer(folder, name, bits)
                writer.add(doc_id.as_py(), np.frombuffer(ids, "<u4"))
        if writer:
            about = writer.close()
            columns = [[number], [name], [about["documents"]], [about["ids"]]]
            yield pa.record_batch([pa.array(c) for c in columns], ["part", "name", "documents", "ids"])

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows = ordered.mapInArrow(write_part, "part long, name string, documents long, ids long")
    rows.write.parquet(f"{folder}/_manifest")
    # One small row per file: the running sum over the files is over as many rows as tasks wrote.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    manifest = spark.read.parquet(f"{folder}/_manifest")
    return TokenFiles(folder, manifest.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0).cast("long"))))


def read(files: TokenFiles) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids (little-endian unsigned 32-bit), from the files."""
    folder = files.folder

    def read_part(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for name, base in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                rows, held = [], 0
                for doc_id, start, ids in Reader(folder, name).documents():
                    rows.append((doc_id, base + start, ids.tobytes()))
                    held += len(ids)
                    if held >= READ:
                        yield _batch(rows)
                        rows, held = [], 0
                yield _batch(rows)

    # The rows are few and small, the files they name are not: a number keeps Spark from merging the tasks.
    names = files.manifest.select("name", "base").repartition(partitions(files.manifest.sparkSession), "name")
    return names.mapInArrow(read_part, "doc_id long, start long, ids binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[], [], []]
    kinds = (pa.int64(), pa.int64(), pa.binary())
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "start", "ids"])


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    found = read(write(docs, scratch_dir(spark, "tokens")))
    return found.select(
        "doc_id",
        "start",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )
