"""Operator 8: WARC archives with a two-level capture index.

Archives are WARC 1.1, one gzip member per record. Of records with equal payloads of REVISIT bytes and
more, the one with the smallest page_id is a response and the others are revisits, which hold the
headers only. The index:

    blocks     captures sorted by reversed-host URL key, BLOCK lines to a compressed block
    directory  per index file, the first key and the place of every block

A lookup compares its key with the first keys of the index files, searches that file's directory by
bisection, range-reads the blocks that can hold the key, and range-reads the records. All keys together
are dealt to the index files they fall into, so a block is read once.

The html moves once, to the task that writes its record. Files are written under a name of their
own attempt and renamed when they are whole, so repeated tasks do no harm.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telemetry_lake.llm.common import configure, file_store, partitions, stored, table
from telemetry_lake.session import scratch_dir

REVISIT = 100
BLOCK = 1000
# A new archive file is begun beyond so many compressed bytes.
ARCHIVE = 1 << 28
# Records that lie so close to one another are fetched by one range read of up to READ bytes.
GAP, READ = 1 << 16, 1 << 23
DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE = "key string, page_id long, file string, offset long, length long"


# ---------------------------------------------------------------- keys


def url_key(url: str | Column = "url") -> Column:
    """Reversed host, `)`, and the rest without its fragment: http://a.b.org/x?y becomes org,b,a)/x?y.

    Scheme, user, port 80 or 443 and letter case of the host do not matter. A URL without :// is its
    own key, null has the empty key.
    """
    url = F.col(url) if isinstance(url, str) else url
    place = F.regexp_extract(url, r"(?s)^[^/?#]*?://(?:[^/?#@]*@)?([^/?#]*)", 1)
    plain = F.regexp_replace(F.lower(place), r":(80|443)?$", "")
    rest = F.regexp_extract(url, r"(?s)^[^/?#]*?://[^/?#]*([^#]*)", 1)
    backwards = F.array_join(F.reverse(F.split(plain, r"\.")), ",")
    rest = F.when(rest == "", "/").otherwise(rest)
    return F.coalesce(F.when(url.contains("://"), F.concat(backwards, F.lit(")"), rest)).otherwise(url), F.lit(""))


# ---------------------------------------------------------------- records


def _line(value: str) -> str:
    """A header value without control characters."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit if it refers to another page."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    body = http.encode() + (payload if refers_to is None else b"")
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": _urn(page_id),
        "WARC-Date": DATE,
        "WARC-Payload-Digest": f"sha256:{digest}",
        "Content-Type": "application/http;msgtype=response",
        "Content-Length": str(len(body)),
    }
    if url is not None:
        head["WARC-Target-URI"] = _line(url)
    if refers_to is not None:
        head |= {"WARC-Profile": _PROFILE, "WARC-Refers-To": _urn(refers_to)}
    lines = "".join(f"{name}: {value}\r\n" for name, value in head.items())
    return b"WARC/1.1\r\n" + lines.encode("utf-8", "surrogatepass") + b"\r\n" + body + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member of its own, the same bytes for the same record."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


@dataclass(frozen=True)
class Record:
    page_id: int | None
    kind: str
    url: str | None
    digest: str
    payload_bytes: int
    payload: bytes | None
    refers_to: int | None


def _id(urn: str) -> int | None:
    value = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if value == "none" else int(value)


def parse(data: bytes) -> Record:
    """A record from its gzip member; a response's digest is checked against its payload."""
    raw = zlib.decompress(data, 31)
    top, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = top.decode("utf-8", "surrogatepass").split("\r\n")
    head = dict(line.split(": ", 1) for line in lines)
    if version != "WARC/1.1" or rest[int(head["Content-Length"]) :] != b"\r\n\r\n":
        raise ValueError(f"broken record {head.get('WARC-Record-ID')}")
    http, _, payload = rest[: int(head["Content-Length"])].partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    digest, kind = head["WARC-Payload-Digest"].removeprefix("sha256:"), head["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"payload of {head['WARC-Record-ID']} is not what its digest says")
    origin = head.get("WARC-Refers-To")
    return Record(
        _id(head["WARC-Record-ID"]),
        kind,
        head.get("WARC-Target-URI"),
        digest,
        size,
        payload if kind == "response" else None,
        _id(origin) if origin else None,
    )


# ---------------------------------------------------------------- writing


class _Draft:
    """A file that gets its name when it is whole."""

    def __init__(self, folder: str, name: str):
        self.store, base = file_store(folder)
        self.store.create_dir(base, recursive=True)
        self.name, self.size = name, 0
        self.final, self.draft = f"{base}/{name}", f"{base}/_{name}-{uuid.uuid4().hex}"
        self.out = self.store.open_output_stream(self.draft, compression=None)

    def write(self, data: bytes) -> tuple[int, int]:
        at = self.size
        self.out.write(data)
        self.size += len(data)
        return at, len(data)

    def close(self) -> None:
        self.out.close()
        self.store.move(self.draft, self.final)


def with_revisits(pages: DataFrame, least: int = REVISIT) -> DataFrame:
    """`page_id`, `url`, `payload`, `digest`, `refers_to` (the response's page_id, null for responses).

    Digests are grouped with map-side combine; copies of one payload are small rows until their
    page_id brings them together with their html, so the html of a group of copies is not in one task.
    Rows that repeat the smallest page_id are responses too; a null page_id is never the smallest
    unless there is no other, and then its records are all responses.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    long = rows.where(F.octet_length("payload") >= least).select("page_id", "digest")
    first = long.groupBy("digest").agg(F.min("page_id").alias("origin"), F.count("*").alias("n")).where("n > 1")
    later = (
        long.join(first.select("digest", "origin"), "digest")
        .where("origin IS NOT NULL AND NOT page_id <=> origin")
        .groupBy("page_id", "digest")
        .agg(F.first("origin").alias("refers_to"))
    )
    later = later.withColumnsRenamed({"page_id": "_page", "digest": "_digest"})
    same = F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest"))
    return rows.join(later, same, "left").drop("_page", "_digest")


def write_archives(pages: DataFrame, folder: str, least: int = REVISIT) -> DataFrame:
    """Write a record for every row of `page_id`, `url`, `html`; returns the captures, one row per record."""
    kind = dict(pages.dtypes)["page_id"]
    if kind != "bigint":
        raise ValueError(f"page_id must be bigint, not {kind}")

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, files, out = TaskContext.get().partitionId(), 0, None
        for part in parts:
            rows = []
            for key, *fields in zip(*part.columns, strict=True):
                if out is None or out.size >= ARCHIVE:
                    if out:
                        out.close()
                    out = _Draft(folder, f"part-{number:06d}-{files:04d}.warc.gz")
                    files += 1
                page_id, url, payload, digest, refers_to = (f.as_py() for f in fields)
                place = out.write(member(record(page_id, url, payload, digest, refers_to)))
                rows.append((key.as_py(), page_id, out.name, *place))
            yield _captures(rows)
        if out:
            out.close()

    found = with_revisits(pages, least).select(url_key().alias("key"), "page_id", "url", "payload", "digest", "refers_to")
    return stored(found.mapInArrow(write, CAPTURE), "captures")


def _captures(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
    columns = list(zip(*rows, strict=True)) or [[]] * 5
    names = ["key", "page_id", "file", "offset", "length"]
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


# ---------------------------------------------------------------- index


@dataclass(frozen=True)
class Index:
    """Folder of index files, and one row per file: file, first key, last key."""

    folder: str
    files: DataFrame


def _order(key: str) -> bytes:
    """Spark orders text by its UTF-8 bytes."""
    return key.encode("utf-8", "surrogatepass")


def build_index(captures: DataFrame, folder: str) -> Index:
    """Sort the captures into compressed blocks with a directory per file.

    The range partitioning is by key and page_id, so one URL with a large share of the captures
    is spread over files.
    """

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, lines, directory, last = None, [], [], ""
        for part in parts:
            for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                out = out or _Draft(folder, f"part-{TaskContext.get().partitionId():06d}.idx")
                lines.append(row)
                last = row[0]
                if len(lines) == BLOCK:
                    directory.append((lines[0][0], *out.write(zlib.compress(json.dumps(lines).encode()))))
                    lines = []
        if lines:
            directory.append((lines[0][0], *out.write(zlib.compress(json.dumps(lines).encode()))))
        if out:
            at, n = out.write(zlib.compress(json.dumps(directory).encode()))
            out.write(at.to_bytes(8, "little") + n.to_bytes(8, "little"))
            out.close()
            columns = [pa.array([v]) for v in (out.name, directory[0][0], last)]
            yield pa.record_batch(columns, ["file", "first", "last"])

    order = ["key", "page_id", "file", "offset"]
    rows = captures.repartitionByRange("key", "page_id").sortWithinPartitions(*order)
    return Index(folder, stored(rows.mapInArrow(write, "file string, first string, last string"), "index"))


class IndexFile:
    """The directory of one index file, and range reads of its blocks."""

    def __init__(self, folder: str, name: str):
        store, base = file_store(folder)
        self.file = store.open_input_file(f"{base}/{name}")
        size = self.file.size()
        tail = self.file.read_at(16, size - 16)
        at, n = int.from_bytes(tail[:8], "little"), int.from_bytes(tail[8:], "little")
        self.directory = json.loads(zlib.decompress(self.file.read_at(n, at)))
        self.firsts = [_order(first) for first, _, _ in self.directory]
        self.held: tuple[int, list] = (-1, [])

    def block(self, number: int) -> list[list]:
        if self.held[0] != number:
            _, at, n = self.directory[number]
            self.held = (number, json.loads(zlib.decompress(self.file.read_at(n, at))))
        return self.held[1]

    def find(self, key: str) -> Iterator[list]:
        """The captures of a key: bisection in the directory, then in each block that can hold it."""
        wanted = _order(key)
        # Captures of the key may begin in the block before the first one that starts with it.
        for number in range(max(0, bisect.bisect_left(self.firsts, wanted) - 1), len(self.firsts)):
            if self.firsts[number] > wanted:
                return
            lines = self.block(number)
            at = bisect.bisect_left(lines, wanted, key=lambda line: _order(line[0]))
            while at < len(lines) and lines[at][0] == key:
                yield lines[at]
                at += 1


def lookup(index: Index, keys: DataFrame) -> DataFrame:
    """The captures of every distinct `key`. Keys that are not in the index give no rows.

    The files' key ranges, one row per file, are known to every task; what a task loads is the
    directory of one file at a time and one block.
    """
    spark, folder = keys.sparkSession, index.folder
    configure(spark)
    ranges = sorted((_order(r.first), _order(r.last), r.file) for r in index.files.collect())
    firsts, lasts = [r[0] for r in ranges], [r[1] for r in ranges]

    def deal(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = []
            for key in part.column(0).to_pylist():
                wanted = _order(key)
                low, high = bisect.bisect_left(lasts, wanted), bisect.bisect_right(firsts, wanted)
                rows += [(key, name) for _, _, name in ranges[low:high]]
            columns = [pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)]
            yield pa.record_batch(columns, ["key", "file"])

    def find(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, opened = None, None
        for part in parts:
            rows = []
            for key, file in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if file != name:
                    name, opened = file, IndexFile(folder, file)
                for row in opened.find(key):
                    rows.append(row)
                    if len(rows) == 10 * BLOCK:
                        yield _captures(rows)
                        rows = []
            yield _captures(rows)

    dealt = keys.select(F.coalesce("key", F.lit("")).alias("key")).distinct().mapInArrow(deal, "key string, file string")
    # A number keeps Spark from merging tasks whose few rows stand for many reads.
    return dealt.repartition(partitions(spark), "file").sortWithinPartitions("file", "key").mapInArrow(find, CAPTURE)


# ---------------------------------------------------------------- reading

READ_BACK = (
    "page_id long, url string, record_type string, payload_bytes long, payload_digest string, "
    "refers_to long, payload binary"
)


def read_captures(captures: DataFrame, folder: str) -> DataFrame:
    """The records of the given captures, by range reads in the order of their archive files."""
    names = [field.split()[0] for field in READ_BACK.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def batch(found: list[Record]) -> pa.RecordBatch:
        rows = [(r.page_id, r.url, r.kind, r.payload_bytes, r.digest, r.refers_to, r.payload) for r in found]
        columns = list(zip(*rows, strict=True)) or [[]] * len(names)
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    def fetch(store: fs.FileSystem, base: str, run: list[tuple]) -> pa.RecordBatch:
        name, low, high = run[0][0], run[0][1], run[-1][1] + run[-1][2]
        with store.open_input_file(f"{base}/{name}") as file:
            data = file.read_at(high - low, low)
        return batch([parse(data[at - low : at - low + n]) for _, at, n in run])

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = file_store(folder)
        run: list[tuple] = []
        for part in parts:
            for name, at, n in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if run:
                    close = run[0][0] == name and at - run[-1][1] - run[-1][2] <= GAP
                    if not close or at + n - run[0][1] > READ:
                        yield fetch(store, base, run)
                        run = []
                run.append((name, at, n))
        if run:
            yield fetch(store, base, run)

    # Pieces of an archive file of READ bytes are dealt out, so a large file is read by many tasks.
    piece = F.floor(F.col("offset") / READ)
    dealt = captures.repartition(partitions(captures.sparkSession), "file", piece).sortWithinPartitions("file", "offset")
    return dealt.select("file", "offset", "length").mapInArrow(read, READ_BACK)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages, build the index, look up every URL of the table, and read what the index names."""
    configure(spark)
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    folder = scratch_dir(spark, "warc")
    index = build_index(write_archives(pages, f"{folder}/archives"), f"{folder}/index")
    captures = lookup(index, pages.select(url_key().alias("key")))
    records = read_captures(captures, f"{folder}/archives")
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
WITH rows AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
digests AS (SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes,
                   sha256(payload) AS payload_digest FROM rows),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS origin FROM digests)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> origin THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> origin THEN origin END AS refers_to
FROM firsts"""
