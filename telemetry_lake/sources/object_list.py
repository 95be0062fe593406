"""Which objects a folder holds, kept as a list that streams can follow.

Spark's file source keeps every file of a folder on the driver. Here the folder's parts are listed by tasks, and
what the list does not name yet is added to it as Parquet files of some names each. A stream follows these few files,
so nothing on the driver grows with the objects. A listing appears as a whole, as number n, and whoever creates a number first
has it; another that listed at the same moment looks again, so an object is named once.
"""

from __future__ import annotations

import itertools
import os
import uuid
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from telemetry_lake.sources.commits import _hadoop, exists, move_if_absent, remove

NAMES = "name string, partition int, modified long"
# Objects that a file of the list names at most.
FILE_NAMES = 20_000
# Tasks that list the folder's parts, and bytes that a task holds of the objects it opens.
LIST_TASKS = 1_000
HELD_BYTES = 1 << 23


def store_of(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path that all workers share, or of a URI that pyarrow knows, and the place in it."""
    return fs.FileSystem.from_uri(folder if ":" in folder.partition("/")[0] else f"file://{folder}")


def is_known(folder: str) -> bool:
    """Whether tasks can list and open the folder's objects themselves."""
    try:
        return bool(store_of(folder))
    except (OSError, ValueError):
        return False


def offset_of(name: Column) -> Column:
    return F.regexp_extract(name, r"offset=([0-9]+)", 1).try_cast("bigint")


def _listed(spark: SparkSession, folder: str) -> DataFrame:
    """The objects that hold something, hidden ones left out. Every folder below `folder` is listed by one task."""

    def hidden(name: str) -> bool:
        """As Spark's readers have it."""
        return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")

    store, root = store_of(folder)
    files, place = _hadoop(spark, folder)
    found = [(f.getPath().getName(), f.isDirectory()) for f in files.listStatus(place)]
    # An empty name stands for the files of the folder itself.
    below = [name for name, inner in found if inner and not hidden(name)] + [""] * any(not inner for _, inner in found)
    local, width = isinstance(store, fs.LocalFileSystem), 10_000

    def entries(part: str) -> Iterator[tuple[str, int, int]]:
        """Name, time in milliseconds and size; local folders are read entry by entry."""
        if not local:
            for info in store.get_file_info(fs.FileSelector(f"{root}/{part}".rstrip("/"), recursive=bool(part))):
                if info.is_file:
                    yield info.path.removeprefix(f"{root}/"), (info.mtime_ns or 0) // 1_000_000, info.size
            return
        with os.scandir(f"{root}/{part}") as there:
            for entry in there:
                name = f"{part}/{entry.name}" if part else entry.name
                if entry.is_dir():
                    if part and not hidden(entry.name):
                        yield from entries(name)
                else:
                    said = entry.stat()
                    yield name, said.st_mtime_ns // 1_000_000, said.st_size

    def partition_of(name: str) -> int | None:
        for piece in name.split("/")[:-1]:
            key, _, value = piece.partition("=")
            if key == "partition":
                return None if value == "__HIVE_DEFAULT_PARTITION__" else int(value)
        return None

    def names(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for number in part.column(0).to_pylist():
                seen = (e for e in entries(below[number]) if e[2] and not any(map(hidden, e[0].split("/"))))
                while some := list(itertools.islice(seen, width)):
                    columns = [[e[0] for e in some], [partition_of(e[0]) for e in some], [e[1] for e in some]]
                    kinds = (pa.string(), pa.int32(), pa.int64())
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["name", "partition", "modified"])

    count = len(below)
    return spark.range(0, count, 1, max(1, min(count, LIST_TASKS))).mapInArrow(names, NAMES)


def take_stock(spark: SparkSession, folder: str, listed: str, each: int, ordered: bool) -> bool:
    """Add the folder's objects that the list does not name yet, some to a file; says whether there were any.

    `ordered` puts the oldest objects first: files are read by their time, so they are given times in that order.
    """
    files, place = _hadoop(spark, listed)
    files.mkdirs(place)
    while True:
        numbers = [int(n.removeprefix("listing=")) for f in files.listStatus(place) if (n := f.getPath().getName()).startswith("listing=")]
        new = _listed(spark, folder)
        if numbers:
            known = spark.read.schema(NAMES).parquet(listed).select("name")
            new = new.join(known, "name", "left_anti").select("name", "partition", "modified")
        aside = f"{listed}/_attempts/{uuid.uuid4().hex}"
        # Where they are put in order, they are read several times.
        new.write.option("maxRecordsPerFile", each).parquet(f"{aside}/found")
        ready, found = f"{aside}/found", spark.read.schema(NAMES).parquet(f"{aside}/found")
        try:
            if found.isEmpty():
                return False
            if ordered:
                ready, order = f"{aside}/ordered", ["modified", "partition", offset_of(F.col("name")), "name"]
                found.repartitionByRange(*order).sortWithinPartitions(*order).write.option("maxRecordsPerFile", each).parquet(ready)
                last = f"{listed}/listing={max(numbers, default=0):010d}"
                _in_order(spark, ready, last if numbers else None)
            if move_if_absent(spark, ready, f"{listed}/listing={max(numbers, default=0) + 1:010d}"):
                return True
        finally:
            remove(spark, aside)


def _in_order(spark: SparkSession, written: str, before: str | None) -> None:
    """Give the files a task after the other has written times that ascend, later than those of the listing before."""

    def parts(folder: str) -> list:
        files, place = _hadoop(spark, folder)
        found = [(f.getPath().getName(), f) for f in files.listStatus(place)]
        return [f for name, f in sorted(found, key=lambda x: x[0]) if name.startswith("part-")]

    files, _ = _hadoop(spark, written)
    now = round(datetime.now(timezone.utc).timestamp() * 1000)
    start = max([now, *(f.getModificationTime() + 1 for f in (parts(before) if before else []))])
    for number, file in enumerate(parts(written)):
        files.setTimes(file.getPath(), start + number, -1)


class _Again(StreamingQueryListener):
    """Lists again when a query starts, so that it takes what is there then, and whenever it has nothing to do."""

    def __init__(self, look: Callable[[], object]) -> None:
        self.look, self.done = look, ""

    def _list(self) -> None:
        self.look()
        self.done = datetime.now(timezone.utc).isoformat()

    def onQueryStarted(self, event) -> None:
        self._list()

    def onQueryProgress(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        # Not for each of the events that came in while it listed.
        if event.timestamp > self.done:
            self._list()

    def onQueryTerminated(self, event) -> None:
        pass


def follow(spark: SparkSession, folder: str, max_files: int | None) -> DataFrame:
    """The names of a folder's objects as a stream, `max_files` a batch at most.

    Lists with the same bound share one list in the folder's `_listed`, which readers of the folder do not see.
    `spark` is a session for this stream alone: its queries are what the folder is listed again for.
    """
    each = min(max_files or FILE_NAMES, FILE_NAMES)
    listed = f"{folder.rstrip('/')}/_listed/{max_files or 'all'}"
    if not exists(spark, folder):
        raise FileNotFoundError(f"no folder of objects: {folder}")

    def look() -> bool:
        return take_stock(spark, folder, listed, each, ordered=max_files is not None)

    look()
    spark.streams.addListener(_Again(look))
    reader = spark.readStream.schema(NAMES)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max(1, max_files // each))
    return reader.parquet(f"{listed}/listing=*").select("name", "partition")


def opened(names: DataFrame, folder: str) -> DataFrame:
    """`name`, `partition` and `content` of the named objects. One that has gone since it was listed is left out."""
    store, root = store_of(folder)
    local, held = isinstance(store, fs.LocalFileSystem), HELD_BYTES

    def content(name: str) -> bytes | None:
        try:
            if local:
                with open(f"{root}/{name}", "rb") as file:
                    return file.read()
            with store.open_input_stream(f"{root}/{name}") as file:
                return file.read()
        except FileNotFoundError:
            if store.get_file_info(root).type == fs.FileType.NotFound:
                raise
            return None

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows, size = [], 0
            for name, partition in zip(*(column.to_pylist() for column in part.columns), strict=True):
                if (text := content(name)) is None:
                    continue
                rows.append((name, partition, text))
                size += len(text)
                if size >= held:
                    yield batch(rows)
                    rows, size = [], 0
            if rows:
                yield batch(rows)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.binary()), strict=True)
        return pa.record_batch([pa.array(list(c), t) for c, t in columns], ["name", "partition", "content"])

    return names.select("name", "partition").mapInArrow(read, "name string, partition int, content binary")
