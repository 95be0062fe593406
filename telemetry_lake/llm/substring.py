"""Operator 4: substring deduplication by paragraph MinHash banding.

Paragraphs are the lines of a text, and runs of WORDS words that begin at places chosen by the text
itself (the least hash among GAP neighbours), so that a passage pasted into the middle of a line
is compared as a paragraph of its own: any passage of WORDS + GAP - 1 words that two documents share
contains a run chosen in both. Shared runs are seeds: all runs that begin less than GAP words from one are
compared as well, so that such a passage is cut up to its real ends. Lines are banded by MinHash of their five-word shingles, colliding lines
are verified by exact Jaccard similarity, and lines are clustered by the components of what was
verified; runs cluster by equality. Of each cluster the members in the document with the smallest doc_id
stay, and every other member's place is cut from its text.

What is shuffled are hashes and places. The candidates among them are found with bitmaps of
a fixed size, which let rows through by mistake but never keep one back, and exact joins follow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telemetry_lake.llm.common import configure, long_lists, stored, table
from telemetry_lake.llm.components import connected_components
from telemetry_lake.llm.simhash import forest
from telemetry_lake.llm.words import mix, run_hashes, shingles, span_hashes, word_spans

WORDS = 20
GAP = 14
SHINGLE = 5
SIMILARITY = 0.8
RECALL = 0.99
TILE = 256
# Bytes of short texts that a task hashes together, so that numpy's calls are few and their arrays stay in the cache.
TOGETHER = 1 << 18
# Runs that a task hands on at once.
HELD = 1 << 17
# Bits of a bitmap: 2**18 rows of 64 bits where it is a table, 2 MB where it is an array.
BITMAP = 1 << 24


def tuned_bands(similarity: float = SIMILARITY, recall: float = RECALL, most: int = 8) -> tuple[int, int]:
    """Bands and rows with the most rows for which a pair at the similarity collides with the recall or more."""
    options = []
    for rows in range(1, 9):
        for bands in range(1, most + 1):
            if 1 - (1 - similarity**rows) ** bands >= recall:
                options.append((rows, -bands))
                break
    rows, bands = max(options)
    return -bands, rows


BANDS, ROWS = tuned_bands()
_SEEDS = np.random.default_rng(11).integers(0, 2**64, (2, BANDS * ROWS, 1), np.uint64)


class Document:
    """Words and paragraphs of one text, or of several one after another, by byte."""

    def __init__(self, *texts: bytes):
        # A line end between two texts: no word and no line spans them.
        self.data = np.frombuffer(b"\n".join(texts), np.uint8)
        self.offsets = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
        self.starts, self.ends = word_spans(self.data)
        self.words = span_hashes(self.data, self.starts, self.ends)
        # The first word of each text.
        self.begins = np.searchsorted(self.starts, self.offsets)
        breaks = np.flatnonzero(self.data == ord("\n"))
        cuts = np.concatenate(([0], np.searchsorted(self.starts, breaks), [len(self.words)]))
        long = np.diff(cuts) >= WORDS
        self.first, self.last = cuts[:-1][long], cuts[1:][long]
        # The hash of SHINGLE words from each word on; a line's are those that end within it.
        self.grams = shingles(self.words, SHINGLE)

    def line_keys(self) -> np.ndarray:
        """A hash of all words of each long line."""
        return run_hashes(self.words, self.first, self.last)

    def line_grams(self, k: int) -> np.ndarray:
        return np.unique(self.grams[self.first[k] : self.last[k] - SHINGLE + 1])

    def bands(self) -> np.ndarray:
        """BANDS hashes for each long line."""
        if not len(self.first):
            return np.zeros((0, BANDS), np.uint64)
        least = np.empty((BANDS * ROWS, len(self.first)), np.uint64)
        edges = np.stack((self.first, self.last - SHINGLE + 1), 1).ravel()
        padded = np.concatenate((self.grams, np.zeros(1, np.uint64)))
        for k, (factor, term) in enumerate(zip(*_SEEDS, strict=True)):
            least[k] = np.minimum.reduceat(padded * (factor | np.uint64(1)) + term, edges)[::2]
        total = np.arange(BANDS, dtype=np.uint64)[:, None] + np.zeros_like(least[:BANDS])
        for row in range(ROWS):
            total = mix(total * np.uint64(31) + least[row::ROWS])
        return total.T

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """First words and hashes of the chosen runs of WORDS words; a text's first and last run are chosen."""
        if len(self.words) < WORDS:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        hashes = shingles(self.words, WORDS)
        # Each text's first run and the one behind its last.
        first, stop = self.begins, np.append(self.begins[1:], len(self.words)) - WORDS + 1
        first, stop = first[stop > first], stop[stop > first]
        chosen = np.zeros(len(hashes), bool)
        chosen[first] = chosen[stop - 1] = True
        long = stop - first >= GAP
        least = leftmost_least(hashes, GAP)
        inside = np.zeros(len(least) + 1, np.int64)
        np.add.at(inside, first[long], 1)
        np.add.at(inside, stop[long] - GAP + 1, -1)
        chosen[least[np.cumsum(inside)[:-1] > 0]] = True
        for a, b in zip(first[~long].tolist(), stop[~long].tolist(), strict=True):
            chosen[a + hashes[a:b].argmin()] = True
        # A word said over and over makes one run, not one at every word.
        new = np.append(True, hashes[1:] != hashes[:-1])
        new[first] = True
        at = np.flatnonzero(chosen & new)
        return at, hashes[at]

    def around(self, seeds: np.ndarray, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hashes, first and last words of the runs less than GAP from a seed, and which may be cut but are not yet.

        `seeds` are first words of shared runs, `repeated` those that an earlier document has. Equal
        runs one after the other (a word said over and over) are one place from the first to the last. May be cut
        but are not yet: places near a repeated seed that do not lie between two repeated seeds that meet.
        """
        hashes = shingles(self.words, WORDS)
        first = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
        last = np.concatenate((first[1:], [len(hashes)])) - 1
        near, wanted = np.zeros(len(first) + 1, np.int64), np.zeros(len(first) + 1, np.int64)
        for marks, at in ((near, seeds), (wanted, repeated)):
            place = np.searchsorted(first, at, "right") - 1
            np.add.at(marks, np.maximum(place - GAP + 1, 0), 1)
            np.add.at(marks, np.minimum(place + GAP, len(first)), -1)
        near, wanted = (np.cumsum(marks)[:-1] > 0 for marks in (near, wanted))
        if len(repeated):
            at = np.sort(repeated)
            following = np.searchsorted(at, first)
            before = at[np.maximum(np.searchsorted(at, first, "right") - 1, 0)]
            after = at[np.minimum(following, len(at) - 1)]
            wanted &= ~((before <= first) & (first <= after) & (after - before <= WORDS) & (first == last))
        return hashes[first[near]], first[near], last[near] + WORDS - 1, wanted[near]


def leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the least value, the leftmost of equal ones, in every stretch of `width` values."""
    at, reach = np.arange(len(values)), 1
    while reach < width and len(at):
        step = min(reach, width - reach)
        left, right = at[: max(len(at) - step, 0)], at[step:]
        at, reach = np.where(values[right] < values[left], right, left), reach + step
    return at


def _together(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """The column's texts in groups of up to TOGETHER bytes, a longer one by itself, and each group's first row."""
    group: list[bytes] = []
    size = first = 0
    for k, value in enumerate(column):
        text = value.as_py() or b""
        if group and size + len(text) > TOGETHER:
            yield first, group
            group, size, first = [], 0, k
        group.append(text)
        size += len(text) + 1
    if group:
        yield first, group


UNITS = "run boolean, key long, doc_id long, row long, start int, stop int, bands array<long>"


def _source(docs: DataFrame) -> DataFrame:
    """doc_id, a hash that tells rows with equal doc_ids apart, and the text's bytes."""
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), F.encode("text", "UTF-8").alias("text"))


def units(docs: DataFrame) -> DataFrame:
    """Every paragraph's key and place in bytes; lines have bands, runs have none."""

    def find(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            columns: list[list[np.ndarray]] = [[np.zeros(0, t)] for t in (bool, np.int64, np.int64, np.int64, np.int32, np.int32)]
            bands, widths = [np.zeros(0, np.int64)], [np.zeros(1, np.int64)]
            missing = [np.zeros(0, bool)]
            doc_ids = part.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            unknown = part.column(0).is_null().to_numpy(zero_copy_only=False)
            rows = part.column(1).to_numpy(zero_copy_only=False)
            for base, texts in _together(part.column(2)):
                doc = Document(*texts)
                at, hashes = doc.runs()
                n, m = len(doc.first), len(at)
                if not n + m:
                    continue
                keys = np.concatenate((doc.line_keys(), hashes)).view(np.int64)
                heads = np.concatenate((doc.first, at))
                owner = np.searchsorted(doc.begins, heads, "right") - 1
                starts = doc.starts[heads] - doc.offsets[owner]
                stops = doc.ends[np.concatenate((doc.last, at + WORDS)) - 1] - doc.offsets[owner]
                owner += base
                fresh = (np.arange(n + m) >= n, keys, doc_ids[owner], rows[owner], starts, stops)
                for held, new in zip(columns, fresh, strict=True):
                    held.append(new)
                missing.append(unknown[owner])
                bands.append(doc.bands().view(np.int64).ravel())
                widths += [np.full(n, BANDS), np.zeros(m, np.int64)]
            run, key, doc_id, row, start, stop = map(np.concatenate, columns)
            places = np.cumsum(np.concatenate(widths)).astype(np.int32)
            banded = pa.ListArray.from_arrays(pa.array(places), pa.array(np.concatenate(bands)))
            arrays = [pa.array(run), pa.array(key), pa.array(doc_id, mask=np.concatenate(missing)), pa.array(row)]
            arrays += [pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32)), banded]
            yield pa.record_batch(arrays, [f.split()[0] for f in UNITS.split(", ")])

    return _source(docs).mapInArrow(find, UNITS)


# ---------------------------------------------------------------- bitmaps


def _slot(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BITMAP))


def bitmap(keys: DataFrame, key: str) -> DataFrame:
    """`word`, `bits`: at most BITMAP / 64 rows, whatever the number of keys."""
    slot = _slot(key)
    bit = F.expr("shiftleft(1L, cast(slot % 64 AS int))")
    return keys.select(slot.alias("slot")).groupBy(F.floor(F.col("slot") / 64).alias("word")).agg(F.bit_or(bit).alias("bits"))


def perhaps_in(rows: DataFrame, bits: DataFrame, key: str) -> DataFrame:
    """The rows whose key may be among those of the bitmap: all that are, and a few that are not."""
    held = rows.withColumn("_slot", _slot(key)).withColumn("word", F.floor(F.col("_slot") / 64))
    hit = F.expr("(shiftrightunsigned(bits, cast(_slot % 64 AS int)) & 1L) = 1")
    return held.join(F.broadcast(bits), "word").where(hit).select(rows.columns)


# ---------------------------------------------------------------- lines


def _members(lines: DataFrame) -> DataFrame:
    """`band`, `key`: the bands in which different lines collide, one band of those with the same lines."""
    banded = lines.select("key", F.explode("bands").alias("band"))
    sizes = banded.groupBy("band").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low <> high")
    shared = stored(sizes.select("band"), "bands")
    some = perhaps_in(banded, bitmap(shared, "band"), "band").join(shared, "band").distinct()
    members = stored(some, "members")
    same = members.groupBy("band").agg(
        F.count("*").alias("n"),
        F.min("key").alias("low"),
        F.max("key").alias("high"),
        F.sum(F.xxhash64("key").cast("decimal(20,0)")).alias("total"),
    )
    chosen = same.groupBy("n", "low", "high", "total").agg(F.min("band").alias("band"))
    return members.join(chosen.select("band", "n"), "band")


def _line_shingles(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """`key`, `grams` (distinct, sorted) of the lines with the given distinct keys, by a second pass over the texts."""
    found = bitmap(keys, "key").toArrow()
    bits = np.zeros(BITMAP // 64, np.uint64)
    bits[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    slots = docs.sparkSession.sparkContext.broadcast(bits)

    def find(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            lines: dict[int, np.ndarray] = {}
            for _, texts in _together(part.column(0)):
                doc = Document(*texts)
                keys = doc.line_keys()
                at = _spark_hash(keys.view(np.int64)) % BITMAP
                hit = slots.value[at // 64] >> (at % 64).astype(np.uint64) & np.uint64(1)
                for k in np.flatnonzero(hit):
                    if (key := int(keys[k].view(np.int64))) not in lines:
                        lines[key] = doc.line_grams(k).view(np.int64)
            ends = np.cumsum([0, *map(len, lines.values())]).astype(np.int32)
            grams = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *lines.values()])))
            yield pa.record_batch([pa.array(list(lines), pa.int64()), grams], ["key", "grams"])

    rows = docs.select(F.encode("text", "UTF-8").alias("text")).mapInArrow(find, "key long, grams array<long>")
    return rows.join(keys, "key").groupBy("key").agg(F.first("grams").alias("grams"))


def _spark_hash(values: np.ndarray) -> np.ndarray:
    """xxhash64 of 64-bit integers as Spark computes it with its seed of 42."""
    # The primes of XXH64.
    p1, p2, p3 = np.uint64(0x9E3779B185EBCA87), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
    p4, p5 = np.uint64(0x85EBCA77C2B2AE63), np.uint64(0x27D4EB2F165667C5)

    def turn(x: np.ndarray, n: int) -> np.ndarray:
        return (x << np.uint64(n)) | (x >> np.uint64(64 - n))

    h = np.full(len(values), 42 + 8, np.uint64) + p5
    h = turn(h ^ (turn(values.view(np.uint64) * p2, 31) * p1), 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def jaccard_hits(left: list[np.ndarray], right: list[np.ndarray], similarity: float) -> np.ndarray:
    """hit[i, j]: the sets left[i] and right[j] have the similarity or more. Exact; in blocks of columns."""
    owners = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    _, column = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    order = np.argsort(column, kind="stable")
    owners, column = owners[order], column[order]
    shared = np.zeros((len(left), len(right)), np.float32)
    width = 8192
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [low, low + width])
        block = np.zeros((len(left) + len(right), width), np.float32)
        block[owners[a:b], column[a:b] - low] = 1
        shared += block[: len(left)] @ block[len(left) :].T
    sizes = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right])[None, :]
    return shared >= similarity * (sizes - shared) - 1e-6


def line_links(docs: DataFrame, lines: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Edges `a`, `b` between keys of different lines that connect all verified pairs."""
    members = stored(_members(lines), "members")
    grams = stored(_line_shingles(docs, members.select("key").distinct()), "grams")
    tiled = members.withColumn("tiles", F.ceil(F.col("n") / TILE)).withColumn("tile", F.pmod(F.xxhash64("key"), F.col("tiles")))
    tiles = tiled.join(grams, "key").groupBy("band", "tile", "tiles").agg(F.collect_list(F.struct("key", "grams")).alias("rows"))
    tiles = stored(tiles.select("band", "tile", "tiles", F.col("rows.key").alias("keys"), F.col("rows.grams").alias("grams")), "tiles")
    # Nearly all bands are one tile; the others are compared tile by tile.
    within = tiles.select("keys", "grams", F.col("keys").alias("other_keys"), F.lit(None).cast("array<array<long>>").alias("other_grams"))
    left = tiles.where("tiles > 1").withColumn("other", F.explode(F.sequence("tile", F.col("tiles") - 1))).where("other <> tile")
    right = tiles.where("tiles > 1").select(
        "band", F.col("tile").alias("other"), F.col("keys").alias("other_keys"), F.col("grams").alias("other_grams")
    )
    across = left.join(right, ["band", "other"]).select("keys", "grams", "other_keys", "other_grams")

    def compare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for k in range(len(part)):
                keys, grams, other_keys, other_grams = (part.column(i)[k] for i in range(4))
                keys, other_keys = (x.values.to_numpy(zero_copy_only=False) for x in (keys, other_keys))
                left = long_lists(grams.values)
                right = left if not other_grams.is_valid else long_lists(other_grams.values)
                hit = jaccard_hits(left, right, similarity)
                hit &= keys[:, None] != other_keys[None, :]
                nodes, lows = forest(hit, keys, other_keys) if hit.any() else (np.zeros(0, np.int64),) * 2
                yield pa.record_batch([pa.array(nodes), pa.array(lows)], ["a", "b"])

    return within.union(across).mapInArrow(compare, "a long, b long")


# ---------------------------------------------------------------- removals


PLACES = ["doc_id", "row", "start", "stop"]
AROUND = "key long, doc_id long, row long, start int, stop int"


def _first(rows: DataFrame) -> DataFrame:
    """`key`, `first`: the smallest doc_id of each key that several have."""
    spread = rows.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count_if(F.col("doc_id").isNull()).alias("nulls"))
    return stored(spread.where("first <> last OR (first IS NOT NULL AND nulls > 0)").select("key", "first"), "shared")


def _shared(rows: DataFrame) -> DataFrame:
    """The rows whose key several documents have, with `first`."""
    shared = _first(rows)
    return perhaps_in(rows, bitmap(shared, "key"), "key").join(shared, "key")


def _repeated_lines(rows: DataFrame, names: DataFrame) -> DataFrame:
    """The places whose cluster has a smaller doc_id. `names`: the cluster of the keys that have one besides themselves."""
    rows = rows.join(names, "key", "left").withColumn("key", F.coalesce("cluster", "key")).drop("cluster")
    return _shared(rows).where("NOT doc_id <=> first").select(PLACES)


def _repeated_runs(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """The places of the chosen runs, and of those around them, that a smaller doc_id has as well.

    A second pass over the texts with shared runs gives every run near one. Only those at the ends of what
    is already cut are looked up, among all runs near a shared one.
    """
    seeds = stored(_shared(runs).select(*PLACES, F.expr("NOT doc_id <=> first").alias("repeated")), "seeds")
    by_row = seeds.groupBy(F.col("doc_id").alias("_doc_id"), F.col("row").alias("_row")).agg(
        F.collect_set("start").alias("seeds"), F.collect_set(F.when(F.col("repeated"), F.col("start"))).alias("repeated")
    )
    by_row = stored(by_row, "seeds-by-row")
    some = _with_rows(docs, by_row)

    def extend(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in AROUND.split(", ")]
        for part in parts:
            found: list[tuple[np.ndarray, ...]] = []
            for k, (text, seeds, repeated) in enumerate(zip(*part.columns[2:], strict=True)):
                doc = Document(text.as_py())
                seeds, repeated = (np.searchsorted(doc.starts, x.values.to_numpy(zero_copy_only=False)) for x in (seeds, repeated))
                keys, first, last, wanted = doc.around(seeds, repeated)
                same = np.full(len(keys), k)
                found.append((same, keys.view(np.int64), doc.starts[first].astype(np.int32), doc.ends[last].astype(np.int32), wanted))
                if sum(len(f[0]) for f in found) >= HELD or k + 1 == len(part):
                    owner, keys, start, stop, wanted = map(np.concatenate, zip(*found, strict=True))
                    same = (part.column(i).take(pa.array(owner)) for i in (0, 1))
                    places = (pa.array(x, mask=~wanted) for x in (start, stop))
                    yield pa.record_batch([pa.array(keys), *same, *places], names)
                    found = []

    around = stored(some.mapInArrow(extend, AROUND), "around")
    wanted = around.where("start IS NOT NULL")
    firsts = _first(perhaps_in(around.select("key", "doc_id"), bitmap(wanted, "key"), "key"))
    more = perhaps_in(wanted, bitmap(firsts, "key"), "key").join(firsts, "key").where("NOT doc_id <=> first")
    return seeds.where("repeated").select(PLACES).union(more.select(PLACES))


def _with_rows(docs: DataFrame, by_row: DataFrame) -> DataFrame:
    """doc_id, row, text, seeds, repeated of the documents in `by_row`; other texts are not moved."""
    some = perhaps_in(_source(docs), bitmap(by_row.select(F.col("_row").alias("row")), "row"), "row")
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("row") == F.col("_row"))
    return some.join(by_row, same).select("doc_id", "row", "text", "seeds", "repeated")


def removals(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """`doc_id`, `row`, `start`, `stop`: the places to cut, in bytes of the text; they may overlap."""
    found = stored(units(docs), "units")
    lines = found.where("NOT run").drop("run")
    clusters = connected_components(line_links(docs, lines, similarity)).select(F.col("node").alias("key"), F.col("component").alias("cluster"))
    from_lines = _repeated_lines(lines.select("key", *PLACES), clusters)
    return from_lines.union(_repeated_runs(docs, found.where("run").select("key", *PLACES)))


def cut(text: bytes, places: list[tuple[int, int]]) -> tuple[bytes, list[tuple[int, int]]]:
    """The text without the places, and the places merged where only white space stands between them.

    What is left on both sides is joined by the white space before the place; a line that loses all its
    words loses its end as well.
    """
    merged: list[list[int]] = []
    for start, stop in sorted(places):
        if merged and (start <= merged[-1][1] or not text[merged[-1][1] : start].strip()):
            merged[-1][1] = max(merged[-1][1], stop)
        else:
            merged.append([start, stop])
    kept, at = [], 0
    for start, stop in merged:
        kept.append(text[at:start])
        at = stop
        # One of the two white spaces around the place goes with it.
        if at < len(text) and text[at : at + 1].isspace() and (start == 0 or text[start - 1 : start].isspace()):
            at += 1
    kept.append(text[at:])
    return b"".join(kept), [tuple(m) for m in merged]


def deduplicated(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Every row of `docs` (`doc_id`, `text` and any others) with its text cut, `n_cut` and `spans` added.

    n_cut is the number of places cut, spans their starts and ends in bytes of the old text. A
    null text stays null and shares nothing; texts under 20 words are left alone. Places are kept in the
    smallest doc_id that has them; rows with that doc_id (repeats within a document, repeated rows) all
    keep theirs, and a null doc_id is last. An empty table gives no rows. Columns named n_cut or spans
    are replaced.
    """
    configure(docs.sparkSession)
    docs = docs.drop("n_cut", "spans")
    spans = (
        removals(docs.select("doc_id", "text"), similarity)
        .groupBy(F.col("doc_id").alias("_doc_id"), F.col("row").alias("_row"))
        .agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("_spans"))
    )
    spans = stored(spans, "spans")
    keyed = docs.withColumn("_own", F.xxhash64("doc_id", "text"))
    joined = keyed.join(spans, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("_own") == F.col("_row")), "left")
    names = docs.columns
    at = names.index("text")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def apply(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            changed, spans = [], []
            for text, places in zip(part.column(at), part.column(len(names)), strict=True):
                if not places.is_valid:
                    changed.append(text.as_py())
                    spans.append([])
                    continue
                data, merged = cut(text.as_py().encode(), [(p["start"], p["stop"]) for p in places.as_py()])
                changed.append(data.decode())
                spans.append([{"start": a, "stop": b} for a, b in merged])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
            columns = [*part.columns[:at], pa.array(changed, pa.string()), *part.columns[at + 1 : len(names)]]
            columns += [pa.array([len(s) for s in spans], pa.int32()), pa.array(spans, kind)]
            yield pa.record_batch(columns, [*names, "n_cut", "spans"])

    added = "n_cut int, spans array<struct<start:int,stop:int>>"
    return joined.select(*[F.col(f"`{n}`") for n in names], "_spans").mapInArrow(apply, f"{kinds}, {added}")


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents", "doc_id", "text"))
