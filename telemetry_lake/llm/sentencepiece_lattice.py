"""Operator 6: SentencePiece encoding and decoding over a relational lattice.

A text is marked (a leading and every other space become U+2581) and cut into words wherever two neighbouring
characters stand next to each other in no piece, so that no piece spans two words. The distinct words are encoded once, relationally: substrings up to the longest piece's length are exploded,
joined to the piece table by equality, grouped by word into the edges of its lattice, and the edges are
folded to a segmentation with Spark's higher-order `aggregate`:

    viterbi  the path with the greatest sum of scores, for unigram models
    merge    the best-scored neighbours are joined until none can be, for BPE models

A BPE model's own segmentation is not its best path, so for such a model Viterbi would give other ids than the
library; the lattice is the same, only the fold differs.

Texts never move. Each block of rows of an input file gets the words it needs as a small dictionary
in the shared folder, and a second pass over the same rows writes the ids.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import sentencepiece
from public_tokenizers import path
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telemetry_lake.llm.common import configure, file_store, partitions
from telemetry_lake.session import scratch_dir

MODEL = "piece_bpe_32k.model"
MARK = "▁"
# Longer words go to the library; a lattice's boundaries are the bits of a 64-bit integer.
LONGEST = 62
# Rows of an input file that share a dictionary.
BLOCK = 1 << 13
# Distinct words a task holds before it hands them on; they are Arrow columns, of some 15 bytes a word.
HELD = 1 << 20
# Bytes of texts, or of ids, that are worked on together; what numpy holds of them for a while is some 40 times as much.
TOGETHER = 1 << 18
# What Viterbi charges for a character without a piece.
UNKNOWN = -100.0


@dataclass(frozen=True)
class Pieces:
    """Text, id and score of the pieces that stand for text, and the ids of the 256 bytes."""

    rows: tuple[tuple[str, int, float], ...]
    byte_ids: tuple[int, ...]

    @property
    def longest(self) -> int:
        return max(len(text) for text, _, _ in self.rows)

    @functools.cached_property
    def neighbours(self) -> frozenset[tuple[str, str]]:
        """Characters that stand next to each other in some piece."""
        return frozenset(pair for text, _, _ in self.rows for pair in zip(text, text[1:], strict=False))

    def spell(self) -> dict[int, bytes]:
        known = {number: text.replace(MARK, " ").encode() for text, number, _ in self.rows}
        return known | {number: bytes([b]) for b, number in enumerate(self.byte_ids)}


@functools.cache
def _library(model: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=path(model))


@functools.cache
def load(model: str = MODEL) -> Pieces:
    """The model's pieces; an error if there are no pieces for bytes."""
    sp = _library(model)
    every = range(sp.get_piece_size())
    special = lambda k: sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k) or sp.is_byte(k)
    rows = tuple((sp.id_to_piece(k), k, sp.get_score(k)) for k in every if not special(k))
    byte_ids = {int(sp.id_to_piece(k)[3:5], 16): k for k in every if sp.is_byte(k)}
    if len(byte_ids) != 256:
        raise ValueError("the model has no pieces for bytes")
    return Pieces(rows, tuple(byte_ids[b] for b in range(256)))


def words(text: str, pieces: Pieces) -> list[str]:
    """The marked text's words, one after another."""
    marked = MARK + text.replace(" ", MARK) if text else ""
    joined = pieces.neighbours
    cuts = [k for k, pair in enumerate(zip(marked, marked[1:], strict=False), 1) if pair not in joined]
    return [marked[a:b] for a, b in zip([0, *cuts], [*cuts, len(marked)], strict=True)] if marked else []


def _plain(text: str) -> bool:
    """Whether the text's words are those of its parts between spaces: every mark follows another character."""
    return bool(text) and text[0] != " " and "  " not in text and MARK not in text


@dataclass(frozen=True)
class Cuts:
    """Which characters may stand next to each other within a word, as a table."""

    letters: np.ndarray
    joined: np.ndarray

    @classmethod
    def of(cls, pieces: Pieces) -> Cuts:
        letters = sorted({letter for pair in pieces.neighbours for letter in pair})
        at = {letter: k for k, letter in enumerate(letters, 1)}
        # Row and column 0 are for all other characters.
        joined = np.zeros((len(letters) + 1,) * 2, bool)
        for a, b in pieces.neighbours:
            joined[at[a], at[b]] = True
        return cls(np.array([ord(letter) for letter in letters], np.int64), joined)

    @functools.cached_property
    def places(self) -> np.ndarray:
        """The row of every code point."""
        places = np.zeros(0x110000, np.int32)
        places[self.letters] = np.arange(1, len(self.letters) + 1)
        return places

    def words(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The words of all texts one after another, their lengths, and the place of each text's first word (and the end).

        The same words as `words` gives, for a whole column at once.
        """
        texts = texts.cast(pa.large_string()).fill_null("")
        mark, empty = pa.scalar(MARK, pa.large_string()), pa.scalar("", pa.large_string())
        marked = pc.binary_join_element_wise(mark, pc.replace_substring(texts, " ", MARK), empty)
        marked = pc.if_else(pc.equal(texts, empty), empty, marked)
        ends = _ends_of(marked)
        data = _data_of(marked)
        raw = np.frombuffer(data, np.uint8)[: ends[-1]]
        points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), "<u4")
        begins = np.flatnonzero((raw & 0xC0) != 0x80)
        first = np.ones(len(points), bool)
        rows = self.places[points]
        first[1:] = ~self.joined[rows[:-1], rows[1:]]
        first[np.searchsorted(begins, ends[:-1][np.diff(ends) > 0])] = True
        at = np.flatnonzero(first)
        starts = begins[at]
        found = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(np.append(starts, len(raw))), data])
        return found, np.diff(np.append(at, len(points))), np.searchsorted(starts, ends)


def _ends_of(column: pa.Array) -> np.ndarray:
    """Where the values of a large_string or large_binary column begin, and where the last one ends."""
    if not len(column):
        return np.zeros(1, np.int64)
    return np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]


def _data_of(column: pa.Array) -> pa.Buffer:
    return column.buffers()[2] or pa.py_buffer(b"")


def _stretches(column: pa.Array) -> Iterator[pa.Array]:
    """The rows in stretches of up to TOGETHER bytes; a larger row by itself."""
    first = held = 0
    for k, size in enumerate(pc.binary_length(column).fill_null(0).to_pylist()):
        if k > first and held + size > TOGETHER:
            yield column.slice(first, k - first)
            first, held = k, 0
        held += size
    if first < len(column):
        yield column.slice(first)


def _by_block(blocks: pa.Array, column: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """The rows of one block after those of another."""
    numbers = blocks.to_numpy()
    cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
    for first, stop in zip(cuts, cuts[1:], strict=False):
        if first < stop:
            yield int(numbers[first]), column.slice(first, stop - first)


# ---------------------------------------------------------------- lattice


def lattice(distinct: DataFrame, pieces: Pieces) -> DataFrame:
    """`word`, `edges` of every distinct word: (first, last, score, id) of each substring that is a piece.

    The piece table is the vocabulary, of a fixed size, and is broadcast. The rows stay where the
    distinct words are, so grouping the edges moves nothing.
    """
    spark = distinct.sparkSession
    # From Arrow: rows of Python objects would pass through workers of their own on every executor, which then stay.
    columns = zip(("piece", "id", "score"), (pa.string(), pa.int32(), pa.float64()), zip(*pieces.rows, strict=True), strict=True)
    known = spark.createDataFrame(pa.table({name: pa.array(values, kind) for name, kind, values in columns}))
    start = F.explode(F.sequence(F.lit(0), F.length("word") - 1))
    stop = F.explode(F.sequence(F.col("i") + 1, F.least(F.length("word"), F.col("i") + pieces.longest)))
    spans = distinct.withColumn("i", start).withColumn("j", stop)
    cut = spans.withColumn("piece", F.substring("word", F.col("i") + 1, F.col("j") - F.col("i")))
    return (
        cut.join(F.broadcast(known), "piece", "left")
        .where("id IS NOT NULL OR j = i + 1")
        .groupBy("word")
        .agg(F.collect_list(F.struct("i", "j", "score", "id")).alias("edges"))
    )


def _bits(low: Column, high: Column) -> Column:
    """The bits from low to high, without high."""
    one = F.lit(1).cast("long")
    return F.call_function("shiftleft", one, high) - F.call_function("shiftleft", one, low)


def _ends(e: Column) -> Column:
    one = F.lit(1).cast("long")
    return F.call_function("shiftleft", one, e["i"]).bitwiseOR(F.call_function("shiftleft", one, e["j"]))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once: a name of its own would be put in wherever it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def merge_fold(word: Column, edges: Column) -> Column:
    """Boundaries of a word after all merges, as bits.

    The state is one integer. An edge joins two neighbours if both its ends are boundaries and
    exactly one boundary lies between; edges are in the order of preference: best score, then leftmost.
    """

    def ready(e: Column) -> Column:
        return F.struct(
            (-e["score"]).alias("cost"), e["i"].alias("i"), _ends(e).alias("ends"), _bits(e["i"] + 1, e["j"]).alias("inner")
        )

    def fold(preferred: Column) -> Column:
        def step(bounds: Column, _: Column) -> Column:
            def fits(e: Column) -> Column:
                both = bounds.bitwiseAND(e["ends"]) == e["ends"]
                return both & (F.bit_count(bounds.bitwiseAND(e["inner"])) == 1)

            best = F.get(F.filter(preferred, fits), F.lit(0))
            return F.coalesce(bounds.bitwiseAND(F.bitwise_not(best["inner"])), bounds)

        times = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(word) - 1))
        return F.aggregate(times, _bits(F.lit(0), F.length(word) + 1), step)

    long = F.filter(edges, lambda e: (e["j"] - e["i"] > 1) & e["id"].isNotNull())
    return _once(F.array_sort(F.transform(long, ready)), fold)


def viterbi_fold(word: Column, edges: Column) -> Column:
    """Boundaries of the word's path with the greatest sum of scores, as bits; of equal paths one is taken.

    The state is the best (score, boundaries) of every prefix.
    """
    one = F.lit(1).cast("long")
    start = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(1).cast("long").alias("bounds")))

    def step(best: Column, j: Column) -> Column:
        arriving = F.transform(
            F.filter(edges, lambda e: e["j"] == j),
            lambda e: F.struct(
                (F.get(best, e["i"])["score"] + F.coalesce(e["score"], F.lit(UNKNOWN))).alias("score"),
                F.get(best, e["i"])["bounds"].bitwiseOR(F.call_function("shiftleft", one, j)).alias("bounds"),
            ),
        )
        return F.concat(best, F.array(F.array_max(arriving)))

    return F.aggregate(F.sequence(F.lit(1), F.length(word)), start, step, lambda best: F.get(best, F.length(word))["bounds"])


FOLDS = {"merge": merge_fold, "viterbi": viterbi_fold}


def segmented(distinct: DataFrame, pieces: Pieces, fold: str = "merge") -> DataFrame:
    """`word`, `ids` of every distinct word of up to LONGEST characters."""
    # The byte pieces' ids follow one another in all models; load() has checked that there are 256.
    first = pieces.byte_ids[0]
    if pieces.byte_ids != tuple(range(first, first + 256)):
        raise ValueError("the pieces for bytes are not in order")

    def number(e: Column) -> Column:
        text = F.hex(F.encode(F.substring(F.col("word"), e["i"] + 1, F.lit(1)), "UTF-8"))
        places = F.sequence(F.lit(0), (F.length(text) / 2).cast("int") - 1)
        spelled = F.transform(places, lambda b: F.conv(F.substring(text, b * 2 + 1, F.lit(2)), 16, 10).cast("int") + first)
        return F.when(e["id"].isNotNull(), F.array(e["id"])).otherwise(spelled)

    def ids(bounds: Column) -> Column:
        """The edges from one boundary to the next, in their order, as ids."""

        def chosen(e: Column) -> Column:
            ends = _ends(e)
            return (bounds.bitwiseAND(ends) == ends) & (bounds.bitwiseAND(_bits(e["i"] + 1, e["j"])) == 0)

        return F.flatten(F.transform(F.array_sort(F.filter("edges", chosen)), number))

    found = lattice(distinct, pieces)
    return found.select("word", _once(FOLDS[fold](F.col("word"), F.col("edges")), ids).alias("ids"))


# ---------------------------------------------------------------- texts


def file_blocks(docs: DataFrame) -> DataFrame:
    """Rows of a file table with `block`: the same number for BLOCK rows of a file, in every pass."""
    place = F.floor(F.col("_metadata.row_index") / BLOCK)
    return docs.select("*", F.xxhash64(F.col("_metadata.file_path"), place).alias("block"))


def _needed(blocked: DataFrame, cuts: Cuts) -> DataFrame:
    """`block`, `word`: the words of up to LONGEST characters of each block, once unless there are more than HELD."""

    def find(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size = 0, [], 0

        def handed_on() -> Iterator[pa.RecordBatch]:
            some = _distinct(held)
            for at in range(0, len(some), 20_000):
                part = some.slice(at, 20_000)
                yield pa.record_batch([pa.array(np.full(len(part), now)), part.cast(pa.string())], ["block", "word"])

        for part in parts:
            for block, texts in _by_block(part.column(0), part.column(1)):
                if block != now:
                    # The rows of a block follow one another; the one before is done.
                    yield from handed_on()
                    now, held, size = block, [], 0
                for some in _stretches(texts):
                    found, lengths, _ = cuts.words(some)
                    held.append(_distinct([found.filter(pa.array(lengths <= LONGEST))]))
                    size += len(held[-1])
                    if size > HELD:
                        held = [_distinct(held)]
                        size = len(held[0])
                    if size > HELD // 2 and len(held) == 1:
                        yield from handed_on()
                        held, size = [], 0
        yield from handed_on()

    return blocked.select("block", "text").mapInArrow(find, "block long, word string")


def _distinct(some: list[pa.Array]) -> pa.Array:
    return pc.unique(pa.chunked_array(some, pa.large_string()))


def encode(blocked: DataFrame, model: str = MODEL, fold: str = "merge") -> DataFrame:
    """`doc_id` and `ids` (little-endian unsigned 32-bit) of every row of `doc_id`, `text`, `block`.

    `block` says which rows share a dictionary and must be the same each time the table is read;
    `file_blocks` gives it for file tables. Null and empty texts have no ids. Repeated rows stay
    repeated, further columns are left out, an empty table gives no rows.
    """
    spark = blocked.sparkSession
    configure(spark)
    pieces = load(model)
    cuts = Cuts.of(pieces)
    # Dealt by word and kept: the distinct words, their lattices and the join below all stay where they are.
    needed = _needed(blocked, cuts).repartition(partitions(spark), "word").persist(StorageLevel.DISK_ONLY)
    folder = scratch_dir(spark, "words")
    try:
        found = segmented(needed.select("word").distinct(), pieces, fold)
        held = needed.join(found, "word").select("block", "word", "ids")
        held.repartition("block").sortWithinPartitions("block").write.partitionBy("block").parquet(folder)
    finally:
        needed.unpersist()

    def apply(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known = None, None
        for part in parts:
            out = [pa.array([], pa.binary())]
            for block, texts in _by_block(part.column(1), part.column(2)):
                if block != now:
                    known = None  # before the next dictionary is loaded
                    now, known = block, Dictionary(folder, block)
                out.append(_spelled(texts, known, cuts, model))
            yield pa.record_batch([part.column(0), pa.concat_arrays(out)], ["doc_id", "ids"])

    return blocked.select("doc_id", "block", "text").mapInArrow(apply, "doc_id long, ids binary")


class Dictionary:
    """A block's words and ids (little-endian unsigned 32-bit), as Arrow columns: a word costs its bytes, and no Python object."""

    def __init__(self, folder: str, block: int):
        store, base = file_store(folder)
        self.words, self.ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())
        if store.get_file_info(f"{base}/block={block}").type.name != "NotFound":
            rows = pq.read_table(f"{base}/block={block}", filesystem=store, columns=["word", "ids"], partitioning=None, use_threads=False)
            self.words = rows["word"].combine_chunks().cast(pa.large_string())
            ids = rows["ids"].combine_chunks()
            ends = pa.py_buffer(4 * ids.offsets.to_numpy().astype(np.int64))
            self.ids = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, ends, pa.py_buffer(ids.values.to_numpy().astype("<u4"))])

    def of(self, some: pa.Array) -> pa.Array:
        """The ids of each of the words, null for one that the dictionary does not have."""
        return self.ids.take(pc.index_in(some, self.words))


def _spelled(texts: pa.Array, known: Dictionary, cuts: Cuts, model: str) -> pa.Array:
    """The ids of each text; a word is looked up once for all of them."""
    found, ends = [pa.array([], pa.large_string())], [np.zeros(1, np.int64)]
    for some in _stretches(texts):
        words_of, _, at = cuts.words(some)
        found.append(words_of)
        ends.append(ends[-1][-1] + at[1:])
    coded = pa.concat_arrays(found).dictionary_encode()
    ids = known.of(coded.dictionary)
    if ids.null_count:
        missing = ids.is_null()
        long = [_long_word(word, model) for word in coded.dictionary.filter(missing).to_pylist()]
        ids = pc.replace_with_mask(ids, missing, pa.array(long, pa.large_binary()))
    # What is taken lies one after another, so a text's ids reach from its first word to the next text's.
    taken = ids.take(coded.indices)
    places = _ends_of(taken)[np.concatenate(ends)].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(places), _data_of(taken)])


def _long_word(word: str, model: str) -> bytes:
    """A word beyond the lattice's length, by the library; the mark that it adds is taken off again."""
    if len(word) <= LONGEST:
        raise KeyError(word)
    sp = _library(model)
    if word.startswith(MARK):
        return np.array(sp.encode(word[1:]), "<u4").tobytes()
    # Behind a line end the library adds no mark; the line end's own byte comes off the front.
    ids = sp.encode("\n" + word)
    lead = len(sp.encode("\n"))
    return np.array(ids[lead:], "<u4").tobytes()


def _text(ids: pa.Array, spell: pa.Array) -> pa.Array:
    """The text of each row of ids; `spell` has the bytes of every id."""
    ids = ids.cast(pa.large_binary()).fill_null(b"")
    ends = _ends_of(ids)
    if (np.diff(ends) % 4).any():
        raise ValueError("ids are not whole 32-bit integers")
    numbers = np.frombuffer(_data_of(ids), np.uint8)[ends[0] : ends[-1]].view("<u4")
    taken = spell.take(pa.array(np.minimum(numbers, len(spell) - 1)))
    data, ends = np.frombuffer(_data_of(taken), np.uint8), _ends_of(taken)[(ends - ends[0]) // 4]
    # The space in front of each text goes.
    starts = ends[:-1][np.diff(ends) > 0]
    spaces = starts[data[starts] == ord(" ")]
    data, ends = np.delete(data[: ends[-1]], spaces), ends - np.searchsorted(spaces, ends)
    starts = ends[:-1][np.diff(ends) > 0]
    try:
        if (data[starts] & 0xC0 == 0x80).any():
            raise ValueError("a text begins within a character")
        data.tobytes().decode()
    except ValueError:
        return pa.array([data[a:b].tobytes().decode(errors="replace") for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.string())
    return pa.Array.from_buffers(pa.string(), len(ids), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """Every row of `ids` (and any others) with its `text`: the pieces' text without the leading space.

    A column named text is replaced. Null ids count as none. Bytes that are no UTF-8 become U+FFFD; ids without text (control pieces) are skipped.
    """
    configure(encoded.sparkSession)
    known = load(model).spell()
    # The place behind the last piece is for ids without text.
    spell = pa.array([known.get(n, b"") for n in range(max(known) + 2)], pa.large_binary())

    encoded = encoded.drop("text")
    names, at = encoded.columns, encoded.columns.index("ids")

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out = [_text(ids, spell) for ids in _stretches(part.column(at))]
            yield pa.record_batch([*part.columns, pa.concat_arrays([pa.array([], pa.string()), *out])], [*names, "text"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(read, f"{kinds}, text string")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and checksum of every text's ids, and the digest of what decoding them gives."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "_metadata")
    return decode(encode(file_blocks(docs))).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )
