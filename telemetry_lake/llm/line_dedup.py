"""Operator 11: lines that many documents share, removed by keep bitmaps. DataFrame functions only.

Every line becomes a row of its key's hash, its document and its position. These rows are range-partitioned
by the hash and sorted by document and position within it, so that the first occurrence of a key in each
document is met in one pass and counting documents is counting first occurrences. A key that holds a third of
all lines would be one range: behind the hash the ranges are cut by a slice of the document's hash, each
slice is summed up in one row, and only these rows meet.

What comes back is small: per document that loses a line the words of 64 lines that lose any, as bits of the
lines that stay. Texts are read to hash their lines and once more to apply the bitmaps; they are
shuffled for that join alone, and not even there while the bitmaps are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from telemetry_lake.llm.common import partitions, stored, table

MIN_DOCS = 10
MIN_CHARS = 1
# What is stripped from both ends of a line, and the letters that are lower-cased.
SPACE = " \t\n\v\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = 64

_DOC = ["doc_id", "t1", "t2"]
_KEY = ["h1", "h2"]


def _hashes(value: str, first: str, second: str) -> list[Column]:
    """128 bits of a text in two columns: two hashes with seeds of their own."""
    return [F.xxhash64(F.lit(1), value).alias(first), F.xxhash64(F.lit(2), value).alias(second)]


def lower_ascii(text: str) -> Column:
    """A-Z lower-cased and nothing else; texts of ASCII alone take the quick way to the same result."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _texts(docs: DataFrame) -> DataFrame:
    """`doc_id`, `t1`, `t2`, `text`: the document is known by its id and the hashes of its text."""
    whole = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return whole.select("doc_id", *_hashes("text", "t1", "t2"), "text")


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """`h1`, `h2`, `doc_id`, `t1`, `t2`, `pos` for every line whose key has `min_chars` code points and more."""
    lines = _texts(docs).select(*_DOC, F.posexplode(F.split(lower_ascii("text"), "\n", -1)).alias("pos", "line"))
    keys = lines.select(*_DOC, "pos", F.btrim("line", F.lit(SPACE)).alias("key"))
    return keys.where(F.char_length("key") >= min_chars).select(*_hashes("key", *_KEY), *_DOC, "pos")


def shared_keys(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """`h1`, `h2`, `docs`, `first` (the place of the first line) of the keys in `min_docs` documents and more.

    `lines` is a stored table of `line_keys` with `slice`.
    """
    ranged = lines.repartitionByRange(partitions(lines.sparkSession), *_KEY, "slice")
    # The ranges already hold whole slices, so neither the window nor the first sum moves a row.
    within = Window.partitionBy(*_KEY, "slice", *_DOC).orderBy("pos")
    firsts = ranged.withColumn("nth", F.row_number().over(within)).where("nth = 1")
    place = F.struct(*_DOC, "pos")
    slices = firsts.groupBy(*_KEY, "slice").agg(F.count("*").alias("docs"), F.min(place).alias("first"))
    sums = slices.groupBy(*_KEY).agg(F.sum("docs").alias("docs"), F.min("first").alias("first"))
    return sums.where(F.col("docs") >= min_docs)


def keep_bitmaps(
    docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, keep_first: bool = False
) -> DataFrame:
    """`doc_id`, `t1`, `t2`, `n_dropped`, `keep` for every document that loses a line.

    A line's key is the line without white space at its ends, A-Z lower-cased. Keys of `min_chars` code points
    and more that stand in `min_docs` documents and more lose all their lines, or with `keep_first` all but
    the first one by document (nulls first) and position. `keep` has one entry `word, bits` for each stretch of
    64 lines that loses any, ascending: bit i is set if line 64 * word + i stays. Lines of other words stay.

    Null and empty texts are one empty line, whose key is too short to be counted. Documents of the same id with
    different texts are different documents; rows that repeat id and text are one document, and share
    a bitmap. Very long texts only make more rows. Further columns are not looked at; an empty table has
    no rows.
    """
    spark = docs.sparkSession
    slice_of = F.pmod(F.xxhash64(*_DOC), F.lit(4 * partitions(spark))).cast("int")
    lines = stored(line_keys(docs, min_chars).withColumn("slice", slice_of), "lines")
    shared = stored(shared_keys(lines, min_docs), "shared_keys")
    dropped = lines.join(shared.select(*_KEY, "first"), _KEY)
    if keep_first:
        dropped = dropped.where(~F.struct(*_DOC, "pos").eqNullSafe(F.col("first")))
    bit = F.expr(f"shiftleft(1L, pos % {WORD})")
    words = dropped.groupBy(*_DOC, (F.col("pos") / WORD).cast("int").alias("word")).agg(F.bit_or(bit).alias("gone"))
    entry = F.struct("word", F.bitwise_not("gone").alias("bits"))
    return words.groupBy(*_DOC).agg(
        F.sum(F.bit_count("gone")).alias("n_dropped"), F.sort_array(F.collect_list(entry)).alias("keep")
    )


def kept_lines(lines: Column, keep: Column) -> Column:
    """The lines that a bitmap leaves, in order. Every line is copied once, whatever the bitmap's length."""

    def stretch(entry: Column, i: Column) -> Column:
        start = F.when(i == 0, 0).otherwise((F.get(keep, i - 1)["word"] + 1) * WORD)
        here = entry["word"] * WORD
        marked = F.filter(
            F.slice(lines, here + 1, F.lit(WORD)), lambda _, j: F.getbit(entry["bits"], j) == 1
        )
        return F.concat(F.slice(lines, start + 1, here - start), marked)

    rest = (F.element_at(keep, -1)["word"] + 1) * WORD
    return F.concat(F.flatten(F.transform(keep, stretch)), F.slice(lines, rest + 1, F.size(lines)))


def deduplicated(
    docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, keep_first: bool = False
) -> DataFrame:
    """Every row of `docs` with its kept lines as `text`, and `n_lines` (before dropping), `n_dropped`, `keep`.

    See `keep_bitmaps`. A null text becomes empty; a document that loses every line becomes empty. `keep` is
    null where nothing is dropped. Columns already named `n_lines`, `n_dropped` or `keep` are replaced, others
    are passed on. Where one id holds many rows the join with its bitmaps is split by their texts' hashes.
    """
    rest = [name for name in docs.columns if name not in ("doc_id", "text", "n_lines", "n_dropped", "keep")]
    bitmaps = keep_bitmaps(docs, min_docs, min_chars, keep_first)
    # Renamed by place, so that no column of the documents can clash with the hashes.
    extra = {name: f"_{k}" for k, name in enumerate(rest)}
    whole = docs.select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), *[F.col(f"`{n}`").alias(a) for n, a in extra.items()]
    ).select("doc_id", *_hashes("text", "t1", "t2"), "text", *extra.values())
    same = whole["doc_id"].eqNullSafe(bitmaps["doc_id"]) & (whole["t1"] == bitmaps["t1"]) & (whole["t2"] == bitmaps["t2"])
    marked = whole.join(bitmaps, same, "left").select(
        whole["doc_id"],
        "text",
        F.split("text", "\n", -1).alias("lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        "keep",
        *extra.values(),
    )
    text = F.when(F.col("keep").isNull(), F.col("text")).otherwise(
        F.concat_ws("\n", kept_lines(F.col("lines"), F.col("keep")))
    )
    return marked.select(
        "doc_id",
        text.alias("text"),
        F.size("lines").cast("long").alias("n_lines"),
        "n_dropped",
        "keep",
        *[F.col(a).alias(n) for n, a in extra.items()],
    )


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduplicated(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP11_SQL = f"""
WITH lines AS (
  SELECT doc_id, pos, parts[pos] AS line,
         translate(trim(parts[pos], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))),
shared AS (
  SELECT key FROM lines WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
marked AS (SELECT l.*, s.key IS NOT NULL AS gone FROM lines l LEFT JOIN shared s ON l.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""
