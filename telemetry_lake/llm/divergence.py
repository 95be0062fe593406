"""Operator 13: how far the sources of a language differ in the words they use.

Terms are counted per (language, source) group. All groups of a language are compared with one another by
a sum over all kept terms, also those that one or both groups lack. Going over all of them would cost the
vocabulary for each pair, so the sum is taken as in a sparse matrix product by rows: each group scatters its
terms through an index by term, which leads to the groups that have the term too, into a dense row of sums, one
for each peer. What a missing term adds depends on the group's smoothed zero alone: a baseline over
each group's own terms, which starts the row, is corrected wherever both have the term, and terms that both lack
are a number times a constant.

The index is cut by a hash of the term into slices of some SLICE_ROWS postings, and groups into blocks of
BLOCK, so that a task holds one slice for two blocks whatever the size of a group. A pair of groups costs one row
for each slice; postings are never paired up in rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from telemetry_lake.llm.common import configure, stored, table

MIN_DOCS = 10
TOP_TERMS = 10
# Postings of one slice of a language's index, and groups of one block.
SLICE_ROWS = 1 << 17
BLOCK = 512
# Counts that a worker holds before it hands them on; they are added up again behind the shuffle.
HELD = 400_000
# Fixed values of the smoothed shares.
UNIT, ADDED = 1_000_000_000, 2

# Letters stay, A-Z lower-cased, and all bytes of characters beyond ASCII; the rest separates terms.
_LETTERS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)

COUNTS = "lang string, source string, term string, n long, docs long"
SCHEMA = "lang string, source string, part string, item string, value long, rank int"


def terms(text: bytes) -> list[bytes]:
    return text.translate(_LETTERS).split()


def _counted(counts: dict[tuple[str, str], Counter], docs: dict[tuple[str, str], Counter]) -> pa.RecordBatch:
    langs, sources, names, found, seen = [], [], [], [], []
    for (lang, source), of_group in counts.items():
        langs += [lang] * len(of_group)
        sources += [source] * len(of_group)
        names += of_group.keys()
        found += of_group.values()
        seen += map(docs[lang, source].__getitem__, of_group)
    kinds = [pa.string()] * 2 + [pa.binary()] + [pa.int64()] * 2
    columns = [pa.array(c, k) for c, k in zip((langs, sources, names, found, seen), kinds, strict=True)]
    columns[2] = columns[2].cast(pa.string())
    return pa.record_batch(columns, ["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """`lang`, `source`, `term`, `n` (occurrences), `docs` (rows that have it) of every group, added up."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen, held = defaultdict(Counter), defaultdict(Counter), 0
        for part in parts:
            for text, lang, source in zip(part.column(0), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                words = terms(text.as_buffer().to_pybytes())
                own = counts[lang, source]
                held -= len(own)
                own.update(words)
                held += len(own)
                seen[lang, source].update(set(words))
                if held >= HELD:
                    yield _counted(counts, seen)
                    counts, seen, held = defaultdict(Counter), defaultdict(Counter), 0
        yield _counted(counts, seen)

    found = docs.select("text", "lang", "source").mapInArrow(count, COUNTS)
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(counts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """The counts of terms that `min_docs` of their language's documents have, with `total`, the language's
    occurrences, and `leads`, set in one row of each term. A term's rows are its groups', one for each."""
    of_term = Window.partitionBy("lang", "term")
    found = counts.select(
        "lang",
        "source",
        "term",
        "n",
        F.sum("n").over(of_term).alias("total"),
        F.sum("docs").over(of_term).alias("in_docs"),
        (F.row_number().over(of_term.orderBy("source")) == 1).alias("leads"),
    )
    return found.where(F.col("in_docs") >= min_docs).drop("in_docs")


def group_table(groups: DataFrame, kept: DataFrame) -> DataFrame:
    """One row per group: `g` (its number in its language), its kept `terms` and `words`, and the language's
    `lang_terms`, `lang_words` and `lang_rows` (postings)."""
    own = kept.groupBy("lang", "source").agg(F.count("*").alias("terms"), F.sum("n").alias("words"))
    by_lang = kept.groupBy("lang").agg(
        F.count_if("leads").alias("lang_terms"), F.sum("n").alias("lang_words"), F.count("*").alias("lang_rows")
    )
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1
    filled = groups.withColumn("g", number).join(own, ["lang", "source"], "left").join(by_lang, "lang", "left")
    return filled.na.fill(0)


def share(n: Column, words: Column, lang_terms: Column) -> Column:
    """1 + floor(UNIT * (n + 2) / (words + 2 * lang_terms)), exact; 1 where nothing is kept."""
    above = F.lit(UNIT).cast("decimal(10,0)") * (n + ADDED).cast("decimal(20,0)")
    below = F.greatest(words + lang_terms * ADDED, F.lit(1)).cast("decimal(20,0)")
    return F.call_function("div", above, below) + 1


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)), exact: both are at most UNIT + 1."""
    square = (p - q) * (p - q)
    return F.call_function("div", square, p + q)


def _distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _baseline(own: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """What a group's terms add against each peer, as if no peer had them: equal shares count together."""
    values, times = np.unique(own, return_counts=True)
    return (_distance(values[:, None], zeros[None, :]) * times[:, None]).sum(axis=0)


def scattered(
    left: tuple[np.ndarray, np.ndarray, np.ndarray],
    right: tuple[np.ndarray, np.ndarray, np.ndarray],
    zeros: tuple[np.ndarray, np.ndarray],
    terms_here: int,
) -> np.ndarray:
    """Sums for each pair of a left and a right group over the terms that either has.

    Both sides are postings (group, term, share), groups and terms as numbers from 0; `zeros` are the shares
    of a count of 0.
    """
    near, far = zeros
    sums = np.zeros((len(near), len(far)), np.int64)
    group, term, p = left
    peer, index_term, q = right
    order = np.argsort(index_term, kind="stable")
    peer, q, ends = peer[order], q[order], np.zeros(terms_here + 1, np.int64)
    ends[1:] = np.cumsum(np.bincount(index_term, minlength=terms_here))

    order = np.argsort(group, kind="stable")
    term, p, bounds = term[order], p[order], np.searchsorted(group[order], np.arange(len(near) + 1))
    for g, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        sums[g] += _baseline(p[a:b], far)
        first, found = ends[term[a:b]], ends[term[a:b] + 1] - ends[term[a:b]]
        # The index entries of all terms of the group, one after the other.
        at = np.arange(found.sum()) + np.repeat(first - np.cumsum(found) + found, found)
        mine, theirs, to = np.repeat(p[a:b], found), q[at], peer[at]
        both = _distance(mine, theirs) - _distance(mine, far[to]) - _distance(near[g], theirs) + _distance(near[g], far[to])
        np.add.at(sums[g], to, both)

    order = np.argsort(peer, kind="stable")
    q, bounds = q[order], np.searchsorted(peer[order], np.arange(len(far) + 1))
    for h, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        sums[:, h] += _baseline(q[a:b], near)
    return sums


def _compare(key: tuple, found: pa.Table) -> pa.Table:
    """One slice of a language for two blocks of groups: rows without a term name a group and its zero."""
    lang, _, i, j = (k.as_py() for k in key)
    g, block, share_of, zero = (found[c].to_numpy() for c in ("g", "block", "p", "zero"))
    coded = pc.dictionary_encode(found["term"].combine_chunks())
    term, terms_here = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary)
    sides, zeros, numbers = [], [], []
    for b in (i, j):
        known = np.flatnonzero((term < 0) & (block == b))
        known = known[np.argsort(g[known])]
        rows = np.flatnonzero((term >= 0) & (block == b))
        numbers.append(g[known])
        zeros.append(zero[known])
        sides.append((np.searchsorted(g[known], g[rows]), term[rows], share_of[rows]))
    sums = scattered(sides[0], sides[1], (zeros[0], zeros[1]), terms_here)
    a, b = np.meshgrid(numbers[0], numbers[1], indexing="ij")
    a, b, sums = a.ravel(), b.ravel(), sums.ravel()
    if i != j:
        a, b, sums = np.concatenate((a, b)), np.concatenate((b, a)), np.concatenate((sums, sums))
    other = a != b
    columns = [pa.array([lang] * int(other.sum()), pa.string()), pa.array(a[other]), pa.array(b[other]), pa.array(sums[other])]
    return pa.table(columns, names=["lang", "g", "h", "value"])


def pair_sums(groups: DataFrame, kept: DataFrame) -> DataFrame:
    """`lang`, `g`, `h`, `value`: the sums of all pairs of a language over the terms that either has."""
    block = F.floor(F.col("g") / BLOCK).cast("int")
    zero = share(F.lit(0), F.col("words"), F.col("lang_terms"))
    slices = F.greatest(F.ceil(F.col("lang_rows") / SLICE_ROWS), F.lit(1)).cast("int")
    size = Window.partitionBy("lang")
    known = groups.select(
        "lang", "source", "g", block.alias("block"), zero.alias("zero"), "words", "lang_terms", slices.alias("slices"),
        (F.floor(F.max("g").over(size) / BLOCK) + 1).cast("int").alias("blocks"),
    )
    postings = kept.join(known, ["lang", "source"]).select(
        "lang", "g", "block", "blocks", "zero", "term",
        share(F.col("n"), F.col("words"), F.col("lang_terms")).alias("p"),
        F.pmod(F.xxhash64("term"), F.col("slices")).cast("int").alias("slice"),
    )
    named = known.select(
        "lang", "g", "block", "blocks", "zero", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("p"),
        F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"),
    )
    # A block meets itself and every other one, once.
    both = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda b: F.struct(F.least(b, "block").alias("i"), F.greatest(b, "block").alias("j")),
    )
    met = postings.unionByName(named).withColumn("met", F.explode(both))
    wanted = met.select("lang", "slice", "met.i", "met.j", "g", "block", "zero", "term", "p")
    sums = wanted.groupBy("lang", "slice", "i", "j").applyInArrow(_compare, "lang string, g long, h long, value long")
    return sums.groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """`lang`, `source`, `part`, `item`, `value`, `rank` for each group of `text`, `lang`, `source`.

    Part `pair` has every other source of the language by falling distance, part `term` the `top` terms that the
    group uses more than its language. Null texts, languages and sources count as ''. A group without terms has
    all its pairs; without kept terms they are 0 apart. The only source of a language has no pairs. Every row
    is a document, repeated or not; ties go by the item's UTF-8 bytes; very long texts only make larger counts;
    further columns are not looked at; an empty table gives no rows.
    """
    configure(docs.sparkSession)
    docs = docs.select(*[F.coalesce(name, F.lit("")).alias(name) for name in ("text", "lang", "source")])
    counts = stored(term_counts(docs), "term_counts")
    kept = stored(kept_terms(counts, min_docs), "kept_terms")
    groups = stored(group_table(docs.select("lang", "source").distinct(), kept), "groups")

    sums = pair_sums(groups, kept)
    sides = [
        groups.select(
            "lang", F.col("g").alias(at), F.col("source").alias(name), F.col("terms").alias(f"{at}_terms"),
            share(F.lit(0), F.col("words"), F.col("lang_terms")).alias(f"{at}_zero"), *rest,
        )
        for at, name, rest in (("g", "source", ["lang_terms"]), ("h", "item", []))
    ]
    neither = (F.col("lang_terms") - F.col("g_terms") - F.col("h_terms")) * distance(F.col("g_zero"), F.col("h_zero"))
    pairs = sums.join(sides[0], ["lang", "g"]).join(sides[1], ["lang", "h"]).select(
        "lang", "source", F.lit("pair").alias("part"), "item", (F.col("value") + neither).alias("value")
    )

    p = share(F.col("n"), F.col("words"), F.col("lang_terms"))
    q = share(F.col("total"), F.col("lang_words"), F.col("lang_terms"))
    known = groups.select("lang", "source", "words", "lang_words", "lang_terms")
    scored = kept.join(known, ["lang", "source"]).select("lang", "source", "term", p.alias("p"), q.alias("q")).where("p > q")
    used = scored.select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value")
    )
    # Spark cuts each task's rows to the wanted ranks before it shuffles them.
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [rows.withColumn("rank", F.row_number().over(order)) for rows in (pairs, used)]
    return ranked[0].unionByName(ranked[1].where(F.col("rank") <= top))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents", "text", "lang", "source"))


OP13_SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text
  FROM documents),
words AS (
  SELECT d, lang, source, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM docs),
kept AS (
  SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM words
  GROUP BY lang, term HAVING count(DISTINCT d) >= {MIN_DOCS}),
langs AS (
  SELECT l.lang, count(k.term) AS v, coalesce(sum(k.n), 0) AS words
  FROM (SELECT DISTINCT lang FROM docs) l LEFT JOIN kept k ON l.lang = k.lang GROUP BY l.lang),
counts AS (
  SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN kept k ON w.lang = k.lang AND w.term = k.term
  GROUP BY w.lang, w.source, w.term),
groups AS (
  SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS words
  FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN counts c ON g.lang = c.lang AND g.source = c.source
  GROUP BY g.lang, g.source),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         CAST(1 + ({UNIT}::HUGEINT * (coalesce(c.n, 0) + {ADDED})) // (g.words + {ADDED} * l.v) AS BIGINT) AS p,
         CAST(1 + ({UNIT}::HUGEINT * (k.n + {ADDED})) // (l.words + {ADDED} * l.v) AS BIGINT) AS q
  FROM groups g JOIN langs l ON g.lang = l.lang JOIN kept k ON g.lang = k.lang
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY a.lang, a.source, b.source),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value,
       CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM parts QUALIFY part = 'pair' OR rank <= {TOP_TERMS}"""
