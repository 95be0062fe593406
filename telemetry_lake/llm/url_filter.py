"""Operator 10: URL filter by rules and, where none fits, by a character language-model ratio.

Two smoothed variable-order Markov models of characters are counted from URLs that rules accept and
reject. A URL's score is the difference of its log-likelihoods under the two, divided by its
length. The least score to be accepted is calibrated on URLs the models were not counted from.

Model: for a character c after a context s of up to ORDER characters,

    p(c | s) = (n(sc) + WEIGHT * p(c | s without its first character)) / (n(s) + WEIGHT)

down to a uniform distribution of 256 bytes below the empty context. Counts are exact and cover every
labelled URL. They are a table with one row per context and character that occur (a gram), which
grows with the input and is never held in one place: shorter contexts are sums of that table, scores
come from joining the grams of blocks of URLs to it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from telemetry_lake.llm.common import configure, stored, table, texts

ORDER = 5
# A character is 1 + its byte, 0 stands before a URL's start. ORDER + 1 of them fill 54 bits of a gram.
BITS = 9
# URLs are looked up together up to so many characters; a longer one alone.
BLOCK = 1 << 16
WEIGHT = 2.0
# One labelled URL in HELD_OUT is kept for the calibration.
HELD_OUT = 5
# Scores are tallied in bins of this width when the threshold is sought.
BIN = 0.01
RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)


def host(url: str | Column = "url") -> Column:
    """What follows the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: str | Column = "url") -> Column:
    """What follows the host up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """Rule and verdict of the longest rule that fits `host` and `path`; null where none does.

    A rule is a host and the start of a path. It fits its host and all subdomains. Of equally
    long rules the first in the alphabet wins. The list is a parameter of the query and becomes
    one expression, for rule lists of up to some hundred entries.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), [-ord(c) for c in r[0]])):
        name, slash, rest = text.partition("/")
        own = F.concat(F.lit("."), F.col("host")).endswith(f".{name}")
        fits = own & F.col("path").startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def _grams(urls: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The gram of every character of all URLs, in order, and the URLs' lengths. The last character has the lowest bits."""
    lengths = np.array([len(u) for u in urls], np.int64)
    data = np.frombuffer(b"".join(urls), np.uint8).astype(np.int64) + 1
    at = np.arange(len(data)) + ORDER * (np.repeat(np.arange(len(urls)), lengths) + 1)
    padded = np.zeros(len(data) + ORDER * len(urls), np.int64)
    padded[at] = data
    grams = np.zeros(len(data), np.int64)
    for back in range(ORDER + 1):
        grams |= padded[at - back] << (BITS * back)
    return grams, lengths


def _bytes(column: pa.Array) -> list[bytes]:
    return [url.encode("utf-8", "surrogatepass") for url in texts(column)]


def count(labelled: DataFrame) -> DataFrame:
    """`gram`, `n0`, `n1`: how often each occurs in all rows of `label` (0 reject, 1 accept) and `url`."""

    def tally(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            grams, lengths = _grams(_bytes(part.column(1)))
            labels = np.repeat(part.column(0).to_numpy(zero_copy_only=False).astype(np.int64), lengths)
            found, place = np.unique(grams, return_inverse=True)
            n = [np.bincount(place[labels == k], minlength=len(found)) for k in (0, 1)]
            yield pa.record_batch([pa.array(found), pa.array(n[0]), pa.array(n[1])], ["gram", "n0", "n1"])

    parts = labelled.select("label", "url").mapInArrow(tally, "gram long, n0 long, n1 long")
    return _summed(parts)


def _summed(counts: DataFrame) -> DataFrame:
    return counts.groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


@dataclass(frozen=True)
class Model:
    """Table of `gram`, `n0`, `n1`, and the calibrated threshold."""

    counts: DataFrame
    threshold: float = 0.0

    def score(self, url: str) -> float:
        """The score of one URL, by a query of its own."""
        row = self.counts.sparkSession.createDataFrame([(url,)], "url string")
        return scored(row, self).first()["score"]


def evidence(counts: DataFrame, grams: DataFrame) -> DataFrame:
    """`gram`, `value`: log p(c | s) as accepted less that as rejected, for the counted and the given grams.

    Order by order from the empty context: a context has at most 257 characters after it, and a gram
    at most 257 longer ones, so no key of the windows and joins gathers more rows than that.
    """
    asked = grams.select("gram", F.lit(0).cast("long").alias("n0"), F.lit(0).cast("long").alias("n1"))
    longest = stored(_summed(counts.select("gram", "n0", "n1").union(asked)), "grams")
    lower = None
    for order in range(ORDER + 1):
        mask = (1 << BITS * (order + 1)) - 1
        level = _summed(longest.withColumn("gram", F.col("gram").bitwiseAND(F.lit(mask)))) if order < ORDER else longest
        if lower is None:
            level = level.withColumns({"q0": F.lit(1 / 256), "q1": F.lit(1 / 256)})
        else:
            level = level.withColumn("shorter", F.col("gram").bitwiseAND(F.lit(mask >> BITS))).join(lower, "shorter")
        context = Window.partitionBy(F.shiftright("gram", BITS))
        p = [(F.col(f"n{k}") + WEIGHT * F.col(f"q{k}")) / (F.sum(f"n{k}").over(context) + WEIGHT) for k in (0, 1)]
        level = level.select("gram", p[0].alias("q0"), p[1].alias("q1"))
        lower = level.withColumnRenamed("gram", "shorter")
    return level.select("gram", (F.log("q1") - F.log("q0")).alias("value"))


def scored(df: DataFrame, model: Model) -> DataFrame:
    """Every row with its `score`, the mean value of its URL's grams; a null URL scores as an empty one, 0.

    Rows are stored in blocks of up to BLOCK characters with the distinct grams of each, so a gram
    that every URL has is looked up once a block.
    """
    names = df.columns
    fields = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    kind = ", ".join(f"`{name}` {of}" for name, of in fields)
    rows = ",".join(f"`{name}`:{of}" for name, of in fields)

    def gather(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            grams, lengths = _grams(_bytes(part.column(names.index("url"))))
            ends = np.cumsum(lengths)
            start = 0
            while start < len(part):
                before = int(ends[start - 1]) if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, before + BLOCK, "right")))
                held = pa.StructArray.from_arrays([c.slice(start, stop - start) for c in part.columns], names)
                own = np.unique(grams[before : ends[stop - 1]])
                block = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (held, pa.array(own))]
                yield pa.record_batch(block, ["rows", "grams"])
                start = stop

    blocks = df.mapInArrow(gather, f"rows array<struct<{rows}>>, grams array<long>")
    blocks = stored(blocks.withColumn("block", F.monotonically_increasing_id()), "blocks")
    asked = blocks.select("block", F.explode("grams").alias("gram"))
    known = asked.join(evidence(model.counts, asked.select("gram").distinct()), "gram")
    known = known.groupBy("block").agg(F.collect_list(F.struct("gram", "value")).alias("known"))

    def judge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for k in range(len(part)):
                held, known = part.column(0)[k].values, part.column(1)[k]
                grams, lengths = _grams(_bytes(held.field("url")))
                scores = np.zeros(len(held))
                if len(grams):
                    gram, value = (known.values.field(n).to_numpy(zero_copy_only=False) for n in ("gram", "value"))
                    order = np.argsort(gram)
                    values = value[order][np.searchsorted(gram[order], grams)]
                    some = lengths > 0
                    starts = (np.cumsum(lengths) - lengths)[some]
                    scores[some] = np.add.reduceat(values, starts) / lengths[some]
                yield pa.record_batch([*held.flatten(), pa.array(scores)], [*names, "score"])

    return blocks.select("block", "rows").join(known, "block", "left").select("rows", "known").mapInArrow(judge, f"{kind}, score double")


def calibrated(tally: list[tuple[int, int, int]]) -> float:
    """The threshold with the least sum of both error rates, from (bin, label, rows); 0 without both labels.

    Of equally good thresholds the middle one is taken.
    """
    bins = sorted({b for b, _, _ in tally})
    totals = [sum(n for _, label, n in tally if label == k) for k in (0, 1)]
    if not all(totals):
        return 0.0
    below = {0: 0, 1: 0}
    rows = {(b, label): n for b, label, n in tally}
    best = [(1.0, bins[0] * BIN)]
    for b in bins:
        for label in (0, 1):
            below[label] += rows.get((b, label), 0)
        wrong = below[1] / totals[1] + 1 - below[0] / totals[0]
        following = bins[bins.index(b) + 1] if b != bins[-1] else b + 1
        best.append((wrong, (b + 1 + following) / 2 * BIN))
    least = min(wrong for wrong, _ in best)
    good = [at for wrong, at in best if wrong <= least + 1e-12]
    return good[len(good) // 2]


def _held() -> Column:
    """Whether a URL is kept for the calibration: by a hash of it, so that copies are on one side."""
    return F.pmod(F.xxhash64("url"), F.lit(HELD_OUT)) == 0


def train(labelled: DataFrame) -> Model:
    """Counts of all rows of `url`, `label` (0 or 1) but the held-out ones, and the threshold found on those.

    Without labelled rows every score is 0. The driver gets one row per bin of scores and label.
    """
    counts = stored(count(labelled.where(~_held())), "counts")
    rest = scored(labelled.where(_held()).select("url", "label"), Model(counts))
    tally = rest.groupBy(F.floor(F.col("score") / BIN).alias("bin"), "label").count().collect()
    return Model(counts, calibrated([(r.bin, r.label, r["count"]) for r in tally]))


def recounted(model: Model, labelled: DataFrame) -> Model:
    """The model with the counts of the held-out rows added; the threshold stays."""
    return Model(stored(_summed(model.counts.union(count(labelled.where(_held())))), "counts"), model.threshold)


def judged(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """`page_id`, `host`, `path`, `rule`, `verdict`, `score` of every row of `page_id`, `url`.

    The rule's verdict holds where a rule fits; else a URL is allowed if its score reaches the
    threshold. The models are counted from all URLs that the rules decide. A null or empty URL has
    empty host and path, fits no rule and is allowed: nothing speaks against it. Repeated rows stay
    repeated, further columns are left out, an empty table gives no rows.
    """
    configure(pages.sparkSession)
    rule, verdict = matching_rule(rules)
    # The scores come from a Python pass that reads these columns only.
    known = pages.select("page_id", "url", host().alias("host"), path().alias("path"))
    known = known.withColumn("rule", rule).withColumn("ruled", verdict)
    label = (F.col("ruled") == "allow").cast("int").alias("label")
    labelled = known.where("rule IS NOT NULL").select("url", label)
    model = recounted(train(labelled), labelled)
    empty = F.coalesce(F.length("url"), F.lit(0)) == 0
    method = F.when(empty | (F.col("score") >= model.threshold), "allow").otherwise("block")
    return scored(known, model).select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "score"
    )


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages", "page_id", "url"))
