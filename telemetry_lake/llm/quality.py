"""Operator 5: quality classifier by hierarchical empirical Bayes.

A logistic classifier reads simple counts off each whole text and gives a probability that the document
is good. The probabilities of all documents are then averaged per host and per path below it by grouped
aggregation, each mean shrunk towards the level above: paths towards their host, hosts towards all
documents. How strongly is estimated from the data by moments: the less the sites differ beyond what
their sizes explain, the more a small site is moved. A document's evidence is combined with the prior odds
of its path:

    odds(good | document, path) = odds(document) / odds(all) * odds(path)

In the `documents` table the host is `source` and the path below it `lang`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telemetry_lake.llm.common import configure, stored, table

# The classifier is fitted on some SAMPLE labelled rows, chosen by a hash of doc_id; everything else
# covers all rows.
SAMPLE = 20_000
RIDGE = 1.0
THRESHOLD = 0.5
# Site means are kept this far from 0 and 1, so that no site decides by itself.
PRIOR_RANGE = (0.2, 0.98)
# Bounds of the number of documents that the level above counts for.
STRENGTH = (1.0, 10_000.0)

# Counted as symbols: what prose seldom has.
_SYMBOLS = np.isin(np.arange(256), list(b"*%#$&|<>{}[]=_~^@+/\\"))
_UPPER = np.isin(np.arange(256), list(range(ord("A"), ord("Z") + 1)))
_DIGIT = np.isin(np.arange(256), list(b"0123456789"))
_MARKS = np.isin(np.arange(256), list(b"!?"))
_STOPS = np.isin(np.arange(256), list(b".,;:"))
_HIGH = np.arange(256) >= 128
_SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
GROUPS = np.stack([_SYMBOLS, _UPPER, _DIGIT, _MARKS, _STOPS, _HIGH, _SPACE], 1).astype(float)
FEATURES = GROUPS.shape[1] + 6


def features(text: bytes) -> list[float]:
    """Shares of kinds of characters, and of repetition, in one text; zeros for an empty one."""
    n = len(text)
    if not n:
        return [0.0] * FEATURES
    shares = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ GROUPS / n
    words, lines = text.split(), text.split(b"\n")
    count = max(1, len(words))
    pairs = set(zip(words, words[1:], strict=False))
    return [
        *np.sqrt(shares).tolist(),
        float(np.log1p(count)),
        len(text) / count / 10,
        len(set(words)) / count,
        (len(pairs) + 1) / count,
        len(set(lines)) / len(lines),
        min(1.0, shares[1] / max(1e-9, 1 - shares[1] - shares[0] - shares[2] - shares[6])),
    ]


@dataclass(frozen=True)
class Classifier:
    """Weights for standardised features; the last is the intercept."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def probability(self, rows: np.ndarray) -> np.ndarray:
        z = np.hstack([(rows - self.mean) / self.scale, np.ones((len(rows), 1))]) @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(rows: np.ndarray, labels: np.ndarray, ridge: float = RIDGE) -> Classifier:
    """Logistic regression with a ridge, by Newton's method. Without both labels all weights are 0 but the intercept."""
    rows = rows.reshape(-1, FEATURES)
    mean = rows.mean(axis=0) if len(rows) else np.zeros(FEATURES)
    scale = np.maximum(rows.std(axis=0), 1e-6) if len(rows) else np.ones(FEATURES)
    x = np.hstack([(rows - mean) / scale, np.ones((len(rows), 1))])
    weights = np.zeros(FEATURES + 1)
    if len(set(labels.tolist())) < 2:
        share = (labels.sum() + 1) / (len(labels) + 2)
        weights[-1] = np.log(share / (1 - share))
        return Classifier(mean, scale, weights)
    penalty = np.full(FEATURES + 1, ridge)
    penalty[-1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        gradient = x.T @ (labels - p) - penalty * weights
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, gradient)
        weights = weights + step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return Classifier(mean, scale, weights)


def _bytes(name: str = "text") -> Column:
    return F.encode(F.coalesce(name, F.lit("")), "UTF-8")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Classifier:
    """Fit on about `sample` of the labelled documents (all, if there are fewer).

    Labels of one doc_id are averaged; half and more counts as good. Null ids and labels are left out.
    The sampled labels, bounded by the parameter, are sent to the scan of the documents, and some
    numbers for each come back to the driver.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.avg("quality").alias("mark"))
    n = known.count()
    # The hash spreads evenly, so the limit on top of it only guards the bound.
    every = max(1, -(-n // sample))
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(every)) == 0).orderBy("doc_id").limit(2 * sample)

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = [features(text.as_py()) for text in part.column(1)]
            yield pa.record_batch([part.column(0), pa.array(found, pa.list_(pa.float64()))], ["mark", "features"])

    texts = docs.select("doc_id", _bytes().alias("text")).join(F.broadcast(chosen), "doc_id").select("mark", "text")
    rows = texts.mapInArrow(count, "mark double, features array<double>").toArrow()
    values = np.array(rows["features"].to_pylist(), float)
    return fit(values, (rows["mark"].to_numpy() >= 0.5).astype(float))


def scored(docs: DataFrame, classifier: Classifier, name: str = "evidence") -> DataFrame:
    """Every row with the classifier's probability of its `text`. Nothing is shuffled."""
    sent = docs.sparkSession.sparkContext.broadcast(classifier)
    names, at = docs.columns, docs.columns.index("text")

    def judge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = np.array([features((t.as_py() or "").encode()) for t in part.column(at)], float).reshape(-1, FEATURES)
            yield pa.record_batch([*part.columns, pa.array(sent.value.probability(found))], [*names, name])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(judge, f"{kinds}, `{name}` double")


def _strength(sites: DataFrame, level: str) -> float:
    """How many documents the level above counts for, by moments of the site means around it."""
    row = sites.agg(
        F.sum(F.col("n") * (F.col("good") / F.col("n") - F.col(level)) ** 2).alias("spread"),
        F.sum(F.col(level) * (1 - F.col(level))).alias("noise"),
        F.sum(F.col("n") * F.col(level) * (1 - F.col(level))).alias("most"),
        F.sum("n").alias("n"),
    ).first()
    if not row.n:
        return STRENGTH[1]
    between = max(0.0, row.spread - row.noise) / row.n
    within = row.most / row.n
    return float(np.clip(within / between - 1 if between else STRENGTH[1], *STRENGTH))


def site_priors(evidence: DataFrame) -> tuple[DataFrame, float]:
    """`host`, `path`, `prior` from `host`, `path`, `evidence` of all documents, and the overall share of good ones.

    Null hosts and paths are sites of their own.
    """
    paths = stored(evidence.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("evidence").alias("good")), "paths")
    total = paths.agg(F.sum("good").alias("good"), F.sum("n").alias("n")).first()
    share = (total.good + 1) / (total.n + 2) if total.n else 0.5
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).withColumn("all", F.lit(share))
    strength = _strength(hosts, "all")
    mean = (F.col("good") + strength * F.col("all")) / (F.col("n") + strength)
    hosts = hosts.select(F.col("host").alias("_host"), mean.alias("host_mean"))
    paths = stored(paths.join(hosts, F.col("host").eqNullSafe(F.col("_host"))).drop("_host"), "path_sums")
    strength = _strength(paths, "host_mean")
    prior = (F.col("good") + strength * F.col("host_mean")) / (F.col("n") + strength)
    bounded = F.least(F.greatest(prior, F.lit(PRIOR_RANGE[0])), F.lit(PRIOR_RANGE[1]))
    return stored(paths.select("host", "path", bounded.alias("prior")), "priors"), share


def judged(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """Every row of `docs` with `evidence`, `prior`, `quality_score` and `keep`; columns so named are replaced.

    `docs` has `doc_id`, `text` and the columns of host and path; `labels` has `doc_id`, `quality` (0 or 1).
    Null and empty texts have no evidence of being prose and are judged by all-zero features. Repeated
    rows are judged alike. Without labels every document has the evidence 1/2 and is kept. An
    empty table gives no rows.

    Texts are read three times and not shuffled while the priors, one row per path, are small enough for
    Spark to broadcast; beyond that the rows are joined by host and path, where Spark splits a hot site.
    """
    configure(docs.sparkSession)
    docs = docs.drop("evidence", "prior", "quality_score", "keep")
    classifier = train(docs, labels, sample)
    sites = docs.select(F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"), "text")
    priors, share = site_priors(scored(sites, classifier).select("host", "path", "evidence"))
    p = F.col("evidence")
    log_odds = F.log(p / (1 - p)) - float(np.log(share / (1 - share))) + F.log(F.col("prior") / (1 - F.col("prior")))
    score = 1 / (1 + F.exp(-log_odds))
    same = F.col(host).cast("string").eqNullSafe(priors["host"]) & F.col(path).cast("string").eqNullSafe(priors["path"])
    names = [F.col(f"`{name}`") for name in docs.columns]
    found = scored(docs, classifier).join(priors, same, "left")
    return found.select(*names, "evidence", "prior", score.alias("quality_score")).withColumn(
        "keep", F.col("quality_score") >= THRESHOLD
    )


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    labels = table(spark, sf_dir, "labels", "doc_id", "quality")
    return judged(docs, labels).drop("text")
