"""Quality classifier: held-out accuracy, and the site priors against plain arithmetic."""

from __future__ import annotations

import random

import numpy as np
import pytest

from telemetry_lake.llm import quality as q

RNG = random.Random(6)


def prose():
    return ". ".join(" ".join("".join(RNG.choice("aeionrst") for _ in range(RNG.randint(2, 9))) for _ in range(12)) for _ in range(6))


def junk():
    words = prose().split()
    return RNG.choice([lambda: " | ".join(words), lambda: "### ".join(words), lambda: "!! ".join(words).upper()])()


def corpus(n=400):
    rows = []
    for i in range(n):
        good = RNG.random() < 0.7
        rows.append((i, prose() if good else junk(), RNG.choice(["en", "de", None]), f"src{i % 5}", good))
    return rows


DOCS = "doc_id long, text string, lang string, source string, good boolean"


def test_held_out_documents(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(r[0], int(r[4]), 0) for r in rows[:200]], "doc_id long, quality int, toxic int")
    got = q.judged(docs, labels).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.doc_id >= 200]
    assert sum(r.keep == r.good for r in held) / len(held) > 0.97
    assert all(r.keep for r in held if r.good)


def test_priors_shrink_towards_the_level_above(spark):
    rng = np.random.default_rng(3)
    rows = []
    for host, share, n in [("a", 0.9, 800), ("b", 0.4, 800), ("tiny", 0.0, 2), (None, 0.7, 50)]:
        rows += [(host, f"p{k % 3}", float(rng.random() < share)) for k in range(n)]
    evidence = spark.createDataFrame(rows, "host string, path string, evidence double")
    priors, share = q.site_priors(evidence)
    got = {(r.host, r.path): r.prior for r in priors.collect()}
    assert len(got) == 11 and share == pytest.approx((sum(r[2] for r in rows) + 1) / (len(rows) + 2))
    mean = lambda host, path: np.mean([r[2] for r in rows if r[0] == host and r[1] == path])
    assert got["a", "p0"] == pytest.approx(mean("a", "p0"), abs=0.05)
    assert got["b", "p1"] == pytest.approx(mean("b", "p1"), abs=0.05)
    # Two documents hardly move their site from what all sites have.
    assert got["tiny", "p0"] > 0.25 > mean("tiny", "p0")


def test_strength_by_moments(spark):
    rows = [("x", 100, 50.0, 0.5), ("y", 100, 50.0, 0.5)]
    alike = spark.createDataFrame(rows, "host string, n long, good double, all double")
    assert q._strength(alike, "all") == q.STRENGTH[1]
    apart = spark.createDataFrame([("x", 100, 100.0, 0.5), ("y", 100, 0.0, 0.5)], alike.schema)
    assert q._strength(apart, "all") == q.STRENGTH[0]


def test_logistic_fit():
    rng = np.random.default_rng(2)
    rows = rng.normal(size=(4000, q.FEATURES))
    labels = (rng.random(4000) < 1 / (1 + np.exp(-(2 * rows[:, 0] - rows[:, 3] + 0.5)))).astype(float)
    found = q.fit(rows, labels)
    weights = found.weights[:-1] / found.scale
    assert weights[0] == pytest.approx(2, abs=0.2) and weights[3] == pytest.approx(-1, abs=0.2) and abs(weights[5]) < 0.15
    one = q.fit(rows[:5], np.ones(5))
    assert one.probability(rows[:3]) == pytest.approx(6 / 7)
    assert q.fit(np.zeros((0, q.FEATURES)), np.zeros(0)).probability(rows[:1])[0] == 0.5


def test_nulls_ties_and_no_labels(spark):
    rows = [(None, None, None, None, True), (1, "", "en", "a", True), (1, "", "en", "a", True), (2, "x " * 30_000, "en", "a", True)]
    docs = spark.createDataFrame(rows, DOCS.replace("good", "keep"))
    none = spark.createDataFrame([(None, None), (1, None), (None, 1)], "doc_id long, quality int")
    got = q.judged(docs, none).collect()
    assert len(got) == 4 and all(r.keep and r.evidence == 0.5 for r in got)
    assert q.judged(docs.limit(0), none).collect() == []


def test_features_of_odd_texts():
    for text in (b"", b" ", b"\n\n", b"a", "é漢🙂".encode(), b"|||"):
        assert len(q.features(text)) == q.FEATURES and np.isfinite(q.features(text)).all()
