"""Distances between sources against the SQL, and the scattered sums against a plain double loop."""

from __future__ import annotations

import random
import re

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from telemetry_lake.llm import divergence as dv
from tests.llm.conftest import DOCUMENTS

RNG = random.Random(13)
COLUMNS = [field.split()[0] for field in DOCUMENTS.split(", ")]


def documents(n, langs=("en", "fr", None), sources=9, words=60):
    vocabulary = ["w" + "abcdefghij"[k % 10] * (k // 10 + 1) for k in range(words)] + ["É", "é", "İ", "漢字", "🙂"]
    rows = []
    for k in range(n):
        source = RNG.randrange(sources)
        text = " ".join(RNG.choice(vocabulary[source : source + 40]).title() + RNG.choice(["", ".", "1", "'", "_"]) for _ in range(RNG.randrange(30)))
        rows.append((k, text, RNG.choice(langs), RNG.choice(["s%d" % source, "S%d" % source, None]), len(text)))
    return rows


def sql(rows):
    database = duckdb.connect()
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
    columns = list(zip(*rows, strict=True)) or [[]] * 5
    database.register("documents", pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=COLUMNS))
    return sorted(database.execute(dv.OP13_SQL).fetchall())


def run(spark, rows):
    return sorted(map(tuple, dv.divergence(spark.createDataFrame(rows, DOCUMENTS).repartition(4)).collect()))


def test_equals_the_sql(spark):
    rows = documents(700)
    found = run(spark, rows)
    assert found == sql(rows) and {r[2] for r in found} == {"pair", "term"}


def test_blocks_and_slices(spark, monkeypatch):
    monkeypatch.setattr(dv, "BLOCK", 3)
    monkeypatch.setattr(dv, "SLICE_ROWS", 50)
    rows = documents(500, sources=5)
    assert run(spark, rows) == sql(rows)


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (1, "", "de", "a", 0), (1, "", "de", "a", 0), (2, "1 2 3", "de", "b", 5)]
    # Nothing is kept: groups are 0 apart. A language of one source has no pairs.
    assert run(spark, rows) == [("de", "a", "pair", "b", 0, 1), ("de", "b", "pair", "a", 0, 1)] == sql(rows)
    rows += [(k, "tie Tie eit", "xx", source, 0) for k in range(12) for source in ("a", "b", None)]
    rows += [(k, "more more", "xx", "c", 0) for k in range(3)] + [(None, "tie", "xx", "no kept words here", 0)] * 2
    assert run(spark, rows) == sql(rows)
    assert run(spark, []) == []


def test_one_group_with_most_rows_and_a_very_long_text(spark):
    rows = documents(60, langs=("en",)) + [(1000 + k, "hot word %s" % ("z" * (k % 40 + 1)), "en", "hot", 0) for k in range(600)]
    rows.append((5000, "long tail of words " * 100_000, "en", "hot", 0))
    assert run(spark, rows) == sql(rows)


def test_columns_of_the_operator_itself(spark):
    rows = spark.createDataFrame(documents(200), DOCUMENTS)
    clashing = rows.select("*", *[F.lit(1).alias(n) for n in ("g", "h", "n", "term", "value", "rank", "part", "item", "slice")])
    assert sorted(map(tuple, dv.divergence(clashing).collect())) == sorted(map(tuple, dv.divergence(rows).collect()))


def test_terms_are_runs_of_letters_and_characters_beyond_ascii():
    text = "One\x00two-Three_é É x 漢1字 don't\x7f@[`{z"
    want = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)
    lower = {k: k + 32 for k in range(ord("A"), ord("Z") + 1)}
    assert [t.decode() for t in dv.terms(text.encode())] == [w.translate(lower) for w in want]


def test_scattered_sums_are_those_over_all_terms():
    rng = np.random.default_rng(3)
    terms = 40
    shares = rng.integers(2, 10**9, (2, 6, terms))
    has = rng.random((2, 6, terms)) < 0.4
    zeros = rng.integers(1, 10**6, (2, 6))
    sides = []
    for side in (0, 1):
        group, term = np.nonzero(has[side])
        mixed = rng.permutation(len(group))
        sides.append((group[mixed], term[mixed], shares[side][group, term][mixed]))
    sums = dv.scattered(sides[0], sides[1], (zeros[0], zeros[1]), terms)
    for g in range(6):
        for h in range(6):
            total = 0
            for t in range(terms):
                p = int(shares[0, g, t]) if has[0, g, t] else int(zeros[0, g])
                q = int(shares[1, h, t]) if has[1, h, t] else int(zeros[1, h])
                total += (p - q) ** 2 // (p + q)
            absent = terms - has[0, g].sum() - has[1, h].sum()
            p, q = int(zeros[0, g]), int(zeros[1, h])
            assert sums[g, h] + absent * ((p - q) ** 2 // (p + q)) == total


def test_shares_and_distances_are_exact(spark):
    cases = [(0, 0, 0), (0, 5, 3), (10**12, 3 * 10**12, 10**7), (7, 10**15, 1), (999_999_999, 10**9, 12345)]
    for n, words, terms in cases:
        row = spark.range(1).select(dv.share(F.lit(n).cast("long"), F.lit(words).cast("long"), F.lit(terms).cast("long")).alias("p")).first()
        assert row.p == 1 + 10**9 * (n + 2) // max(1, words + 2 * terms) or (words == terms == 0)
    for p, q in [(1, 10**9 + 1), (10**9, 3), (5, 5), (123456789, 987654321)]:
        row = spark.range(1).select(dv.distance(F.lit(p).cast("long"), F.lit(q).cast("long")).alias("f")).first()
        assert row.f == (p - q) ** 2 // (p + q)
