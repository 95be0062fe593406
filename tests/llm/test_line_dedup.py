"""Shared lines against a sequential version, and the query against its SQL."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from telemetry_lake.llm import line_dedup as ld
from tests.llm.conftest import DOCUMENTS

RNG = random.Random(11)
SPACE = " \t\n\v\f\r"
LOWER = {k: k + 32 for k in range(ord("A"), ord("Z") + 1)}


def key_of(line):
    return line.strip(SPACE).translate(LOWER)


def plain(rows, min_docs=10, min_chars=1, keep_first=False):
    """Rows that repeat id and text are one document; the first line is that of the least (null first) document."""
    where = defaultdict(set)
    for doc_id, text in rows:
        for pos, line in enumerate((text or "").split("\n")):
            if len(key_of(line)) >= min_chars:
                where[key_of(line)].add((doc_id, text or "", pos))
    shared = {k for k, places in where.items() if len({p[:2] for p in places}) >= min_docs}
    first = {k: min(where[k], key=lambda p: (p[0] is not None, p[0] or 0, p[2])) for k in shared} if keep_first else {}
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [
            line
            for pos, line in enumerate(lines)
            if key_of(line) not in shared or first.get(key_of(line)) == (doc_id, text or "", pos)
        ]
        yield doc_id, "\n".join(kept), len(lines), len(lines) - len(kept)


def run(spark, rows, **options):
    docs = spark.createDataFrame([(t, d) for d, t in rows], "text string, doc_id long").repartition(5)
    found = ld.deduplicated(docs, **options).select("doc_id", "text", "n_lines", "n_dropped")
    return sorted(map(tuple, found.collect()), key=repr)


def documents(n):
    shared = ["Sign in", " sign IN\t", "Ünïcode Änd", "\x0bcookies\f", "©", "Äb", "äb", "sign in "]
    own = ["line %d" % k for k in range(40)]
    for i in range(n):
        yield i, "\n".join(RNG.choice([RNG.choice(shared), RNG.choice(own), "", "  ", "only %d" % i]) for _ in range(RNG.randrange(9)))


def test_lines_of_many_documents_go(spark):
    rows = list(documents(150))
    assert run(spark, rows) == sorted(plain(rows), key=repr)
    assert run(spark, rows, min_docs=3, min_chars=5) == sorted(plain(rows, 3, 5), key=repr)
    assert sum(r[3] for r in plain(rows)) > 100


def test_the_first_line_may_stay(spark):
    rows = list(documents(80))
    assert run(spark, rows, min_docs=2, keep_first=True) == sorted(plain(rows, 2, keep_first=True), key=repr)


def test_lower_case_is_ascii_only_and_space_is_six_characters(spark):
    lines = ["É", "é", "K", "k", "K", " x", "x", "　x", "İ", "ß", "ẞ"]
    rows = [(i, line) for i, line in enumerate(lines * 5)]
    assert run(spark, rows) == sorted(plain(rows), key=repr)


def test_one_line_with_a_third_of_all_lines(spark):
    rows = [(i, "\n".join(["hot"] * 300 + ["a%d" % i] * 200 + ["b", "c%d" % (i % 30)] * 200)) for i in range(60)]
    assert run(spark, rows) == sorted(plain(rows), key=repr)


def test_odd_rows(spark):
    rows = [(None, None), (None, ""), (1, ""), (1, None), (2, "\n"), (2, "\n\n"), (None, "x"), (3, "x"), (3, "x"), (3, "x\nx")]
    rows += [(k, "x\n \nkeep") for k in range(4, 12)]
    assert run(spark, rows) == sorted(plain(rows), key=repr)
    # Repeated rows are one document: nine of them share the line.
    rows = [(k, "y") for k in range(9)] + [(0, "y")] * 5
    assert run(spark, rows) == sorted(plain(rows), key=repr) and plain(rows).__next__()[3] == 0
    assert run(spark, []) == []


def test_very_long_text(spark):
    long = "\n".join("shared" if k % 7 == 0 else "own %d" % k for k in range(100_000))
    rows = [(0, long), (1, "x" * 500_000), *[(k, "shared\nz") for k in range(2, 12)]]
    assert run(spark, rows) == sorted(plain(rows), key=repr)


def test_columns_of_the_operator_itself(spark):
    names = ["h1", "h2", "t1", "t2", "pos", "slice", "lines", "first", "keep", "n_lines", "n_dropped", "a b", "_0"]
    docs = spark.range(12).select(
        F.col("id").alias("doc_id"), F.lit("s\nt").alias("text"), *[F.lit(k).alias(n) for k, n in enumerate(names)]
    )
    found = ld.deduplicated(docs)
    replaced = {"keep", "n_lines", "n_dropped"}
    assert found.columns == ["doc_id", "text", "n_lines", "n_dropped", "keep", *[n for n in names if n not in replaced]]
    row = found.first().asDict()
    assert (row["text"], row["n_lines"], row["n_dropped"]) == ("", 2, 2)
    assert all(row[n] == k for k, n in enumerate(names) if n not in replaced)


def test_bitmaps_name_only_words_that_lose_lines(spark):
    rows = [(k, "\n".join(["own %d %d" % (k, i) for i in range(200)] + ["same"] + ["end %d" % k])) for k in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = ld.keep_bitmaps(docs).collect()
    assert len(found) == 10
    for row in found:
        assert row.n_dropped == 1 and [(e.word, ~e.bits) for e in row["keep"]] == [(3, 1 << (200 - 192))]


def test_no_python_on_the_way(spark):
    docs = spark.createDataFrame([(k, "a\nb%d" % k, "en", "s", 3) for k in range(12)], DOCUMENTS)
    plan = ld.deduplicated(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_query_equals_its_sql(spark, tmp_path):
    rows = [(d, t, "en", "s", len(t or "")) for d, t in [*documents(120), (500, None), (501, "")]]
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    found = ld.op11_line_dedup(spark, str(tmp_path))
    database = duckdb.connect()
    database.register("documents", pa.table(dict(zip(["doc_id", "text"], zip(*[r[:2] for r in rows], strict=True), strict=True))))
    want = database.execute(ld.OP11_SQL)
    assert [c[0] for c in want.description] == found.columns
    want = sorted(want.fetchall())
    assert sorted(map(tuple, found.collect())) == want
    by_hand = {(d, n, g, hashlib.sha256(t.encode()).hexdigest()) for d, t, n, g in plain([r[:2] for r in rows])}
    assert set(want) == by_hand
