"""The pipeline stage by stage, and the registered queries on the smallest data."""

from __future__ import annotations

import pytest

import corpus_pipeline as cp
from telemetry_lake.llm.common import stored
from telemetry_lake.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in cp.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF), name)
        assert docs.columns == list(cp.COLUMNS)
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] > 0
    packed = cp.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.select("doc_id").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in cp.good_documents(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).collect()}
    good = [d for d, mark in labels.items() if mark]
    assert sum(d in kept for d in good) / len(good) > 0.99
    bad = [d for d, mark in labels.items() if not mark]
    assert sum(d not in kept for d in bad) / len(bad) > 0.9


def test_odd_rows_pass_through(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, "one two", "en", "a", 7), (2, "one two", "en", "a", 7)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, extra int"
    docs = spark.createDataFrame([(*r, 1) for r in rows], schema)
    for frame in (docs, docs.limit(0)):
        for name, stage in cp.STAGES:
            frame = stored(stage(spark, frame, SF), name)
        assert "doc_id" in frame.columns


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_registered_queries_give_rows(spark, name):
    operator = name.split("_")[0]
    table = {"op7": "embeddings", "op8": "pages", "op10": "pages", "op12": "embeddings"}.get(operator, "documents")
    source = spark.read.parquet(f"{SF}/{table}.parquet")
    rows = QUERIES[name](spark, SF).count()
    if operator == "op9":
        assert rows > 0
    elif operator == "op13":
        # Every source of a language has the language's other sources, and up to ten terms.
        groups = [r["count"] for r in source.select("lang", "source").distinct().groupBy("lang").count().collect()]
        pairs = sum(n * (n - 1) for n in groups)
        assert pairs < rows <= pairs + 10 * sum(groups)
    else:
        assert rows == source.count() * (32 if operator == "op12" else 1)


def test_sql_names_are_queries():
    assert set(SQL) <= set(QUERIES)
