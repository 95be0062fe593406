"""Whitening against numpy on the whole matrix."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from telemetry_lake.llm import whitening as wh

KIND = "vec_id long, embedding array<float>, label int"


def vectors(n, dim, seed=0):
    rng = np.random.default_rng(seed)
    mixed = rng.normal(size=(n, dim)) @ rng.normal(size=(dim, dim)) * 0.3 + rng.normal(size=dim)
    return [(k, v.tolist(), 0) for k, v in enumerate(mixed.astype(np.float32))]


def plain(rows, components=32):
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v, _ in rows], np.int64)
    n, sums = len(x), x.sum(axis=0)
    centred = (n * x - sums) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:components]
    return values[order], values.sum(), axes[:, order], centred @ axes[:, order] / np.sqrt(values[order]), ((n * x - sums) ** 2).sum(axis=1)


def compare(spark, rows, components=32, fit=None):
    fit = rows if fit is None else fit
    found = wh.whitened(spark.createDataFrame(rows, KIND).repartition(3), components).toPandas()
    values, trace, _, projected, deviations = plain(fit, components)
    wide = found.pivot(index="vec_id", columns="component", values="whitened").loc[[r[0] for r in fit]].to_numpy()
    signs = np.sign((wide * projected).sum(axis=0))
    assert np.abs(wide * signs - projected).max() < 1e-7
    once = found.drop_duplicates("vec_id").set_index("vec_id").loc[[r[0] for r in fit]]
    assert once["deviation"].tolist() == deviations.tolist()
    shares = found.drop_duplicates("component").sort_values("component")
    assert shares["component"].tolist() == list(range(1, len(values) + 1))
    assert np.abs(shares["explained"] / (values / trace) - 1).max() < 1e-9
    assert set(found["n"]) == {len(fit)} and found["identity_error"].nunique() == 1
    assert abs(np.cov(wide.T, bias=True) - np.eye(len(values))).max() < 1e-7 and found["identity_error"].iloc[0] < 1e-7
    assert len(found) == len(fit) * len(values)


def test_components_of_all_rows(spark):
    compare(spark, vectors(300, 6))
    compare(spark, vectors(200, 40, seed=2))
    compare(spark, vectors(200, 5, seed=3), components=2)


def test_several_blocks_and_slices(spark, monkeypatch):
    monkeypatch.setattr(wh, "BLOCK_ROWS", 16)
    monkeypatch.setattr(wh, "MULTIPLIED", 2)
    compare(spark, vectors(333, 7, seed=4))


def test_rows_that_are_not_fit(spark):
    good = vectors(120, 4, seed=5)
    bad = [(1000, None, 1), (1001, [], 1), (1002, [0.1, None, 0.2, 0.3], 1), (1003, [float("nan")] * 4, 1)]
    bad += [(1004, [0.1, 0.2, float("inf"), 0.0], None), (1005, [1.0, 2.0], 0), (1006, [-float("inf")] * 4, 0)]
    compare(spark, good + bad, fit=good)


def test_null_and_repeated_ids_and_equal_vectors(spark):
    rows = vectors(60, 3, seed=6)
    rows += [(None, rows[0][1], 0), (7, rows[7][1], 0), (7, rows[8][1], None)]
    found = wh.whitened(spark.createDataFrame(rows, KIND)).toPandas()
    assert len(found) == 3 * len(rows) and found["vec_id"].isna().sum() == 3 and (found["vec_id"] == 7).sum() == 9
    of_null = found[found["vec_id"].isna()].sort_values("component")["whitened"].to_numpy()
    assert np.abs(of_null - found[found["vec_id"] == 0].sort_values("component")["whitened"].to_numpy()).max() < 1e-12


def test_without_variance(spark):
    same = [(k, [0.5, 0.25], 0) for k in range(10)]
    assert wh.whitened(spark.createDataFrame(same, KIND)).collect() == []
    assert wh.whitened(spark.createDataFrame(same[:1], KIND)).collect() == []
    empty = wh.whitened(spark.createDataFrame([], KIND))
    assert empty.collect() == [] and empty.columns == [f.split()[0] for f in wh.SCHEMA.split(", ")]
    # A constant dimension, and one that is twice another, leave two components of four.
    rng = np.random.default_rng(8)
    whole = rng.integers(-50, 50, (80, 2))
    rows = [(k, [a / 64, a / 32, 1.0, b / 64], 0) for k, (a, b) in enumerate(whole.tolist())]
    found = wh.whitened(spark.createDataFrame(rows, KIND)).toPandas()
    assert set(found["component"]) == {1, 2} and abs(found.drop_duplicates("component")["explained"].sum() - 1) < 1e-12


def test_columns_of_the_operator_itself(spark):
    rows = spark.createDataFrame(vectors(50, 3, seed=9), KIND)
    clashing = rows.select("*", *[F.lit("x").alias(n) for n in ("x", "row", "values", "mark", "width", "n", "component")])
    assert wh.whitened(clashing).count() == 150 and wh.whitened(clashing).columns == wh.whitened(rows).columns


def test_row_numbers_have_no_gaps(spark):
    rows = spark.range(1000).repartition(7).select(
        F.col("id").alias("vec_id"), F.array("id").alias("x"), F.monotonically_increasing_id().alias("mark")
    )
    found = wh.numbered(wh.stored(rows, "numbers"))
    assert sorted(r.row for r in found.collect()) == list(range(1000))


def test_deviation_beyond_a_long_is_null(spark):
    row = spark.range(1).select(wh.deviation(F.array(F.lit(4_000_000_000).cast("long")), 1, [0]).alias("d")).first()
    assert row.d is None


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query_on_the_given_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    values, trace, _, projected, deviations = plain(rows)
    found = wh.op12_whitening(spark, f"/root/testdata/{sf}").toPandas()
    wide = found.pivot(index="vec_id", columns="component", values="whitened").loc[[r[0] for r in rows]].to_numpy()
    assert np.abs(wide * np.sign((wide * projected).sum(axis=0)) - projected).max() < 1e-8
    assert found["identity_error"].max() < 1e-8
