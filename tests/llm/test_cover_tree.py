"""Cover trees against all pairs."""

from __future__ import annotations

import math

import numpy as np

from telemetry_lake.llm import cover_tree as ct
from tests.llm.test_simhash import plain_components


def clusters(seed, n, dim, spread=0.08):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(1, n // 8), dim))
    vectors = centres[rng.integers(0, len(centres), n)]
    vectors = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    return (vectors + rng.normal(size=(n, dim)) * spread / math.sqrt(dim) * rng.random((n, 1)) * 4) * rng.uniform(0.1, 9, (n, 1))


def all_pairs(a, b, cosine):
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b))
    return a @ b.T >= cosine


def tree(raw):
    return ct.build(raw, np.arange(len(raw)), np.ones(len(raw), np.int64))


def test_nested_levels_with_halving_radii():
    one = tree(clusters(1, 300, 8))
    units = one.units
    for level, (centres, radii) in enumerate(zip(one.centres[:-1], one.radii[:-1], strict=True)):
        if level:
            assert (radii <= 2 / 2**level + 1e-12).all()
            assert set(one.centres[level - 1]) <= set(centres)
    node = np.arange(len(units))
    for level in range(len(one.centres) - 1, 0, -1):
        node = one.parents[level][node]
        far = np.linalg.norm(units - units[one.centres[level - 1][node]], axis=1)
        assert (far <= one.radii[level - 1][node] + 1e-12).all()


def test_traversal_finds_exactly_all_pairs():
    for seed, n, m, dim in [(1, 200, 150, 8), (2, 1, 90, 3), (3, 60, 1, 64), (4, 120, 120, 2), (5, 300, 300, 64)]:
        a, b = clusters(seed, n, dim), clusters(seed, m, dim, 0.2)
        for cosine in (0.98, 0.9, 0.5, 1.0):
            assert (ct.traverse(tree(a), tree(b), cosine) == all_pairs(a, b, cosine)).all()
    same = np.repeat(clusters(6, 1, 5), 10, axis=0)
    assert ct.traverse(tree(same), tree(same * 3), 0.98).all()


def brute(rows, cosine=0.98):
    fine = {
        i: np.array(v, float)
        for i, (vec_id, v, label) in enumerate(rows)
        if vec_id is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    }
    links = []
    for i in fine:
        for j in fine:
            if i < j and rows[i][2] == rows[j][2] and len(fine[i]) == len(fine[j]):
                if fine[i] @ fine[j] / (np.linalg.norm(fine[i]) * np.linalg.norm(fine[j])) >= cosine:
                    links.append((i, j))
    counts = {i: sum(i in pair for pair in links) for i in range(len(rows))}
    ids = [r[0] for r in rows]
    parts = plain_components([(ids[i], ids[j]) for i, j in links], sorted({i for i in ids if i is not None}))
    return sorted(((ids[i], counts[i], parts.get(ids[i]), ids[i] is not None and parts[ids[i]] == ids[i]) for i in range(len(rows))), key=repr)


def run(spark, rows):
    schema = "vec_id long, embedding array<float>, label int, dim string, rep int"
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], schema).repartition(5)
    return sorted((tuple(r) for r in ct.near_duplicates(df).collect()), key=repr)


def test_queries_equal_brute_force(spark):
    vectors = clusters(7, 160, 16).astype(np.float32).tolist()
    rows = [(i * 3 % 163, v, i % 3) for i, v in enumerate(vectors)]
    rows += [(1000 + i, vectors[0], 0) for i in range(20)]
    rows += [(2000, None, 0), (2001, [], 0), (2002, [0.0] * 16, 0), (2003, [float("nan")] * 16, 0), (2004, vectors[0][:15] + [None], 0)]
    rows += [(2005, vectors[0], None), (2006, vectors[0][:3], 0), (2007, [float("inf")] + vectors[0][1:], 0), (None, vectors[0], 0)]
    assert run(spark, rows) == brute(rows)


def test_many_tiles_and_pivots(spark, monkeypatch):
    monkeypatch.setattr(ct, "TILE", 10)
    monkeypatch.setattr(ct, "PIVOTS", 4)
    rows = [(i, v, 0 if i % 4 else 1) for i, v in enumerate(clusters(8, 150, 12).astype(np.float32).tolist())]
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []
