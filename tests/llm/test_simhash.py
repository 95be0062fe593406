"""SimHash against a sequential version, and the tile comparison against all pairs."""

from __future__ import annotations

import random
import re

import numpy as np
import xxhash

from telemetry_lake.llm import simhash
from telemetry_lake.llm.components import connected_components


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << bit for bit in range(64) if sum(h >> bit & 1 for h in hashes) * 2 > len(hashes))


def plain_components(links, nodes):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def test_fingerprints_match_the_sequential_rule():
    for text in ["", " \t ", "one", "One two", "a b c", "A  b\tC\nd\x0be é É ß", "x " * 50, "\x1ca b c d"]:
        assert simhash.fingerprint_of(simhash.shingle_hashes(text)) % 2**64 == plain_fingerprint(text)


def test_near_duplicates_equal_all_pairs(spark):
    rng = random.Random(3)
    words = ["w%d" % i for i in range(400)]
    rows = []
    for i in range(120):
        text = [rng.choice(words) for _ in range(rng.choice([3, 40, 300]))]
        rows.append((len(rows) * 3, " ".join(text)))
        for _ in range(rng.choice([0, 0, 2])):
            text[rng.randrange(len(text))] = "changed"
            rows.append((len(rows) * 3, " ".join(text)))
    rows += [(10_000, None), (10_003, ""), (10_006, " "), (0, rows[0][1]), (None, rows[0][1]), (None, "only without id")]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, fp string, rep long")
    got = simhash.near_duplicates(docs.repartition(5)).collect()
    assert len(got) == len(rows)
    prints = {d: plain_fingerprint(t) for d, t in rows if d is not None}
    nodes = sorted(prints)
    links = [(a, b) for i, a in enumerate(nodes) for b in nodes[i + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 3]
    want = plain_components(links, nodes)
    assert sum(a != b for a, b in want.items()) > 10
    for row in got:
        if row.doc_id is not None:
            assert (row.fp % 2**64, row.component_id) == (prints[row.doc_id], want[row.doc_id])
    assert sorted((r.component_id is None) for r in got if r.doc_id is None) == [False, True]


def test_no_pair_of_fingerprints_is_missed(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**64, 300, np.uint64)
    prints = [base, np.array([0, 2**64 - 1, 7, 8], np.uint64)]
    for flips in (1, 2, 3, 4):
        near = base.copy()
        for _ in range(flips):
            near ^= np.uint64(1) << rng.integers(0, 64, len(base)).astype(np.uint64)
        prints.append(near)
    prints = np.unique(np.concatenate(prints))
    classes = spark.createDataFrame([(int(p.astype(np.int64)), i) for i, p in enumerate(prints)], "fp long, rep long")
    found = connected_components(simhash.links(classes)).collect()
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3
    want = plain_components(np.argwhere(np.triu(near, 1)).tolist(), range(len(prints)))
    assert {r.node: r.component for r in found} == {n: c for n, c in want.items() if near[n].sum() > 1}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).collect() == []


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (210, 200), (None, 3)]
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    want = {i: 0 for i in range(61)} | {100 + i: 100 for i in range(40)} | {200: 200, 210: 200}
    assert {r.node: r.component for r in got} == want and len(got) == len(want)
