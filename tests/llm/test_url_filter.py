"""Rules, character models and calibration of the URL filter against plain Python."""

from __future__ import annotations

import math
import random

import pytest

from telemetry_lake.llm import url_filter as uf

URLS = [
    "http://a.com/x", "https://WWW.Example.COM/en/1", "http://example.com/en/1?q=/en/", "http://blog.example.com/en/2#top",
    "http://example.com/eng", "http://example.com/en", "http://notexample.com/en/1", "http://b.net/es/1", "http://b.net/fr",
    "http://b.net/fr/9", "http://net/fr/9", "http://x.org/de/1", "no scheme", "http://", "http://com", "http://com/", None,
    "", "ftp://h.org?x://y", "a/b?u=http://q.com/z", "http://u:p@s.com:80/p", "http://ÄB.com/ä", "http://z.com\n/p",
]


def plain(url):
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    return host, path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]


def plain_rule(host, path, rules=uf.RULES):
    fits = [r for r in rules if ("." + host).endswith("." + r[0].partition("/")[0]) and path.startswith("/" + r[0].partition("/")[2])]
    return max(fits, key=lambda r: len(r[0]), default=(None, None))


def test_host_path_and_rule(spark):
    rows = [(i, u, "x") for i, u in enumerate(URLS * 4)]
    got = uf.judged(spark.createDataFrame(rows, "page_id long, url string, host string")).collect()
    assert len(got) == len(rows)
    for row in got:
        host, path = plain(URLS[row.page_id % len(URLS)])
        rule, verdict = plain_rule(host, path)
        assert (row.host, row.path, row.rule) == (host, path, rule)
        assert row.verdict in (("allow", "block") if verdict is None else (verdict,))
        if not URLS[row.page_id % len(URLS)]:
            assert row.verdict == "allow"


def test_scores_equal_a_sequential_model(spark):
    labelled = [("http://good.example/%d" % i, 1) for i in range(30)] + [("http://bad.test/%d/x" % i, 0) for i in range(30)]
    model = uf.train(spark.createDataFrame(labelled, "url string, label int"))
    held = {r.url for r in spark.createDataFrame(labelled, "url string, label int").where("pmod(xxhash64(url), 5) = 0").collect()}
    counts = {0: {}, 1: {}}
    for url, label in labelled:
        if url not in held:
            for k in range(len(url)):
                for order in range(uf.ORDER + 1):
                    context = ("\0" * uf.ORDER + url)[k + uf.ORDER - order : k + uf.ORDER]
                    for key in ((order, context), (order, context, url[k])):
                        counts[label][key] = counts[label].get(key, 0) + 1

    def log_likelihood(url, label):
        total = 0.0
        for k, c in enumerate(url):
            p = 1 / 256
            for order in range(uf.ORDER + 1):
                context = ("\0" * uf.ORDER + url)[k + uf.ORDER - order : k + uf.ORDER]
                n = counts[label].get((order, context), 0)
                p = (counts[label].get((order, context, c), 0) + uf.WEIGHT * p) / (n + uf.WEIGHT)
            total += math.log(p)
        return total

    for url in ["http://good.example/7", "http://bad.test/77/x", "zzz", "h"]:
        want = (log_likelihood(url, 1) - log_likelihood(url, 0)) / len(url)
        assert model.score(url) == pytest.approx(want, abs=1e-9)
    assert model.score("") == 0.0
    assert model.score("http://good.example/99") > model.threshold > model.score("http://bad.test/99/x")


def test_counts_are_exact_beyond_any_fixed_table(spark):
    rng = random.Random(6)
    urls = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(30)) for _ in range(12_000)]
    want: dict = {}
    for url in urls:
        padded = [0] * uf.ORDER + [1 + ord(c) for c in url]
        for k in range(len(url)):
            gram = 0
            for c in padded[k : k + uf.ORDER + 1]:
                gram = gram << uf.BITS | c
            want[gram] = want.get(gram, 0) + 1
    got = uf.count(spark.createDataFrame([(u, 1) for u in urls], "url string, label int")).toArrow()
    assert len(want) > 300_000
    assert dict(zip(got["gram"].to_pylist(), got["n1"].to_pylist(), strict=True)) == want
    assert sum(got["n0"].to_pylist()) == 0


def test_held_out_urls_count_once_the_threshold_is_set(spark):
    labelled = spark.createDataFrame([(f"http://a.example/{i}", i % 2) for i in range(40)], "url string, label int")
    model = uf.train(labelled)
    full = uf.recounted(model, labelled)
    total = lambda m: m.counts.selectExpr("sum(n0 + n1)").first()[0]
    held = labelled.where("pmod(xxhash64(url), 5) = 0").selectExpr("sum(length(url))").first()[0]
    assert held > 0 and total(full) == total(model) + held and full.threshold == model.threshold


def test_blocks_score_as_one(spark, monkeypatch):
    labelled = spark.createDataFrame([(f"http://a.example/{i}", i % 2) for i in range(40)], "url string, label int")
    model = uf.Model(uf.count(labelled))
    urls = spark.createDataFrame([(f"http://b.example/{i % 9}{'x' * (i % 50)}" if i % 7 else None,) for i in range(60)], "url string")
    once = sorted((r.url or "", r.score) for r in uf.scored(urls, model).collect())
    monkeypatch.setattr(uf, "BLOCK", 30)
    assert sorted((r.url or "", r.score) for r in uf.scored(urls, model).collect()) == once and len(once) == 60


def test_held_out_urls_are_told_apart(spark):
    rng = random.Random(4)
    rows = []
    for i in range(600):
        good = rng.random() < 0.5
        name = "".join(rng.choice("aeioulmn" if good else "xzqkwj") for _ in range(8))
        rows.append((i, f"http://{name}.{'com' if rng.random() < 0.5 else 'org'}/{'a' if good else 'es'}/{rng.randrange(999)}", good))
    rules = (("com/a/", "allow"), ("com/es/", "block"))
    got = uf.judged(spark.createDataFrame(rows, "page_id long, url string, good boolean"), rules).where("rule IS NULL").collect()
    right = sum((r.verdict == "allow") == rows[r.page_id][2] for r in got)
    assert len(got) > 200 and right / len(got) > 0.97


def test_calibration():
    assert uf.calibrated([(-5, 0, 10), (-4, 0, 5), (3, 1, 10)]) == pytest.approx(0.0, abs=0.01)
    assert uf.calibrated([(0, 0, 9), (0, 1, 1), (1, 1, 9)]) == pytest.approx(0.01)
    assert uf.calibrated([(3, 1, 5)]) == 0.0 and uf.calibrated([]) == 0.0


def test_empty_table(spark):
    assert uf.judged(spark.createDataFrame([], "page_id long, url string")).collect() == []
