"""Threshold sketches against plain sets, and the edited texts against a sequential version."""

from __future__ import annotations

import hashlib
import random

import numpy as np

from telemetry_lake.llm import fingerprints as fp
from telemetry_lake.llm.words import shingles, word_hashes

RNG = random.Random(2)
VOCABULARY = ["word%d" % i for i in range(500)]


def prose(n):
    return " ".join(RNG.choice(VOCABULARY) for _ in range(n))


def test_word_hashes_depend_on_the_word_alone():
    a, b = word_hashes("One two\tTHREE  two"), word_hashes("\n  three two ONE")
    assert a[0] == b[2] and a[1] == a[3] == b[1] and a[2] == b[0] and len(set(a.tolist())) == 3
    assert len(word_hashes(" \n")) == 0 and len(shingles(word_hashes("a b"), 5)) == 1


def test_sketches_estimate_and_merge():
    a, b = prose(3000), prose(200)
    both = a + " " + b
    sa, sb, sab = fp.sketch(a), fp.sketch(b), fp.sketch(both)
    every = np.unique(shingles(word_hashes(a), 5))
    assert set(sa) == {h for h in every.tolist() if h < fp.threshold()}
    assert fp.containment(sb, sab) > 0.9 and fp.containment(sa, sab) == 1 and fp.likeness(sa, sb) < 0.05
    merged = fp.merge(sa, sb)
    assert set(merged) <= set(sab) and (fp.merge(sb, sa) == merged).all()
    assert len(fp.sketch("one word")) == 1 and len(fp.sketch("")) == 0
    # A hash above the threshold is held only while there is no other.
    tiny = next(s for s in (fp.sketch(w) for w in VOCABULARY) if s[0] >= fp.threshold())
    assert (fp.merge(tiny, sa) == sa).all()
    assert (fp.from_text(fp.as_text(sa)) == sa).all()
    assert fp.likeness(fp.sketch(""), fp.sketch(" ")) == 1 and fp.likeness(fp.sketch(""), sa) == 0


def plain(rows):
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), [-ord(c) for c in r[1] or ""]))
    for k, (doc_id, text) in enumerate(ordered):
        text, after = text or "", ordered[(k + 1) % len(ordered)][1] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        a, b, c = (fp.sketch(t) for t in (text, edited, after))
        yield (doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), fp.as_text(a), fp.as_text(b), fp.likeness(a, b), fp.likeness(a, c))


def check(spark, rows, parts):
    docs = spark.createDataFrame([(1, t, d) for d, t in rows], "place int, text string, doc_id long").repartition(parts)
    got = [tuple(r)[:7] for r in fp.compared_with_edits(docs).collect()]
    assert sorted(got, key=repr) == sorted(plain(rows), key=repr)


def test_edits_follow_the_order(spark):
    rows = [(i * 37 % 211 - 50, RNG.choice([prose(60), prose(3), "é漢🙂" * 9, "", None])) for i in range(200)]
    check(spark, rows, 7)
    check(spark, [(5, prose(30))], 1)
    check(spark, [(i, prose(20)) for i in range(3)], 2)


def test_null_and_repeated_ids(spark):
    check(spark, [(1, prose(40)), (None, prose(40)), (2, "b"), (2, "a"), (-7, prose(9))], 3)
    twice = [(4, "one two three four five six seven"), (4, "one two three four five six seven"), (1, prose(30))]
    check(spark, twice, 2)
    assert fp.compared_with_edits(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert fp.fingerprints(spark.createDataFrame([(None, None)], "doc_id long, text string")).collect()[0].n_chars == 0
