"""Substring deduplication: keys, bands and verification against plain Python, and planted passages."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from telemetry_lake.llm import substring as ss
from telemetry_lake.llm.words import shingles, word_hashes

RNG = random.Random(9)
VOCABULARY = ["w%d" % i for i in range(3000)]


def prose(n):
    return " ".join(RNG.choice(VOCABULARY) for _ in range(n))


def test_bands_are_tuned_for_recall():
    bands, rows = ss.tuned_bands(0.8, 0.99)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.99 and 1 - (1 - 0.8 ** (rows + 1)) ** 8 < 0.99
    assert (ss.BANDS, ss.ROWS) == (bands, rows)


def test_lines_and_their_keys():
    line = prose(30)
    doc = ss.Document(f"short\n{line}\n  {line.upper()}  \n{prose(19)}\n{line} more".encode())
    keys = doc.line_keys()
    assert len(keys) == 3 and keys[0] == keys[1] != keys[2]
    assert (doc.bands()[0] == doc.bands()[1]).all() and doc.bands().shape == (3, ss.BANDS)
    assert set(doc.line_grams(0).tolist()) == set(shingles(word_hashes(line), 5).tolist())
    assert len(ss.Document(b"").line_keys()) == 0 and len(ss.Document(b"a\n\nb").bands()) == 0


def test_bands_collide_as_often_as_tuned():
    hits = 0
    for _ in range(200):
        words = prose(104).split()
        changed = [*words]
        for k in (10, 60):  # two words change 10 of 100 shingles: similarity 90 / 110
            changed[k] = "other"
        a, b = (ss.Document(" ".join(w).encode()).bands()[0] for w in (words, changed))
        hits += bool((a == b).any())
    assert hits >= 190


def test_any_shared_passage_has_a_common_run():
    for _ in range(100):
        passage = prose(ss.WORDS + ss.GAP - 1)
        a, b = (ss.Document(f"{prose(RNG.randrange(60))} {passage} {prose(RNG.randrange(60))}".encode()) for _ in range(2))
        assert set(a.runs()[1].tolist()) & set(b.runs()[1].tolist())
    assert len(ss.Document(("of " * 5000).encode()).runs()[0]) <= 2
    assert len(ss.Document(b"few words").runs()[0]) == 0


def test_jaccard_is_exact(monkeypatch):
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50))) for _ in range(40)]
    sets += [np.arange(20_000), np.arange(18_000), np.arange(100, 20_100)]
    for similarity in (0.3, 0.8, 1.0):
        hit = ss.jaccard_hits(sets[:20], sets, similarity)
        for i, a in enumerate(sets[:20]):
            for j, b in enumerate(sets):
                assert hit[i, j] == (len({*a} & {*b}) / len({*a} | {*b}) >= similarity - 1e-9)
    assert ss.jaccard_hits(sets[40:], sets[40:], 0.9).tolist() == [[True, True, True], [True, True, False], [True, False, True]]


def test_spark_and_numpy_hash_alike(spark):
    values = [0, 1, -1, 2**63 - 1, -(2**63), 123456789]
    rows = spark.createDataFrame([(v,) for v in values], "v long").selectExpr("v", "xxhash64(v) AS h").collect()
    assert [r.h for r in rows] == ss._spark_hash(np.array([r.v for r in rows])).tolist()


def test_cut():
    text = b"keep one CUT two\nCUT three\nkeep"
    assert ss.cut(text, [(9, 16), (17, 26)]) == (b"keep one keep", [(9, 26)])
    assert ss.cut(text, []) == (text, [])
    assert ss.cut(b"abc", [(0, 3)]) == (b"", [(0, 3)])
    assert ss.cut(b"a b c d", [(2, 3), (2, 5)]) == (b"a d", [(2, 5)])


def run(spark, rows):
    docs = spark.createDataFrame([(d, t, "x", 0) for d, t in rows], "doc_id long, text string, row string, spans int")
    return ss.deduplicated(docs.repartition(4)).collect()


def test_planted_passages_stay_once(spark):
    passage, line = prose(60), prose(40)
    words = line.split()
    words[3] = "changed"
    near = " ".join(words)
    rows = [(i, f"{prose(80)} {passage} {prose(30)}\n{prose(50)}") for i in range(10, 22)]
    rows += [(30 + i, f"{prose(50)}\n{line if i % 2 else near}\n{prose(45)}") for i in range(6)]
    clean = [(100 + i, f"{prose(120)}\n{prose(60)}") for i in range(10)]
    edge = [(200, None), (201, ""), (202, "few words"), (203, prose(25)), (None, f"x {passage} y"), (10, rows[0][1]), (300, rows[1][1])]
    got = run(spark, rows + clean + edge)
    assert len(got) == len(rows + clean + edge)
    texts: dict = {}
    for r in got:
        texts.setdefault(r.doc_id, []).append(r.text)
    want = dict(rows + clean)
    assert texts[10] == [want[10]] * 2  # the first document with the passage, twice
    for doc_id, text in clean:
        assert texts[doc_id] == [text]
    assert texts[200] == [None] and texts[201] == [""] and texts[202] == ["few words"]
    inner = " ".join(passage.split()[10:50])
    assert [d for d, found in texts.items() if any(inner in (t or "") for t in found)] == [10]
    for i in range(11, 22):
        before, after = want[i].split(passage)
        kept = texts[i][0]
        assert kept.startswith(before.strip()) and kept.endswith(after.strip())
        assert len(kept.split()) <= len(before.split()) + len(after.split()) + 2 * (ss.GAP - 1)
    assert line not in texts[31][0] or near not in texts[30][0]
    assert texts[30] == [want[30]] and all(line not in texts[30 + i][0] and near not in texts[30 + i][0] for i in range(1, 6))
    assert texts[300][0].strip() == ""
    assert {r.row for r in got} == {"x"}


def test_tiles_find_what_one_tile_finds(spark, monkeypatch):
    base = prose(60).split()
    rows = []
    for i in range(40):
        words = [*base]
        words[RNG.randrange(60)] = f"v{i}"
        rows.append((i, f"{prose(30)}\n{' '.join(words)}"))
    lines = lambda: spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(ss, "TILE", 7)
    got = {r.doc_id: r.text for r in ss.deduplicated(lines()).collect()}
    assert got[0] == rows[0][1] and all("\n" not in got[i].strip() for i in range(1, 40))


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, "a")]])
def test_small_tables(spark, rows):
    assert sorted((r.doc_id, r.text) for r in run(spark, rows)) == rows


def test_passages_are_cut_to_their_ends(spark):
    rows, rest = [], {}
    for k in range(40):
        passage = prose(RNG.choice([33, 40, 51, 60, 80]))
        for i in range(3):
            # Words next to the passage are the document's own, so that no copy is longer by chance.
            before, after = f"{prose(RNG.randrange(25, 60))} b{k}x{i}", f"a{k}x{i} {prose(RNG.randrange(25, 60))}"
            rows.append((3 * k + i, f"{before} {passage} {after}"))
            rest[3 * k + i] = f"{before} {passage} {after}" if i == 0 else f"{before} {after}"
    assert {r.doc_id: r.text for r in run(spark, rows)} == rest


def test_a_copy_ends_where_the_later_documents_passage_ends(spark):
    a, b, c = prose(40), prose(15), prose(30)
    x = [prose(25) for _ in range(6)]
    # 2 shares less with 0 than with 1, and 1 has the rest.
    rows = [(0, f"{x[0]} {a} {x[1]}"), (1, f"{x[2]} {a} {b} {c} {x[3]}"), (2, f"{x[4]} {a} {b} {x[5]}")]
    got = {r.doc_id: r.text for r in run(spark, rows)}
    assert got[0] == rows[0][1] and got[2] == f"{x[4]} {x[5]}"
    assert got[1] == f"{x[2]} {b} {c} {x[3]}"


def test_a_word_said_over_and_over_is_one_place(spark):
    x = [prose(30) for _ in range(4)]
    rows = [(0, f"{x[0]} {'of ' * 300}{x[1]}"), (1, f"{x[2]} {'of ' * 500}{x[3]}")]
    got = {r.doc_id: r.text for r in run(spark, rows)}
    assert got == {0: rows[0][1], 1: f"{x[2]} {x[3]}"}


def test_texts_hashed_together_are_as_by_themselves():
    texts = ["", "a b", prose(19), prose(20), prose(33), "x " * 30, "", prose(400) + "\n" + prose(25) + "\n\n" + prose(3), "of " * 500, prose(21), ""]
    texts = [t.encode() for t in texts]
    doc = ss.Document(*texts)
    at, hashes = doc.runs()
    owner, line_owner = (np.searchsorted(doc.begins, x, "right") - 1 for x in (at, doc.first))
    bands, keys = doc.bands(), doc.line_keys()
    for k, text in enumerate(texts):
        one = ss.Document(text)
        one_at, one_hashes = one.runs()
        assert (doc.starts[at[owner == k]] - doc.offsets[k]).tolist() == one.starts[one_at].tolist()
        assert hashes[owner == k].tolist() == one_hashes.tolist()
        assert keys[line_owner == k].tolist() == one.line_keys().tolist()
        assert bands[line_owner == k].tolist() == one.bands().tolist()


def test_the_leftmost_least_of_every_stretch():
    for n in (0, 1, 5, 13, 14, 15, 60):
        values = np.array([RNG.randrange(9) for _ in range(n)], np.uint64)
        for width in (1, 2, 5, 14):
            want = [k + int(values[k : k + width].argmin()) for k in range(n - width + 1)]
            assert ss.leftmost_least(values, width).tolist() == want


def test_groups_hold_every_text_once(monkeypatch):
    monkeypatch.setattr(ss, "TOGETHER", 10)
    column = pa.array([b"abc", None, b"", b"x" * 50, b"defghi", b"jklmnop", b"q"])
    groups = list(ss._together(column))
    assert [t for _, group in groups for t in group] == [v or b"" for v in column.to_pylist()]
    assert [first for first, _ in groups] == [sum(len(g) for _, g in groups[:k]) for k in range(len(groups))]
    assert list(ss._together(pa.array([], pa.binary()))) == []
