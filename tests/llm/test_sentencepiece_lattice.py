"""The lattice's folds against the library, and against all segmentations."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import sentencepiece
from public_tokenizers import path

from telemetry_lake.llm import sentencepiece_lattice as sl

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=path(sl.MODEL))
TEXTS = [
    "Plain words and it's here.",
    "  two  spaces   and\ttabs\nlines\r\n end ",
    "Straße ÉCOLE naïve ½ x² 漢字かな 🙂🙂‍ \x00\x1c ﬁ",
    "a▁b ▁ ▁▁c",
    "trailing space ",
    "word, word. (word) \"word\" word's",
    "x" * 200 + " " + "lower" * 30 + "\n" + "y" * 100,
    "12345 67.89 --- *** %%% ### |",
    "enenenenen thththth aaaaaaaaaaaaaaaaaaaaaaaaa",
    "\n\n",
    " ",
    "",
    None,
]


def table(spark, values, folder, name):
    file = f"{folder}/{name}"
    rows = [(d, t, "x", 1) for d, t in values]
    spark.createDataFrame(rows, "doc_id long, text string, word string, ids int").repartition(3).write.parquet(file)
    return sl.file_blocks(spark.read.parquet(file).select("*", "_metadata"))


def test_ids_equal_the_library(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sl, "BLOCK", 4)
    rng = random.Random(1)
    made = [" ".join("".join(rng.choice("enthrstoi") for _ in range(rng.randint(1, 15))) for _ in range(30)) for _ in range(20)]
    values = list(enumerate(TEXTS + made)) + [(2, TEXTS[2]), (None, "no id")]
    encoded = sl.encode(table(spark, values, tmp_path, "t"))
    got = encoded.collect()
    assert len(got) == len(values)
    for row in got:
        text = "no id" if row.doc_id is None else dict(values[:-1])[row.doc_id]
        assert np.frombuffer(row.ids, "<u4").tolist() == LIBRARY.encode(text or ""), text
    for row in sl.decode(encoded).collect():
        text = "no id" if row.doc_id is None else dict(values[:-1])[row.doc_id]
        assert row.text == (text or "").replace(sl.MARK, " ")


def test_words_cover_the_text():
    pieces = sl.load()
    for text in TEXTS:
        marked = (sl.MARK + text.replace(" ", sl.MARK)) if text else ""
        assert "".join(sl.words(text or "", pieces)) == marked
        if text and sl._plain(text):
            parts = [w for part in text.split(" ") for w in sl.words(part, pieces) or [sl.MARK]]
            assert parts == sl.words(text, pieces)


def test_no_piece_spans_two_words():
    pieces = sl.load()
    assert all(sl.words(text, pieces)[0] == sl.MARK + text for text, _, _ in pieces.rows if sl.MARK + text in {t for t, _, _ in pieces.rows})
    assert all(set(zip(text, text[1:])) <= pieces.neighbours for text, _, _ in pieces.rows)


def test_viterbi_equals_all_segmentations(spark):
    rng = random.Random(5)
    letters = "abc"
    texts = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, 4))) for _ in range(25)} - {"c"})
    pieces = sl.Pieces(tuple((t, 300 + k, -rng.uniform(1, 9)) for k, t in enumerate(texts)), tuple(range(3, 259)))
    scores = {t: s for t, _, s in pieces.rows}
    ids = {t: k for t, k, _ in pieces.rows}
    distinct = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(60)})

    def best(word):
        if not word:
            return 0.0, []
        options = []
        for n in range(1, len(word) + 1):
            head = word[:n]
            if head in scores or n == 1:
                score, rest = best(word[n:])
                options.append((score + scores.get(head, sl.UNKNOWN), [head, *rest]))
        return max(options)

    got = sl.segmented(spark.createDataFrame([(w,) for w in distinct], "word string"), pieces, "viterbi").collect()
    assert len(got) == len(distinct)
    for row in got:
        assert row.ids == [ids[p] if p in ids else 3 + ord(p) for p in best(row.word)[1]], row.word


def test_empty_table_and_control_ids(spark, tmp_path):
    assert sl.encode(table(spark, [], tmp_path, "e")).collect() == []
    rows = spark.createDataFrame([(1, bytearray(np.array([1, 0, 2], "<u4").tobytes())), (2, None)], "doc_id long, ids binary")
    assert [r.text for r in sl.decode(rows).collect()] == ["", ""]


def test_a_column_is_cut_as_its_texts_are():
    pieces = sl.load()
    cuts = sl.Cuts.of(pieces)
    for texts in (TEXTS, [None], ["", None, ""], []):
        found, lengths, at = cuts.words(pa.array([*texts, "x"], pa.string()).slice(0, len(texts)))
        got = [found[a:b].to_pylist() for a, b in zip(at[:-1], at[1:], strict=True)]
        assert got == [sl.words(text or "", pieces) for text in texts]
        assert lengths.tolist() == [len(word) for word in found.to_pylist()]


def test_a_block_gives_each_word_once(spark, tmp_path):
    low, high = (" ".join(f"w{n}" for n in some) for some in (range(100_000, 220_000), range(220_000, 340_000)))
    rows = [(1, low, 0), (2, high, 0), (3, low, 0)]
    blocked = spark.createDataFrame(rows, "doc_id long, text string, block long").coalesce(1)
    needed = sl._needed(blocked, sl.Cuts.of(sl.load()))
    assert needed.count() == needed.distinct().count()


def test_ids_that_are_no_text():
    known = sl.load().spell()
    spell = pa.array([known.get(n, b"") for n in range(max(known) + 2)], pa.large_binary())
    first = sl.load().byte_ids[0]
    # A character in two rows, an id beyond the pieces, no ids.
    rows = [[first + 0xE2, first + 0x96], [first + 0x81, 4_000_000_000], None, []]
    ids = pa.array([None if r is None else np.array(r, "<u4").tobytes() for r in rows], pa.binary())
    assert sl._text(ids, spell).to_pylist() == ["�", "�", "", ""]
