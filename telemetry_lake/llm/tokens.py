"""Token ids of whole texts with the tokenizers library, many texts at a time.

The vocabulary drops white space and never joins letters across it, so a text's ids are its
words' ids one after another. The words of some MB of texts are found as an Arrow column, each different one is encoded
once, and the ids are taken by place. Words beyond plain Latin script, and words that may hold a special token's name, go
to the library whole; the others are cut into the pieces that the file's own pattern gives, and the library's model is called
on many different pieces joined by spaces, each of which ends with an id of its own kind.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from public_tokenizers import path
from tokenizers import Tokenizer, models, pre_tokenizers

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
# Words kept per process of those that go to the library whole; when that number is reached, they are encoded again.
REMEMBERED = 500_000
# Bytes of texts whose words are looked up together; a longer text is by itself.
TOGETHER = 8 << 20
# Characters of pieces that the model gets at once, so that what it says of each stays small.
JOINED = 10_000

# The split pattern in the tokenizer's file, and the byte-level alphabet's rule
# (printable bytes stand for themselves, the others follow from 256 on).
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
# White space for Python only; the library takes these four for symbols.
_SEPARATORS = "[\x1c-\x1f]"
# Words that the library gets whole, and a letter of which only Python's lower case is the library's.
_WHOLE = "[<\u0250-\U0010ffff]"
_DOTTED = "\u0130"


def _alphabet() -> dict[int, str]:
    others = iter(range(256, 512))
    return {b: chr(b if b in _PRINTABLE else next(others)) for b in range(256)}


class _Words:
    """Ids of words and whole texts as little-endian unsigned 32-bit integers."""

    def __init__(self, file: str):
        self.library = Tokenizer.from_file(file)
        with open(file, encoding="utf-8") as f:
            about = json.load(f)["model"]
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in about["merges"]]
        # The library's model without its own cache, which is slower than encoding a word.
        self.model = Tokenizer(models.BPE(about["vocab"], merges, cache_capacity=0, end_of_word_suffix=about["end_of_word_suffix"]))
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        # Whether an id ends a piece. No piece holds the suffix itself: it has letters and signs.
        self.ends = np.zeros(max(about["vocab"].values()) + 1, bool)
        self.ends[[i for token, i in about["vocab"].items() if token.endswith(about["end_of_word_suffix"])]] = True
        # Spaces stand between pieces only.
        self.alphabet = _alphabet() | {ord(" "): " "}
        self.forget()

    def forget(self) -> None:
        self.words: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def texts(self, column: pa.Array) -> list[bytes]:
        """The ids of each text, with the end id; null is the empty text."""
        column = column.fill_null("")
        odd = pc.match_substring_regex(column, _SEPARATORS)
        found = pc.utf8_split_whitespace(pc.if_else(odd, "", column) if pc.any(odd).as_py() else column)
        words = found.flatten().dictionary_encode()
        known, places = self._known(words.dictionary)
        ids = known.take(pa.array(places[words.indices.to_numpy()]))
        end = END_ID.to_bytes(4, "little")
        encoded = [ids + end for ids in _merged(ids, pc.list_value_length(found).to_numpy()).to_pylist()]
        for k in pc.indices_nonzero(odd).to_pylist():
            encoded[k] = self.whole(column[k].as_py()) + end
        return encoded

    def _known(self, words: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The ids of different words in some order, and the place of each word there."""
        whole = pc.match_substring_regex(words, _WHOLE)
        low = pc.utf8_lower(words)
        body, sign = pc.utf8_slice_codeunits(low, 0, -1), pc.utf8_slice_codeunits(low, -1)
        usual = pc.invert(pc.or_(whole, pc.match_substring(words, _DOTTED)))
        # Most words are letters, or letters and one sign: what the pattern would give is plain.
        letters = pc.and_(usual, pc.utf8_is_alpha(low))
        signed = pc.and_(pc.and_not(usual, letters), pc.and_not(pc.utf8_is_alpha(body), pc.utf8_is_alnum(sign)))
        others = pc.invert(pc.or_(whole, pc.or_(letters, signed)))
        cut = [_PIECES.findall(word.lower()) for word in words.filter(others).to_pylist()]
        pairs = [body.filter(signed), sign.filter(signed)]
        pieces = pa.concat_arrays([low.filter(letters), *pairs, pa.array([p for some in cut for p in some], words.type)]).dictionary_encode()
        n, m = pc.sum(letters).as_py() or 0, len(pairs[0])
        of = pieces.indices.to_numpy()
        of = np.concatenate((of[:n], of[n : n + 2 * m].reshape(2, m).T.ravel(), of[n + 2 * m :]))
        counts = np.concatenate((np.ones(n, np.int64), np.full(m, 2), np.array([len(some) for some in cut], np.int64)))
        ids = _merged(self._model_ids(pieces.dictionary).take(pa.array(of)), counts)
        if len(self.words) >= REMEMBERED:
            self.forget()
        rare = pa.array([self._remembered(word) for word in words.filter(whole).to_pylist()], pa.large_binary())
        order = np.concatenate([pc.indices_nonzero(kind).to_numpy() for kind in (letters, signed, others, whole)])
        places = np.empty(len(words), np.int64)
        places[order] = np.arange(len(words))
        return pa.concat_arrays([ids, rare]), places

    def _remembered(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            ids = self.words[word] = self.whole(word)
        return ids

    def _model_ids(self, pieces: pa.Array) -> pa.Array:
        """The model's ids of different pieces, some JOINED characters of them at a time."""
        block = np.cumsum(pc.utf8_length(pieces).to_numpy()) // JOINED
        cuts = np.append(np.flatnonzero(np.diff(block, prepend=-1)), len(pieces)).astype(np.int64)
        joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(cuts), pieces), " ")
        found = [np.array(self.model.encode(self._signs(text.as_py())).ids, "<u4") for text in joined]
        ids = np.concatenate([np.zeros(0, "<u4"), *found])
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(pieces):
            raise ValueError("the vocabulary has no id of its own for the end of a piece")
        return pa.Array.from_buffers(pa.large_binary(), len(pieces), [None, pa.py_buffer(4 * np.append(0, stops)), pa.py_buffer(ids)])

    def _signs(self, pieces: str) -> str:
        """Bytes as the model's alphabet writes them."""
        if pieces.isascii() and pieces.isprintable():
            return pieces
        return pieces.encode().decode("latin-1").translate(self.alphabet)


def _merged(ids: pa.Array, counts: np.ndarray) -> pa.Array:
    """So many neighbours, as `take` returned them, put together."""
    _, places, data = ids.buffers()
    ends = np.frombuffer(places, np.int64)[np.append(0, np.cumsum(counts))]
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends), data])


@functools.cache
def _words(vocabulary: str) -> _Words:
    return _Words(path(vocabulary))


def forget(vocabulary: str = VOCABULARY) -> None:
    """Let go of the remembered words, which are hundreds of MB: the worker stays and other stages use it, next to new ones."""
    _words(vocabulary).forget()


@functools.cache
def vocabulary_size(vocabulary: str = VOCABULARY) -> int:
    return Tokenizer.from_file(path(vocabulary)).get_vocab_size()


def encode(text: str, vocabulary: str = VOCABULARY) -> bytes:
    """The text's ids and the end id, as little-endian unsigned 32-bit integers."""
    return _words(vocabulary).texts(pa.array([text], pa.string()))[0]


def encoded(parts: Iterator[pa.RecordBatch], vocabulary: str = VOCABULARY) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """Of batches of `doc_id`, `text` the ids as of `encode`, next to the doc_ids, for some TOGETHER bytes of batches at once."""
    own = _words(vocabulary)
    held: list[pa.RecordBatch] = []
    for part in parts:
        if held and sum(p.nbytes for p in held) + part.nbytes > TOGETHER:
            yield _encoded(own, held)
            held = []
        held.append(part)
    if held:
        yield _encoded(own, held)


def _encoded(own: _Words, parts: list[pa.RecordBatch]) -> tuple[pa.Array, list[bytes]]:
    doc_ids, column = (pa.concat_arrays([p.column(k) for p in parts]) for k in (0, 1))
    return doc_ids, own.texts(column)
