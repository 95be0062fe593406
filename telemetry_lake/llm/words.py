"""Hashes of words and word shingles, vectorised over the bytes of one text.

Words are maximal runs of bytes outside space and \\t\\n\\v\\f\\r; A-Z is lower-cased. A word's
hash is a polynomial in its bytes modulo 2**64, taken from prefix sums, then mixed; the hash of a run of
words is the same in its words' hashes. Equal words and runs give equal hashes everywhere.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_WORD = 0xD6E8FEB86659FD93 | 1
_WORD_INVERSE = pow(_WORD, -1, 2**64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
# A fixed random value per byte, so that neighbouring letters do not give neighbouring terms.
_BYTE = np.random.default_rng(7).integers(0, 2**64, 256, np.uint64)

_powers = {base: np.ones(1, np.uint64) for base in (_BASE, _BASE_INVERSE, _WORD, _WORD_INVERSE)}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 to base**(n-1), kept per process and grown on demand."""
    have = _powers[base]
    if len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        have = _powers[base] = np.multiply.accumulate(have)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte, and the byte behind the last, of every word."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~SPACE[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes in each span, wherever the span lies."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[_LOWER[data]] * _power(_BASE, len(data)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power(_BASE_INVERSE, len(data) + 1)[starts])


def word_hashes(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    return span_hashes(data, *word_spans(data))


def run_hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the words in each run, wherever the run lies."""
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * _power(_WORD, len(words)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power(_WORD_INVERSE, len(words) + 1)[starts] + (ends - starts).astype(np.uint64))


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of every run of `size` words; of all words where there are fewer, none for none."""
    if not len(words):
        return words
    starts = np.arange(max(1, len(words) - size + 1))
    return run_hashes(words, starts, np.minimum(starts + size, len(words)))
