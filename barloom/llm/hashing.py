"""Rabin-Karp hashes of word windows, vectorised with numpy.

A word's hash adds up mixed pairs of byte and place, since a polynomial modulo 2**64
over bytes would give some words of 2,048 bytes and more the same hash whatever its
base. Hashes of windows are polynomials over at most a few dozen word hashes, with odd
multipliers, so that a power has an inverse and any span's hash comes from two prefix
sums; a bijective mixing step follows. Words are the spans between the bytes 0x20 and
0x09-0x0D.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

PLACES = 64  # bytes of a word whose pairs come from a table
WORD_BASE = 0xD1342543DE82EF95
SECOND_BASE = 0xAF251AF3B0F025B5

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _table(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of base and of its inverse modulo 2**64, at least n of each."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        have = _powers[base] = (both[0], both[1])
    return have


def _pairs(seed: int) -> np.ndarray:
    """A mixed value for each of the first PLACES places and each byte."""
    return mixed(np.arange(1, PLACES * 256 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


_PAIRS = (_pairs(0), _pairs(0x2545F4914F6CDD1D))


def word_hashes(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, many: int = 1) -> list[np.ndarray]:
    """One or two independent hashes of the bytes of each span; spans are not empty, ascending and apart."""
    if not len(begin):
        return [np.zeros(0, dtype=np.uint64)] * many
    place = np.zeros(len(raw), dtype=np.int32)
    place[begin] = begin
    np.maximum.accumulate(place, out=place)
    np.subtract(np.arange(len(raw), dtype=np.int32), place, out=place)
    at = (place & np.int32(PLACES - 1)) << np.int32(8) | raw
    far = np.flatnonzero(place >= PLACES)
    turn = (place[far] // PLACES).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    out = []
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    for table in _PAIRS[:many]:
        pair = table.take(at)
        pair[far] = mixed(pair[far] + turn)
        np.cumsum(pair, out=sums[1:])
        out.append(mixed(sums[end] - sums[begin] + (end - begin).astype(np.uint64)))
    return out


def spans(values: np.ndarray, begin: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Unmixed polynomial hashes of values[begin:end] for each pair."""
    if not len(begin):
        return np.zeros(0, dtype=np.uint64)
    power, inverse = _table(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * power[: len(values)], out=sums[1:])
    return (sums[end] - sums[begin]) * inverse[begin]


@dataclass
class Words:
    """The words of some documents, one after another."""

    hashes: np.ndarray  # of each word
    first: np.ndarray  # index of each document's first word; one more entry at the end


def words_of(texts: list[str], lower: bool = False) -> Words:
    encoded = [t.encode("utf-8", "surrogatepass") for t in texts]
    raw = np.frombuffer(b"\n".join([*encoded, b""]), dtype=np.uint8)
    if lower:
        raw = _LOWER[raw]
    space = _SPACE[raw]
    edge = np.flatnonzero(np.diff(space.astype(np.int8), prepend=np.int8(1), append=np.int8(1)))
    begin, end = edge[0::2], edge[1::2]
    (hashes,) = word_hashes(raw, begin, end)
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(e) + 1 for e in encoded], out=offsets[1:])
    return Words(hashes, np.searchsorted(begin, offsets))


def windows(words: Words, size: int, base: int = WORD_BASE) -> tuple[np.ndarray, np.ndarray]:
    """Start (word index) and hash of each window of size words inside one document."""
    n = len(words.hashes)
    if n < size:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    inside = np.ones(n, dtype=np.int8)
    doc = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    inside[: n - size + 1] = doc[: n - size + 1] == doc[size - 1 :]
    inside[n - size + 1 :] = 0
    start = np.flatnonzero(inside)
    return start, mixed(spans(words.hashes, start, start + size, base))


def shingle_sets(texts: list[str], size: int, lower: bool = True) -> list[np.ndarray]:
    """Each document's distinct shingles as sorted hashes.

    A document with fewer words than size has its whole sequence as one shingle;
    one without words has none.
    """
    words = words_of(texts, lower)
    start, hashes = windows(words, size)
    bounds = np.searchsorted(start, words.first)
    out = []
    for i in range(len(texts)):
        a, b = words.first[i], words.first[i + 1]
        if b - a >= size:
            out.append(np.unique(hashes[bounds[i] : bounds[i + 1]]))
        elif b > a:
            whole = spans(words.hashes[a:b], np.array([0]), np.array([b - a]), WORD_BASE)
            out.append(mixed(whole + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
