"""Ids of public tokenizers, with a bounded memory of pieces met before.

A text is cut where the tokenizer's own pre-tokenisation always cuts, so that the
pieces can be encoded one by one. Pieces are told apart by two 64-bit hashes; a piece
met before is looked up in sorted hashes.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from itertools import chain

import numpy as np

from barloom.llm.hashing import _LOWER, _SPACE, word_hashes

MEMORY = 800_000
LONGEST = 64

#: Bytes after a space before which no cut is made: white space, control
#: characters, and first bytes of characters that may be white space.
_NO_CUT = np.zeros(256, dtype=bool)
_NO_CUT[:0x21] = True
_NO_CUT[[0x7F, 0xC2, 0xE1, 0xE2, 0xE3]] = True


#: 1 for ASCII letters, 2 for digits, 3 for punctuation but the apostrophe, 0 for other bytes.
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[0x21:0x7F] = 3
_KIND[0x27] = 0
_KIND[0x30:0x3A] = 2
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = 1


def word_ends(raw: np.ndarray) -> np.ndarray:
    """True for bytes that end a run of letters or digits before a character of another kind.

    No match of the vocabularies' patterns goes on there. Letters are those of ASCII and
    Latin-1; the character after them is one of ASCII.
    """
    out = np.zeros(len(raw), dtype=bool)
    kind = _KIND[raw]
    before = kind.copy()
    latin = np.flatnonzero(raw == 0xC3) + 1  # second bytes; 0x97 and 0xB7 are signs
    latin = latin[latin < len(raw)]
    before[latin[(raw[latin] != 0x97) & (raw[latin] != 0xB7)]] = 1
    out[:-1] = ((before[:-1] == 1) | (before[:-1] == 2)) & (kind[1:] != 0) & (before[:-1] != kind[1:])
    return out


def leading_pieces(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces that begin at a document's start, at a space before another character or after word_ends()."""
    cut = np.zeros(len(raw) + 1, dtype=bool)
    if len(raw) > 1:
        cut[: len(raw) - 1] = (raw[:-1] == 0x20) & ~_NO_CUT[raw[1:]]
    cut[offsets[1:][np.diff(offsets) > 0] - 1] = False  # the character after a last space is another document's
    cut[1:] |= word_ends(raw)
    cut[offsets[:-1][np.diff(offsets) > 0]] = True
    cut[len(raw)] = True
    edges = np.flatnonzero(cut)
    return edges[:-1], edges[1:], np.searchsorted(edges[:-1], offsets)


def dropped_pieces(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces between ASCII white space and word_ends(), for vocabularies that discard the space."""
    solid, ends = ~_SPACE[raw], word_ends(raw)
    starts = solid.copy()
    starts[1:] &= ~solid[:-1] | ends[:-1]
    inner = offsets[:-1][np.diff(offsets) > 0]
    starts[inner] = solid[inner]
    begin = np.flatnonzero(starts)
    stops = solid.copy()
    stops[:-1] &= ~solid[1:] | ends[:-1]
    last = offsets[1:][np.diff(offsets) > 0] - 1
    stops[last] = solid[last]
    return begin, np.flatnonzero(stops) + 1, np.searchsorted(begin, offsets)


def folded_case(raw: np.ndarray) -> np.ndarray:
    """A-Z in lower case, but not before a byte that may belong to a combining mark."""
    out = _LOWER[raw]
    if len(raw) > 1:
        marked = np.flatnonzero(raw[1:] >= 0x80)
        out[marked] = raw[marked]
    return out


class PieceMemory:
    """Values of pieces, made once and remembered.

    make gets distinct pieces and returns a value for each. Pieces are equal where both
    of two independent 64-bit hashes are. About MEMORY pieces of at most LONGEST bytes
    are remembered, the longest unused ones are forgotten first; this changes speed
    only. prepare changes the bytes of all texts before.
    """

    def __init__(self, make: Callable[[list[bytes]], list], cutter: Callable, prepare: Callable | None = None):
        self.make, self.cutter, self.prepare, self.tick = make, cutter, prepare, 0
        self.hashes = np.zeros(0, dtype=np.uint64)
        self.checks = np.zeros(0, dtype=np.uint64)
        self.used = np.zeros(0, dtype=np.int32)
        self.values = np.zeros(0, dtype=object)

    def look_up(self, texts: list[str]) -> list[list]:
        """For each text the values of its pieces in order."""
        encoded = [t.encode("utf-8", "surrogatepass") for t in texts]
        data = b"".join(encoded)
        raw = np.frombuffer(data, dtype=np.uint8)
        offsets = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum([len(e) for e in encoded], out=offsets[1:])
        if not len(raw):
            return [[] for _ in texts]
        if self.prepare is not None:
            raw = self.prepare(raw)
            data = raw.tobytes()
        begin, end, first = self.cutter(raw, offsets)
        keys, checks = word_hashes(raw, begin, end, 2)
        unique, at, inverse = np.unique(keys, return_index=True, return_inverse=True)
        values = np.empty(len(unique), dtype=object)
        place = np.searchsorted(self.hashes, unique)
        hit = np.zeros(len(unique), dtype=bool)
        inside = np.flatnonzero(place < len(self.hashes))
        hit[inside] = (self.hashes[place[inside]] == unique[inside]) & (self.checks[place[inside]] == checks[at[inside]])
        self.tick += 1
        self.used[place[hit]] = self.tick
        values[hit] = self.values[place[hit]]
        new = np.flatnonzero(~hit)
        if len(new):
            made = self.make([data[begin[i] : end[i]] for i in at[new]])
            fresh = np.empty(len(new), dtype=object)
            fresh[:] = made
            values[new] = fresh
            keep = (end - begin)[at[new]] <= LONGEST
            self._remember(unique[new][keep], checks[at[new]][keep], fresh[keep])
        listed = values[inverse].tolist()
        for i in np.flatnonzero(checks != checks[at][inverse]).tolist():  # another piece of the same first hash
            (listed[i],) = self.make([data[begin[i] : end[i]]])
        return [listed[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]

    def _remember(self, hashes: np.ndarray, checks: np.ndarray, values: np.ndarray) -> None:
        if len(self.hashes) + len(hashes) > MEMORY:
            keep = self.used > np.median(self.used) if len(self.used) else slice(0, 0)
            self.hashes, self.checks, self.used, self.values = self.hashes[keep], self.checks[keep], self.used[keep], self.values[keep]
        at = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, at, hashes)
        self.checks = np.insert(self.checks, at, checks)
        self.used = np.insert(self.used, at, self.tick)
        self.values = np.insert(self.values, at, values)


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class PieceEncoder:
    """Encodes texts to the bytes of their ids.

    style "leading" is for byte-level vocabularies, "dropped" for those that
    discard white space and lower the case.
    """

    def __init__(self, path: str, style: str, dtype: str):
        tokenizer, kind = load_tokenizer(path), np.dtype(dtype)

        def make(pieces: list[bytes]) -> list[bytes]:
            out = []
            for at in range(0, len(pieces), 20_000):
                part = [p.decode("utf-8", "surrogatepass") for p in pieces[at : at + 20_000]]
                ids = [e.ids for e in tokenizer.encode_batch_fast(part, add_special_tokens=False)]
                data = np.array(list(chain.from_iterable(ids)), dtype=kind).tobytes()
                ends = np.cumsum([0, *map(len, ids)]) * kind.itemsize
                out += [data[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            return out

        self.tokenizer, self.kind = tokenizer, kind
        self.memory = PieceMemory(make, leading_pieces) if style == "leading" else PieceMemory(make, dropped_pieces, folded_case)
        added = {t.content: (i, t) for i, t in tokenizer.get_added_tokens_decoder().items()}
        if any(t.normalized or t.single_word or t.lstrip or t.rstrip for _, t in added.values()):
            raise ValueError("added tokens that depend on what stands beside them are not supported")
        self.added = {content: np.array([i], dtype=kind).tobytes() for content, (i, _) in added.items()}
        longest = sorted(added, key=lambda c: (-len(c), c))
        self.split = re.compile(f"({'|'.join(map(re.escape, longest))})").split if added else None

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids' bytes of each text; added tokens in a text are one id each, as the library has it."""
        if self.split is None or not any(c in t for t in texts for c in self.added):
            return [b"".join(x) for x in self.memory.look_up(texts)]
        parts = [self.split(t) for t in texts]  # every other one is an added token
        found = iter(self.memory.look_up([p for own in parts for p in own[::2]]))
        return [b"".join(self.added[p] if k % 2 else b"".join(next(found)) for k, p in enumerate(own)) for own in parts]


_encoders: dict[tuple[str, str, str], PieceEncoder] = {}


def encoder(path: str, style: str, dtype: str) -> PieceEncoder:
    """One encoder for each Python worker; workers are reused between tasks."""
    key = (path, style, dtype)
    if key not in _encoders:
        _encoders[key] = PieceEncoder(path, style, dtype)
    return _encoders[key]


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
