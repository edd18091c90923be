"""Static range asymmetric numeral system over token ids.

All blocks share one frequency table. A block interleaves at most LANES states, fewer in
a small block; lane i of n codes every n-th id. Renormalisation moves 32-bit words. A block's bytes are

    b"BLR1", ids (u32), lanes (u16), checkpoints (u16), words (u32), crc32 (u32),
    then for each checkpoint: word position (u32) and the lanes' states (u64 each),
    then the words (u32), all little-endian.

Checkpoint k holds the decoder's state before step k * STEPS, so that parts of a
block decode on their own; the checksum covers the ids as unsigned 32-bit integers.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

SCALE_BITS = 18
LANES = 2048
STEPS = 128
LOW = 1 << 31
MAGIC = b"BLR1"
_HEAD = struct.Struct("<4sIHHII")


class BlockError(ValueError):
    """A block is damaged or of another format."""


@dataclass(frozen=True)
class FrequencyTable:
    """Frequencies that sum to 2**SCALE_BITS; ids that never occur have none."""

    frequency: np.ndarray
    start: np.ndarray

    @staticmethod
    def of_counts(counts: np.ndarray) -> FrequencyTable:
        """Scale counts down or up, at least 1 for each id that occurs."""
        counts = np.asarray(counts, dtype=np.float64)
        total, size = counts.sum(), 1 << SCALE_BITS
        frequency = np.zeros(len(counts), dtype=np.int64)
        seen = counts > 0
        if seen.sum() > size:
            raise ValueError("more symbols than slots")
        if total:
            frequency[seen] = np.maximum(1, np.floor(counts[seen] * size / total)).astype(np.int64)
            rest = size - int(frequency.sum())
            order = np.lexsort((np.arange(len(counts)), -frequency))
            at = 0
            while rest:  # the most frequent ids take the rounding, half of each at most
                i = order[at % len(order)]
                step = rest if rest > 0 else -min(-rest, int(frequency[i]) // 2)
                frequency[i] += step
                rest -= step
                at += 1
        return FrequencyTable(frequency.astype(np.uint64), (np.cumsum(frequency) - frequency).astype(np.uint64))

    def slots(self) -> np.ndarray:
        """The id at each of the 2**SCALE_BITS slots."""
        return np.repeat(np.arange(len(self.frequency), dtype=np.uint32), self.frequency.astype(np.int64))


def encode(ids: np.ndarray, table: FrequencyTable) -> bytes:
    n, bits = len(ids), np.uint64(SCALE_BITS)
    lanes = min(LANES, max(1, n // 64))
    steps = -(-n // lanes)
    f, c = table.frequency[ids], table.start[ids]
    top = f << np.uint64(63 - SCALE_BITS)
    x = np.full(lanes, LOW, dtype=np.uint64)
    out, saved = [], []
    for s in range(steps - 1, -1, -1):
        a, b = s * lanes, min(n, (s + 1) * lanes)
        part, fs = x[: b - a], f[a:b]
        full = np.flatnonzero(part >= top[a:b])
        over = part[full]
        out.append(over.astype(np.uint32))
        part[full] = over >> np.uint64(32)
        whole = part // fs
        x[: b - a] = (whole << bits) + (part - whole * fs) + c[a:b]
        if s % STEPS == 0:
            saved.append((s, x.copy()))
    out.reverse()
    position = np.zeros(steps + 1, dtype=np.int64)
    np.cumsum([len(w) for w in out], out=position[1:])
    words = np.concatenate(out) if out else np.zeros(0, dtype=np.uint32)
    check = zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())
    parts = [_HEAD.pack(MAGIC, n, lanes, len(saved), len(words), check)]
    for s, state in reversed(saved):
        parts += [struct.pack("<I", position[s]), state.astype("<u8").tobytes()]
    return b"".join([*parts, words.astype("<u4").tobytes()])


class Decoder:
    """Decodes blocks made with one table."""

    def __init__(self, table: FrequencyTable):
        self.ids = table.slots()
        within = np.arange(len(self.ids), dtype=np.uint64) - table.start[self.ids]
        self.slots = (table.frequency[self.ids] << np.uint64(32)) | within

    def decode(self, data: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
        """The ids between two checkpoints, all by default; then the checksum is tested."""
        if len(data) < _HEAD.size or data[:4] != MAGIC:
            raise BlockError("not a block")
        _, n, lanes, points, n_words, check = _HEAD.unpack_from(data)
        size = 4 + 8 * lanes
        body = _HEAD.size + points * size
        if len(data) != body + 4 * n_words:
            raise BlockError("the block is cut short")
        words = np.frombuffer(data, dtype="<u4", offset=body).astype(np.uint64)
        last = points if last is None else min(last, points)
        out = np.zeros(min(n, last * STEPS * lanes) - min(n, first * STEPS * lanes), dtype=np.uint32)
        if len(out):
            at = _HEAD.size + first * size
            (position,) = struct.unpack_from("<I", data, at)
            x = np.frombuffer(data, dtype="<u8", count=lanes, offset=at + 4).astype(np.uint64)
            slots, mask, bits, half = self.slots, np.uint64((1 << SCALE_BITS) - 1), np.uint64(SCALE_BITS), np.uint64(32)
            rest = np.uint64((1 << 32) - 1)
            met = np.empty(len(out), dtype=np.int64)
            for a in range(0, len(out), lanes):
                b = min(len(out), a + lanes)
                part = x[: b - a]
                slot = (part & mask).view(np.int64)
                met[a:b] = slot
                step = slots.take(slot, mode="clip")
                part >>= bits
                part *= step >> half
                part += step & rest
                low = np.flatnonzero(part < LOW)
                part[low] = (part[low] << half) | words[position : position + len(low)]
                position += len(low)
            out = self.ids.take(met)
        if first == 0 and last == points and zlib.crc32(out.astype("<u4").tobytes()) != check:
            raise BlockError("the checksum differs")
        return out
