"""Best-fit packing of documents into training sequences by linear grouping.

Documents longer than a sequence are cut: whole sequences stand alone, only the
first, shorter piece is packed. Pieces are dealt at random into shards of a bounded
number; each shard rounds large lengths up within groups of equal size, fills
sequences with configurations of those few sizes, puts actual pieces in the places,
and best-fits the small pieces into what is left.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import record_batch, sliced, stored, texts_of
from barloom.llm.vocabulary import encoder

CAPACITY = 2048
GROUPS = 1024
SHARD = 16_384
SMALL = 4  # lengths up to capacity / SMALL are small


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 for every piece of every document.

    A null or empty text is one piece of the end id; a null doc_id stays null.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer, "leading", "<u4")
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            texts, doc_ids = texts_of(batch), batch.column("doc_id").to_pylist()
            for a, b in sliced(texts, 1 << 20):
                rows = []
                for doc_id, ids in zip(doc_ids[a:b], own.encode(texts[a:b]), strict=True):
                    ids += end
                    n = len(ids) // 4
                    head = n - (-(-n // capacity) - 1) * capacity
                    for k, s in enumerate([0, *range(head, n, capacity)]):
                        size = head if k == 0 else capacity
                        rows.append((doc_id, k, s, size, zlib.crc32(ids[4 * s : 4 * (s + size)])))
                yield record_batch(schema, zip(*rows, strict=True))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def _configuration(sizes: list[int], left: list[int], capacity: int) -> dict[int, int]:
    """The fullest set of sizes with the largest remaining one in it."""
    first = next(g for g, n in enumerate(left) if n)
    room = capacity - sizes[first]
    reached, keep = 1, (2 << room) - 1  # bit i: the sizes so far can fill i tokens
    steps: list[tuple[int, int]] = []  # the size added, what was reached before
    for g in range(first, len(sizes)):
        many = left[g] - (g == first)
        for _ in range(min(many, room // sizes[g])):
            grown = (reached | reached << sizes[g]) & keep
            if grown == reached:
                break
            steps.append((g, reached))
            reached = grown
        if reached >> room:
            break
    fill, used = reached.bit_length() - 1, {first: 1}
    for g, before in reversed(steps):
        if not before >> fill & 1:
            used[g] = used.get(g, 0) + 1
            fill -= sizes[g]
    return used


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY, groups: int = GROUPS, small: int = SMALL) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each length, all between 1 and capacity."""
    n = len(lengths)
    where, offset = np.full(n, -1, dtype=np.int64), np.zeros(n, dtype=np.int64)
    used: list[int] = []  # tokens in each sequence

    def put(item: int, sequence: int) -> None:
        where[item], offset[item] = sequence, used[sequence]
        used[sequence] += int(lengths[item])

    order = np.argsort(-lengths, kind="stable")
    cut = int(np.searchsorted(-lengths[order], -(capacity // small)))
    large, rest = order[:cut], order[cut:]
    if len(large):
        members = [list(x) for x in np.array_split(large, min(groups, len(large)))]
        sizes = [int(lengths[m[0]]) for m in members]
        left = [len(m) for m in members]
        while any(left):
            pattern = _configuration(sizes, left, capacity)
            times = min(left[g] // k for g, k in pattern.items())
            for _ in range(times):
                used.append(0)
                for g, k in pattern.items():
                    for _ in range(k):
                        put(members[g].pop(), len(used) - 1)
            for g, k in pattern.items():
                left[g] -= times * k
    room = sorted((capacity - u, i) for i, u in enumerate(used) if u < capacity)
    for item in rest:
        size = int(lengths[item])
        at = bisect_left(room, (size, -1))
        if at < len(room):
            space, sequence = room.pop(at)
        else:
            used.append(0)
            space, sequence = capacity, len(used) - 1
        put(item, sequence)
        if space > size:
            insort(room, (space - size, sequence))
    return where, offset


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """Add sequence_id and offset to pieces (see cut_pieces), without row.

    row has a number of its own for each piece. pieces is read twice, so it must be
    stored. An empty table gives no rows; repeated pieces are packed each.
    """
    part = pieces.filter(F.col("length") < capacity)
    shards = max(1, -(-part.count() // shard))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def run(group: pa.Table) -> pa.Table:
        which = group.column("shard")[0].as_py()
        group = group.select(columns).sort_by([("length", "descending"), ("doc_id", "ascending"), ("ids_crc32", "ascending")]).combine_chunks()
        where, offset = pack_lengths(group.column("length").to_numpy(), capacity)
        return pa.table([*group.columns, pa.array(2 * ((which << 32) + where)), pa.array(offset)], schema=schema)

    key = F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard")  # repeated rows spread too
    packed = part.select(*columns, key).groupBy("shard").applyInArrow(run, ddl)
    alone = pieces.filter(F.col("length") >= capacity).select(*columns, (2 * F.monotonically_increasing_id() + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(alone)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Sequences of at most capacity ids for all documents.

    A null or empty text is the end id alone. Repeated rows are packed each; a null
    doc_id stays null; an empty table gives no rows; extra columns are ignored.
    """
    pieces = cut_pieces(docs, tokenizer, end_id, capacity).withColumn("row", F.monotonically_increasing_id())
    return pack_pieces(stored(pieces, "pieces"), capacity)
