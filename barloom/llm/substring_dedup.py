"""Removal of word passages that repeat, by Rabin-Karp hashes of all windows.

Documents are hashed in chunks. A chunk keeps one copy of each window hash and sends
it, with the place, to the bucket of a second hash; windows that a chunk holds twice
are known to repeat at once, so that a frequent window reaches its bucket once a
chunk. Buckets find the hashes sent by two chunks and return the places, from which
each chunk makes maximal removal intervals for its documents. The number of buckets
follows the input, which keeps both the size of a bucket and the chance that two
different windows share both hashes bounded.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import guarded, record_batch, sliced, texts_of
from barloom.llm.hashing import SECOND_BASE, mixed, windows, words_of

WINDOW = 35
CHUNK_CHARS = 4 << 20
BUCKET_BYTES = 10 << 20  # of text for each bucket


def pack_places(places: np.ndarray) -> bytes:
    """Ascending integers as gaps of one byte, larger gaps apart."""
    gaps = np.diff(places, prepend=0)
    large = gaps >= 255
    return struct.pack("<II", len(gaps), int(large.sum())) + np.where(large, 255, gaps).astype(np.uint8).tobytes() + gaps[large].astype("<u4").tobytes()


def unpack_places(data: bytes) -> tuple[np.ndarray, int]:
    """The integers and the number of bytes used."""
    n, many = struct.unpack_from("<II", data)
    gaps = np.frombuffer(data, dtype=np.uint8, count=n, offset=8).astype(np.int64)
    gaps[gaps == 255] = np.frombuffer(data, dtype="<u4", count=many, offset=8 + n)
    return np.cumsum(gaps), 8 + n + 4 * many


def _chunk_rows(docs: DataFrame, window: int, buckets: int) -> DataFrame:
    """Bucket rows (hashes and places), and for each chunk rows of its own.

    bucket < 0 marks a chunk's own rows: kind 0 lists documents, kind 1 places known
    to repeat.
    """
    schema = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("kind", pa.int8()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = texts_of(batch)
            ids = batch.column("doc_id")
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            nulls = ids.is_null().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
            for a, b in sliced(texts, CHUNK_CHARS):
                words = words_of(texts[a:b])
                start, hashes = windows(words, window)
                chunk = (part << 32) | number
                number += 1
                if not len(start):
                    continue
                many = np.diff(words.first).astype("<u4")
                listed = [np.asarray(x[a:b], dtype=t).tobytes() for x, t in ((ids, "<i8"), (nulls, "u1"), (keys, "<i8"))]
                unique, first, inverse, counts = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
                own = start[counts[inverse] > 1]
                rows = [(-1 - chunk % 1024, chunk, 0, struct.pack("<I", b - a) + b"".join(listed) + many.tobytes())]
                if len(own):
                    rows.append((-1 - chunk % 1024, chunk, 1, pack_places(own)))
                first.sort()
                _, second = windows(words, window, SECOND_BASE)
                bucket = (mixed(second[first]) % np.uint64(buckets)).astype(np.uint32)
                order = np.argsort(bucket, kind="stable")
                at, hashed, bucket = start[first][order], hashes[first][order], bucket[order]
                edges = np.flatnonzero(np.diff(bucket, prepend=np.int64(-1), append=np.int64(buckets)))
                for s, e in zip(edges[:-1], edges[1:], strict=True):
                    rows.append((int(bucket[s]), chunk, 1, pack_places(at[s:e]) + hashed[s:e].astype("<u8").tobytes()))
                yield record_batch(schema, zip(*rows, strict=True))

    return docs.mapInArrow(run, "bucket int, chunk long, kind byte, data binary")


_CHUNK = pa.schema([("chunk", pa.int64()), ("kind", pa.int8()), ("data", pa.binary())])


def _repeated(group: pa.Table) -> pa.Table:
    """Places of one bucket's windows that more than one chunk sent."""
    if group.column("bucket")[0].as_py() < 0:
        return group.select(["chunk", "kind", "data"]).cast(_CHUNK)
    chunks = group.column("chunk").to_pylist()
    places, hashes = [], []
    for data in group.column("data"):
        data = data.as_py()
        at, used = unpack_places(data)
        places.append(at)
        hashes.append(np.frombuffer(data, dtype="<u8", offset=used))
    every = np.concatenate(hashes)
    order = np.argsort(every)
    ordered = every[order]
    same = np.zeros(len(every), dtype=bool)
    twice = ordered[1:] == ordered[:-1]
    same[order[1:][twice]] = True
    same[order[:-1][twice]] = True
    out, at = [], 0
    for chunk, p in zip(chunks, places, strict=True):
        found = p[same[at : at + len(p)]]
        at += len(p)
        if len(found):
            out.append((chunk, 1, pack_places(found)))
    return pa.table([list(c) for c in zip(*out, strict=True)] if out else [[], [], []], schema=_CHUNK)


def _intervals_of(window: int) -> Callable[[pa.Table], pa.Table]:
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("intervals", pa.binary())])

    def run(group: pa.Table) -> pa.Table:
        marks, listed = [], b""
        for kind, data in zip(group.column("kind").to_pylist(), group.column("data").to_pylist(), strict=True):
            if kind:
                marks.append(unpack_places(data)[0])
            else:
                listed = data
        rows = []
        if marks:
            (n,) = struct.unpack_from("<I", listed)
            ids = np.frombuffer(listed, "<i8", n, 4)
            nulls = np.frombuffer(listed, "u1", n, 4 + 8 * n)
            keys = np.frombuffer(listed, "<i8", n, 4 + 9 * n)
            first = np.zeros(n + 1, dtype=np.int64)
            np.cumsum(np.frombuffer(listed, "<u4", n, 4 + 17 * n), out=first[1:])
            flat = np.unique(np.concatenate(marks))
            # windows never leave their document, so that a gap or another document ends an interval
            doc = np.searchsorted(first, flat, side="right") - 1
            new = np.ones(len(flat), dtype=bool)
            new[1:] = (np.diff(flat) > window) | (np.diff(doc) > 0)
            begin = flat[new]
            end = flat[np.append(np.flatnonzero(new)[1:], len(flat)) - 1] + window
            doc = doc[new]
            edges = np.flatnonzero(np.diff(doc, prepend=-1, append=n))
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                d = int(doc[s])
                pairs = np.stack([begin[s:e], end[s:e]], axis=1) - first[d]
                rows.append((None if nulls[d] else int(ids[d]), int(keys[d]), pairs.astype("<u4").tobytes()))
        return pa.table([list(c) for c in zip(*rows, strict=True)] if rows else [[], [], []], schema=schema)

    return run


def repeated_intervals(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, key and intervals for the documents with repeated windows.

    docs must give the same rows in the same order when it is read again, as files do:
    places are counted in chunks of its partitions. key is xxhash64 of the text; intervals are pairs of word positions, begin and end,
    ascending and apart, as unsigned 32-bit integers. One row for each doc_id and key.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("key"), "text").filter("text is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(2 * tasks, -(-size // BUCKET_BYTES))
    found = _chunk_rows(rows, window, buckets).groupBy("bucket").applyInArrow(_repeated, "chunk long, kind byte, data binary")
    return found.groupBy("chunk").applyInArrow(_intervals_of(window), "doc_id long, key long, intervals binary").groupBy("doc_id", "key").agg(F.first("intervals").alias("intervals"))


def with_intervals(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with a binary column __intervals, null where nothing is removed."""
    marks = repeated_intervals(docs, window).select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), F.col("intervals").alias("__intervals"))
    on = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__key"))
    return docs.join(marks, on, "left").drop("__id", "__key")


def kept_words(text: str, intervals: bytes | None) -> tuple[list[bytes], int]:
    """The words left and the number removed."""
    words = text.encode("utf-8", "surrogatepass").split()
    if not intervals:
        return words, 0
    pairs = np.frombuffer(intervals, "<u4").reshape(-1, 2).tolist()
    kept, at = [], 0
    for begin, end in pairs:
        kept += words[at:begin]
        at = end
    kept += words[at:]
    return kept, len(words) - len(kept)


def removal_report(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document.

    Words covered by a window that starts anywhere else too are removed, judged on the
    input. A null or empty text has no words. Repeated rows repeat each other's
    windows; a null doc_id stays null; an empty table gives no rows; extra columns
    are ignored.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, intervals in zip(texts_of(batch), batch.column("__intervals").to_pylist(), strict=True):
                kept, removed = kept_words(text, intervals)
                rows.append((len(kept) + removed, removed, hashlib.sha256(b" ".join(kept)).hexdigest()))
            if rows:
                yield record_batch(schema, [batch.column("doc_id"), *zip(*rows, strict=True)])

    joined = with_intervals(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), window)
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with repeated passages cut out of text; other columns stay, whatever their names.

    A text that loses nothing is unchanged, a null one stays null; of another the kept
    words remain, joined by single spaces, none of a text that repeats as a whole.
    Repeated rows stay repeated; an empty table gives no rows.
    """
    return guarded(docs, lambda rows: _cut(rows, window))


def _cut(docs: DataFrame, window: int) -> DataFrame:
    order = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, intervals in enumerate(batch.column("__intervals").to_pylist()):
                if intervals:
                    texts[i] = b" ".join(kept_words(texts[i], intervals)[0]).decode("utf-8", "surrogatepass")
            columns = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in order]
            yield pa.RecordBatch.from_arrays(columns, names=order)

    return with_intervals(docs, window).mapInArrow(cut, docs.schema)
