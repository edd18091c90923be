"""Token ids as files of rANS blocks: write in doc_id order, read back.

A folder holds all that a reader needs, as Parquet:

    blocks   one block a row: part and block order the blocks, whatever file they are in;
             doc_ids, lengths and before (ids before the block in its part) locate the
             documents; payload is the coded block (see rans)
    table    the frequency of each id that occurs, shared by all blocks
    parts    the number of ids before each part
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import dropped, new_path, record_batch, sliced, stored, texts_of
from barloom.llm.rans import Decoder, FrequencyTable, encode
from barloom.llm.vocabulary import encoder

BLOCK = 524_288


def encoded_in_order(docs: DataFrame, tokenizer: str, end_id: int, vocabulary: int) -> DataFrame:
    """Rows of ids in ascending doc_id order, and a row of id counts for each part.

    Rows of one doc_id are in the order of their texts' hashes; null doc_ids come first.
    The rows of one doc_id, or one row repeated, may take several parts. A row has part, seq (order in the part), before (ids before it in the part), n and ids
    (little-endian, 16 bits); the counts row has seq -1 and 32-bit counts.
    """
    kinds = [("part", pa.int32()), ("seq", pa.int64()), ("doc_id", pa.int64()), ("before", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())]
    schema = pa.schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        own = encoder(tokenizer, "dropped", "<u2")
        counts = np.zeros(vocabulary, dtype=np.int64)
        end = np.array([end_id], dtype="<u2").tobytes()
        for batch in batches:
            texts = texts_of(batch)
            for a, b in sliced(texts, 1 << 20):
                ids = [x + end for x in own.encode(texts[a:b])]
                n = np.array([len(x) // 2 for x in ids], dtype=np.int64)
                counts += np.bincount(np.frombuffer(b"".join(ids), dtype="<u2"), minlength=vocabulary)
                sums = before + np.cumsum(n)
                yield record_batch(schema, [pa.array(np.full(b - a, part, dtype=np.int32)), pa.array(np.arange(seq, seq + b - a)), batch.column("doc_id").slice(a, b - a), pa.array(sums - n), pa.array(n), ids])
                seq, before = seq + b - a, int(sums[-1])
        if seq:
            yield record_batch(schema, [[part], [-1], [None], [0], [before], [counts.astype("<i8").tobytes()]])

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("hash"), F.spark_partition_id().alias("origin"))
    keys = ["doc_id", "hash", "origin"]
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys, "text").select("doc_id", "text")
    return ordered.mapInArrow(run, "part int, seq long, doc_id long, before long, n long, ids binary")


def id_counts(encoded: DataFrame, vocabulary: int) -> np.ndarray:
    """Occurrences of each id over all parts; the result has vocabulary entries."""
    schema = pa.schema([("id", pa.int32()), ("count", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("ids"):
                counts = np.frombuffer(data.as_py(), dtype="<i8")
                seen = np.flatnonzero(counts)
                yield record_batch(schema, [pa.array(seen.astype(np.int32)), pa.array(counts[seen])])

    found = encoded.filter("seq = -1").select("ids").mapInArrow(run, "id int, count long").groupBy("id").agg(F.sum("count").alias("count")).toArrow()
    out = np.zeros(vocabulary, dtype=np.int64)
    out[found.column("id").to_numpy()] = found.column("count").to_numpy()
    return out


def to_blocks(encoded: DataFrame, table: FrequencyTable) -> DataFrame:
    """Blocks of whole documents with about BLOCK ids each."""
    kinds = [("part", pa.int32()), ("block", pa.int64()), ("before", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("payload", pa.binary())]
    schema = pa.schema(kinds)
    frequency = table.frequency

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = FrequencyTable(frequency, np.cumsum(frequency) - frequency)
        held: list[tuple] = []
        total = 0

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(r[5] for r in held), dtype="<u2")
            return record_batch(schema, [[held[0][0]], [held[0][1]], [held[0][3]], [[r[2] for r in held]], [[r[4] for r in held]], [encode(ids, own)]])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (total >= BLOCK or row[0] != held[-1][0] or row[1] != held[-1][1] + 1):
                    yield flush()
                    held, total = [], 0
                held.append(row)
                total += row[4]
        if held:
            yield flush()

    return encoded.filter("seq >= 0").mapInArrow(run, "part int, block long, before long, doc_ids array<long>, lengths array<int>, payload binary")


def from_blocks(blocks: DataFrame, table: FrequencyTable) -> DataFrame:
    """part, doc_id, before, n_tokens and ids_crc32 from decoded payloads."""
    schema = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    frequency = table.frequency

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Decoder(FrequencyTable(frequency, np.cumsum(frequency) - frequency))
        for batch in batches:
            for part, before, doc_ids, lengths, payload in zip(*(batch.column(c).to_pylist() for c in ("part", "before", "doc_ids", "lengths", "payload")), strict=True):
                ids = own.decode(payload).astype("<u4")
                ends = np.cumsum(lengths)
                sums = [zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends, lengths, strict=True)]
                yield record_batch(schema, [pa.array(np.full(len(ends), part, dtype=np.int32)), doc_ids, pa.array(before + ends - np.array(lengths, dtype=np.int64)), pa.array(np.array(lengths, dtype=np.int64)), sums])

    return blocks.mapInArrow(run, "part int, doc_id long, before long, n_tokens long, ids_crc32 long")


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, vocabulary: int) -> None:
    """Write blocks, table and parts below path.

    Only one number a part and one count an id reach the driver. An empty table gives
    empty files; null texts count as empty.
    """
    spark = docs.sparkSession
    encoded = stored(encoded_in_order(docs, tokenizer, end_id, vocabulary), "ids")
    table = FrequencyTable.of_counts(id_counts(encoded, vocabulary))
    own = {"mode": "overwrite", "compression": "uncompressed"}
    to_blocks(encoded, table).write.parquet(f"{path}/blocks", **own)
    shares = [(i, int(n)) for i, n in enumerate(table.frequency) if n]
    spark.createDataFrame([*shares, (vocabulary, 0)], "id int, frequency long").coalesce(1).write.parquet(f"{path}/table", **own)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    parts = encoded.filter("seq = -1").select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    parts.write.parquet(f"{path}/parts", **own)
    dropped(spark, encoded)


def read_token_files(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files alone."""
    shares = spark.read.schema("id int, frequency long").parquet(f"{path}/table").toArrow()
    frequency = np.zeros(max(shares.column("id").to_pylist(), default=0), dtype=np.uint64)  # the last row gives the size only
    for i, n in zip(shares.column("id").to_pylist(), shares.column("frequency").to_pylist(), strict=True):
        if n:
            frequency[i] = n
    table = FrequencyTable(frequency, np.cumsum(frequency) - frequency)
    blocks = spark.read.schema("part int, block long, before long, doc_ids array<long>, lengths array<int>, payload binary").parquet(f"{path}/blocks")
    parts = spark.read.schema("part int, first long").parquet(f"{path}/parts")
    found = from_blocks(blocks, table).join(parts, "part")  # Spark broadcasts parts where its files are small
    return found.select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def token_file_round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2, vocabulary: int = 49_408) -> DataFrame:
    """Encode, write, read and decode all texts; null texts count as empty.

    An empty table gives no rows; repeated rows stay repeated; extra columns are
    ignored. vocabulary is the number of ids, at most 65,536.
    """
    path = new_path(docs.sparkSession, "tokens")
    write_token_files(docs, path, tokenizer, end_id, vocabulary)
    return read_token_files(docs.sparkSession, path)
