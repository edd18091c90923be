"""Byte-level BPE encoding and decoding by DuckDB recursive queries.

Words are rows of token and position. A round joins neighbouring tokens to the merge
table and contracts, in each word, the leftmost pair of minimum rank. Rounds go on until
no word has a pair.

In words of more than SHORT bytes a round contracts each pair of minimum rank within a
reach to either side, twice the length of the longest token that can occur; of pairs in a
row that overlap, every other one from the left. No contraction elsewhere can come before
and matter: a token that took one of the pair's two tokens away would lie within reach,
and the first of the contractions that make it would be of a pair there, which comes
later. Pairs of the same rank come from left to right and leave each other alone, but
where the new token begins or ends a pair of lower rank; of such pairs a round contracts
the leftmost within reach only. So the rounds do not grow with the word, and only changed rows are kept
between them.
"""

from __future__ import annotations

import base64
import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import record_batch, sliced, texts_of
from barloom.llm.vocabulary import PieceMemory, leading_pieces

BATCH_BYTES = 1 << 20
SHORT = 64

#: A row's key is its word's number times SHORT plus its position. A pair's cost is its
#: rank, its own position and the next token's, in that order.
_SHORT_ROUNDS = """
WITH RECURSIVE rounds(round, k, tok) AS (
    SELECT 0, k, tok FROM byte_rows
  UNION ALL
    (WITH pairs AS MATERIALIZED (
        SELECT p.round, p.k, p.tok, (g.m::BIGINT << 12) | ((p.k & 63) << 6) | (p.next & 63) AS cost
        FROM (SELECT round, k, tok, lead(tok) OVER w AS nxt, lead(k) OVER w AS next FROM rounds WINDOW w AS (ORDER BY k)) p
        LEFT JOIN short_merges g ON g.lr = CASE WHEN p.k >> 6 = p.next >> 6 THEN (p.tok::BIGINT << 32) | p.nxt END
    ), bests AS (
        SELECT k >> 6 AS word, min(cost) AS best FROM pairs WHERE cost IS NOT NULL GROUP BY k >> 6
    )
    SELECT round + 1, k, CASE WHEN k & 63 = (best >> 6) & 63 THEN (best >> 12)::INTEGER ELSE tok END
    FROM pairs JOIN bests ON pairs.k >> 6 = bests.word
    WHERE k & 63 <> best & 63)
), last AS (
    SELECT k >> 6 AS word, max(round) AS round FROM rounds GROUP BY k >> 6
)
SELECT word, string_agg(tok::VARCHAR, ',' ORDER BY k) AS ids, string_agg(hex, '' ORDER BY k) AS hex
FROM rounds JOIN last ON last.word = rounds.k >> 6 AND last.round = rounds.round JOIN vocabulary USING (tok)
GROUP BY word
"""

_ROUNDS = """
WITH RECURSIVE state(word, pos, tok) USING KEY (word, pos) AS (
    SELECT word, pos, tok FROM byte_rows
  UNION
    (WITH live AS (
        SELECT word, pos, tok, lead(tok) OVER w AS nxt, lead(pos) OVER w AS next
        FROM recurring.state WHERE tok >= 0 WINDOW w AS (PARTITION BY word ORDER BY pos)
    ), pairs AS (
        SELECT word, pos, next, g.m, row_number() OVER w AS nth, coalesce(lag(g.m) OVER w = g.m AND lag(next) OVER w = pos, false) AS follows,
               min(g.m::BIGINT << 32 | pos) OVER (PARTITION BY word ORDER BY pos RANGE BETWEEN {reach} PRECEDING AND {reach} FOLLOWING) AS best
        FROM live JOIN merges g ON g.l = live.tok AND g.r = live.nxt WINDOW w AS (PARTITION BY word ORDER BY pos)
    ), runs AS (
        SELECT *, max(CASE WHEN NOT follows THEN nth END) OVER w AS run, coalesce(max(CASE WHEN best >> 32 <> m THEN nth END) OVER w, 0) AS other
        FROM pairs WINDOW w AS (PARTITION BY word ORDER BY pos)
    ), chosen AS (
        SELECT word, pos, next, m FROM runs LEFT JOIN low_openers o ON o.tok = m
        WHERE CASE WHEN alone IS NULL THEN other < run AND (nth - run) % 2 = 0 ELSE (m::BIGINT << 32 | pos) = best END
    )
    SELECT word, pos, m FROM chosen UNION ALL SELECT word, next, -1 FROM chosen)
)
SELECT word, string_agg(tok::VARCHAR, ',' ORDER BY pos) AS ids, string_agg(hex, '' ORDER BY pos) AS hex
FROM state JOIN vocabulary USING (tok) GROUP BY word
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class DuckBpe:
    """Encodes and decodes distinct words with one DuckDB database in memory."""

    def __init__(self, ranks: dict[bytes, int], memory: str = "300MB"):
        import duckdb

        spill = os.path.join(tempfile.gettempdir(), f"barloom-duckdb-{os.getpid()}")  # made only if a word needs it
        self.con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": memory, "temp_directory": spill})
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        self.by_size = sorted(((len(t), frozenset(t)) for t in ranks), key=lambda x: -x[0])
        left, right, merged, openers = [], [], [], set()
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
                    openers |= {x for x in (a, b) if x > rank}
        for name, data in {
            "merges": {"l": pa.array(left, pa.int32()), "r": pa.array(right, pa.int32()), "m": pa.array(merged, pa.int32())},
            "low_openers": {"tok": pa.array(sorted(openers), pa.int32()), "alone": pa.array([True] * len(openers), pa.bool_())},
            "vocabulary": {"tok": pa.array(list(ranks.values()), pa.int32()), "hex": pa.array([t.hex() for t in ranks])},
        }.items():
            self.con.register("given", pa.table(data))
            self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.con.unregister("given")
        self.con.execute("CREATE TABLE short_merges AS SELECT (l::BIGINT << 32) | r AS lr, m FROM merges")

    def run(self, words: list[bytes]) -> list[tuple[bytes, bytes]]:
        """For each nonempty word its ids joined by commas, and the bytes of these ids."""
        out: list = [None] * len(words)
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        for short in (True, False):
            chosen = np.flatnonzero((sizes <= SHORT) == short)
            if not len(chosen):
                continue
            n = sizes[chosen]
            tok = self.byte_ids[np.frombuffer(b"".join([words[i] for i in chosen]), dtype=np.uint8)]
            word = np.repeat(chosen, n)
            pos = np.arange(len(tok)) - np.repeat(np.cumsum(n) - n, n)
            self.con.register("byte_rows", pa.table({"k": word * SHORT + pos, "tok": tok} if short else {"word": word, "pos": pos, "tok": tok}))
            found = self.con.sql(_SHORT_ROUNDS if short else _ROUNDS.format(reach=self.reach([words[i] for i in chosen]))).to_arrow_table()
            self.con.unregister("byte_rows")
            for i, ids, data in zip(*(found.column(c).to_pylist() for c in ("word", "ids", "hex")), strict=True):
                out[i] = (ids.encode(), bytes.fromhex(data))
        return out

    def reach(self, words: list[bytes]) -> int:
        """Twice the length of the longest token that can occur in the words."""
        met = frozenset(b"".join(words))
        return 2 * next((n for n, own in self.by_size if own <= met), 1)

    def run_all(self, words: list[bytes]) -> list[tuple[bytes, bytes]]:
        """run() over parts of about BATCH_BYTES."""
        out, begin, size = [], 0, 0
        for i, w in enumerate(words):
            if size and size + len(w) > BATCH_BYTES:
                out += self.run(words[begin:i])
                begin, size = i, 0
            size += len(w)
        return out + self.run(words[begin:])


def piece_maker(ranks: dict[bytes, int], pattern: str):
    """A function from pieces to (ids joined by commas, decoded bytes)."""
    import regex

    find, engine = regex.compile(pattern).findall, DuckBpe(ranks)

    def make(pieces: list[bytes]) -> list[tuple[bytes, bytes]]:
        matches = [find(p.decode("utf-8", "surrogatepass")) for p in pieces]
        distinct = list(dict.fromkeys(m for found in matches for m in found))
        known = dict(zip(distinct, engine.run_all([w.encode("utf-8", "surrogatepass") for w in distinct]), strict=True))
        out = []
        for found in matches:
            both = [known[m] for m in found]
            out.append((b",".join(x[0] for x in both), b"".join(x[1] for x in both)))
        return out

    return make


_memories: dict[tuple[str, str], PieceMemory] = {}


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every text.

    A null or empty text has no tokens and the digests of nothing. Repeated rows stay
    repeated, a null doc_id stays null, extra columns are ignored, an empty table
    gives no rows.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (ranks_path, pattern)
        if key not in _memories:
            _memories[key] = PieceMemory(piece_maker(read_ranks(ranks_path), pattern), leading_pieces)
        memory = _memories[key]
        for batch in batches:
            texts = texts_of(batch)
            for a, b in sliced(texts, 1 << 20):
                rows = []
                for pieces in memory.look_up(texts[a:b]):
                    ids = b",".join([x[0] for x in pieces])
                    data = b"".join([x[1] for x in pieces])
                    rows.append((ids.count(b",") + 1 if ids else 0, hashlib.sha256(ids).hexdigest(), hashlib.sha256(data).hexdigest()))
                yield record_batch(schema, [batch.column("doc_id").slice(a, b - a), *zip(*rows, strict=True)])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
