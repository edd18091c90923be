"""Similarity join of documents on word shingles with adaptive multi-match prefixes.

Shingles are ordered by estimated frequency, rare ones first. Two sets of enough
overlap share at least k shingles of their k-prefixes, whatever k each uses, taking
the smaller. Each document lengthens its prefix while the estimated cost of its
candidates falls. Candidates meet in the k-prefixes' beginnings, one of whose shingles
must be shared: for the larger set the first n - o + 1, where o is the smallest overlap
with any similar set, for the smaller set fewer, since its partners are as large as
itself at least. So texts that a passage makes almost similar do not meet in the
passage's shingles. Of two prefixes the one that ends earlier in the order holds all that
its set shares with the other among its own shingles, so that their overlap is at most
what the prefixes share and what lies after it; pairs that this bound rules out are
dropped, where shingles that no other component has are known not to be shared.

Documents of equal sets form one class; classes that share one of their smallest hashes
are first compared in blocks, in two rounds, so that a large group of near copies becomes
one component without all its pairs; the prefix join then finds every other link between
components, and each is verified on the whole texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import dropped, guarded, record_batch, sliced, stored, texts_of, trimmed
from barloom.llm.components import connected_components
from barloom.llm.hashing import mixed, shingle_sets

CELLS = 1 << 20  # of the frequency sketch
KEYS = 3  # smallest hashes of each round that compares blocks
_ORDERS = (0xA0761D6478BD642F, 0xE7037ED1A0B428DB)  # a round each
MOST_SENT = 200_000  # classes, of at most about 200 bytes each, that are broadcast to find their texts
BLOCK = 192  # texts compared with each other, or with one text, in a task


def required(n, num: int, den: int):
    """Smallest overlap of a set of n with any similar set."""
    return -(-num * n // den)


def frequency_sketch(docs: DataFrame, size: int) -> np.ndarray:
    """How many sets have a shingle in each of CELLS cells, over all documents."""
    blocks = 64
    schema = pa.schema([("block", pa.int32()), ("counts", pa.binary())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, dtype=np.int64)
        for batch in batches:
            texts = texts_of(batch)
            for a, b in sliced(texts, 1 << 20):
                every = np.concatenate(shingle_sets(texts[a:b], size))
                total += np.bincount((every % np.uint64(CELLS)).astype(np.int64), minlength=CELLS)
        if total.any():
            parts = total.astype("<u4").reshape(blocks, -1)
            yield record_batch(schema, [pa.array(np.arange(blocks, dtype=np.int32)), [p.tobytes() for p in parts]])

    def add(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, block = np.zeros(CELLS // blocks, dtype=np.int64), 0
        for batch in group:
            block = batch.column("block")[0].as_py()
            for data in batch.column("counts"):
                total += np.frombuffer(data.as_py(), dtype="<u4")
        yield record_batch(schema, [pa.array([block], pa.int32()), [np.minimum(total, (1 << 32) - 1).astype("<u4").tobytes()]])

    out = np.zeros((blocks, CELLS // blocks), dtype=np.int64)
    for row in docs.select("text").mapInArrow(lambda batches: trimmed(count(batches)), "block int, counts binary").groupBy("block").applyInArrow(add, "block int, counts binary").collect():
        out[row.block] = np.frombuffer(row.counts, dtype="<u4")
    out = out.reshape(-1)
    return np.clip(out - int(np.median(out)), 1, (1 << 31) - 1).astype(np.int32)


def chosen_prefix(hashes: np.ndarray, sketch: np.ndarray, num: int, den: int) -> tuple[int, np.ndarray]:
    """How many shared shingles the prefix asks for, and the prefix.

    Empty when no other set can be similar. The cost of asking for k is a row for each
    shingle of the prefix, and the estimated number of other sets in the prefix's posting
    lists plus n for each candidate, of which there are at most 1/k of that number.
    """
    n = len(hashes)
    if den * n < num * (n + 1):
        return 1, hashes[:0]
    often = sketch[(hashes % np.uint64(CELLS)).astype(np.int64)]
    order = np.lexsort((hashes, often))
    need = int(required(n, num, den))
    k = np.arange(1, need + 1)
    others = np.cumsum(often[order] - 1.0)[n - need :]
    best = int(np.argmin(k + others * (1 + n / k))) + 1
    return best, hashes[order[: n - need + best]]


def end_in_order(prefix: np.ndarray, sketch: np.ndarray) -> int:
    """Grows with the place of the prefix's last shingle in the order; a few neighbours there have the same."""
    if not len(prefix):
        return 0
    return int(sketch[int(prefix[-1]) % CELLS]) << 32 | int(prefix[-1]) >> 32


def document_sets(docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """doc_id, key, n, digest, k, last, prefix and mins of each document's shingle set.

    key is xxhash64 of the text, last is end_in_order() of the prefix, mins are the KEYS smallest hashes in each order.
    """
    sketch = docs.sparkSession.sparkContext.broadcast(frequency_sketch(docs, size))
    longs = pa.list_(pa.int64())
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("k", pa.int32()), ("last", pa.int64()), ("prefix", longs), ("mins", longs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch)
            for a, b in sliced(texts, 1 << 20):
                rows = []
                for hashes in shingle_sets(texts[a:b], size):
                    k, prefix = chosen_prefix(hashes, sketch.value, num, den)
                    mins = np.concatenate([np.sort(mixed(hashes ^ np.uint64(x)))[:KEYS] for x in _ORDERS]) if len(prefix) else prefix
                    rows.append((len(hashes), hashlib.md5(hashes.tobytes()).digest(), k, end_in_order(prefix, sketch.value), prefix.view(np.int64), mins.view(np.int64)))
                yield record_batch(schema, [batch.column("doc_id").slice(a, b - a), batch.column("key").slice(a, b - a), *zip(*rows, strict=True)])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    return rows.mapInArrow(lambda batches: trimmed(run(batches)), "doc_id long, key long, n long, digest binary, k int, last long, prefix array<long>, mins array<long>")


def with_texts(wanted: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """wanted, a stored table with one row for each cid, with the text of a member of the class.

    Where few classes are wanted, the table is sent to the documents and no text moves. A
    row that repeats both doc_id and text gives a row more.
    """
    where = classes.select("cid", "rep.doc_id", "rep.key").join(wanted, "cid").withColumnsRenamed({"doc_id": "__id", "key": "__key"})
    texts = docs.select(F.col("doc_id").cast("long").alias("__doc"), F.xxhash64("text").alias("__text_key"), "text")
    if wanted.limit(MOST_SENT + 1).count() <= MOST_SENT:
        where = F.broadcast(where)
    found = texts.join(where, F.col("__doc").eqNullSafe(F.col("__id")) & (F.col("__text_key") == F.col("__key")))
    return found.select("text", *wanted.columns)


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def similar(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    low, high = sorted((len(a), len(b)))
    if den * low < num * high:
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return den * shared >= num * (low + high - shared)


def linked_in_blocks(keys: DataFrame, classes: DataFrame, docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Links that join the classes of each key, in blocks of about BLOCK classes.

    keys has key, cid and part; keys whose classes are all of one part, and keys with
    the same classes as another, are left out. In a block a class is compared with
    the members of each component found so far until one is similar.
    """
    groups = keys.groupBy("key").agg(F.count("*").alias("many"), F.min("part").alias("low"), F.max("part").alias("high"), F.sum(F.xxhash64("cid").cast("decimal(20,0)")).alias("sum"))
    groups = groups.filter("low <> high").groupBy("many", "low", "high", "sum").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("many") / BLOCK).cast("int").alias("blocks"))
    dealt = keys.join(groups, "key").select("cid", "part", F.struct("key", F.pmod(F.xxhash64("cid", "key"), F.col("blocks")).cast("int").alias("block")).alias("block"))
    dealt = stored(dealt.groupBy("cid", "part").agg(F.collect_list("block").alias("blocks")), "blocks")  # at most KEYS each

    def run(group: pa.Table) -> pa.Table:
        rows = sorted(zip(group.column("cid").to_pylist(), group.column("part").to_pylist(), range(len(group)), strict=True))
        sets = shingle_sets(group.column("text").to_pylist(), size)
        found: list[dict[int, np.ndarray]] = []  # components: their members' sets
        links = []
        for cid, part, at in rows:
            own = {cid: sets[at]}
            rest = []
            for component in found:
                hit = next((c for c, s in component.items() if similar(s, sets[at], num, den)), None)
                if hit is None:
                    rest.append(component)
                else:
                    links.append((hit, cid))
                    own |= component
            found = [*rest, own]
        return pa.table([[a for a, _ in links], [b for _, b in links]], schema=_LINKS)

    members = with_texts(dealt, classes, docs).select("cid", "part", "text", F.inline("blocks"))
    links = stored(members.groupBy("key", "block").applyInArrow(run, "a long, b long"), "links")
    dropped(docs.sparkSession, dealt)
    return links


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Those of the stored pairs (a, b) of classes whose whole texts have similar sets.

    Each a's partners are split into blocks of about BLOCK texts, and a's text goes
    to each block.
    """
    wanted = stored(pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct(), "wanted")
    fetched = stored(with_texts(wanted, classes, docs), "texts")
    blocks = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    heads = blocks.join(fetched, F.col("a") == F.col("cid")).select("a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(None).cast("long").alias("b"), "text")
    rest = pairs.join(blocks, "a").join(fetched, F.col("b") == F.col("cid")).select("a", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("block"), "b", "text")

    def run(group: pa.Table) -> pa.Table:
        ids = group.column("b").to_pylist()
        sets = shingle_sets(group.column("text").to_pylist(), size)
        head = sets[ids.index(None)]
        found = [b for b, own in zip(ids, sets, strict=True) if b is not None and similar(head, own, num, den)]
        return pa.table([[group.column("a")[0].as_py()] * len(found), found], schema=_LINKS)

    links = stored(heads.unionByName(rest).groupBy("a", "block").applyInArrow(run, "a long, b long"), "links")
    for used in (pairs, wanted, fetched):
        dropped(docs.sparkSession, used)
    return links


def candidates(lists: DataFrame, facts: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of classes of different parts whose prefixes do not rule out a link.

    lists has token, cid, part and place (in the order of the class's set) for the tokens
    that several parts have in prefixes; facts has n, k and last of each cid. A pair needs
    a shared token in the beginnings of both prefixes and as many in the whole prefixes as
    the smaller k, or as the required overlap leaves to them.
    """
    kept = lists.groupBy("cid").agg(F.count("*").alias("kept"), F.collect_list("token").alias("tokens"))
    tail = F.ceil(F.col("n") * num / den).cast("long") - F.col("k")
    each = stored(facts.join(kept, "cid").select("cid", "n", "k", "last", tail.alias("tail"), (tail + F.col("kept")).alias("most"), "tokens"), "prefixes")
    rows = lists.join(each.drop("tokens"), "cid").filter(f"place <= n - ({num} * n + {den} - 1) div {den}")
    short = rows.filter(f"place <= n - ({2 * num} * n + {num + den} - 1) div {num + den}")
    left, right = (side.select("token", *(F.col(c).alias(f"{c}_{name}") for c in ("cid", "part", "n", "k", "last", "tail", "most"))) for side, name in ((short, "a"), (rows, "b")))

    def bound(name: str) -> str:
        """name of the side whose prefix ends earlier."""
        return f"case when last_a < last_b then {name}_a when last_b < last_a then {name}_b else greatest({name}_a, {name}_b) end"

    overlap = f"{num} * (n_a + n_b)"  # times num + den
    met = left.join(right, "token").filter(
        f"(n_a < n_b or n_a = n_b and cid_a < cid_b) and part_a <> part_b and {den} * n_a >= {num} * n_b and {num + den} * ({bound('most')}) >= {overlap}"
    )
    asked = F.expr(f"greatest(least(k_a, k_b), cast(ceil({overlap} / {num + den}) as bigint) - ({bound('tail')}))")
    pairs = met.select(F.col("cid_a").alias("a"), F.col("cid_b").alias("b"), asked.alias("asked")).distinct()
    for side in "ab":
        pairs = pairs.join(each.select(F.col("cid").alias(side), F.col("tokens").alias(f"tokens_{side}")), side)
    return pairs.filter(F.size(F.array_intersect("tokens_a", "tokens_b")) >= F.col("asked")).select("a", "b")


def similar_components(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, key, n_shingles, class_size and component_id of every document.

    Two documents link when den * |A & B| >= num * |A | B| for their sets of distinct
    shingles of size words (A-Z lower-cased; the whole sequence where there are fewer
    words). component_id is the smallest doc_id reachable. Documents without words
    link with nothing and keep their own doc_id. Null doc_ids take part and are never
    the smallest unless alone. Repeated rows share a class; extra columns are ignored.
    """
    sets = stored(document_sets(docs, size, num, den), "sets")
    filled = sets.filter("n > 0")
    grouped = filled.groupBy("digest").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("rep"),
        F.count("*").alias("copies"),
        F.first("n").alias("n"),
        F.first("k").alias("k"),
        F.first("last").alias("last"),
        F.first("prefix").alias("prefix"),
        F.first("mins").alias("mins"),
    )
    classes = stored(grouped.withColumn("cid", F.monotonically_increasing_id()), "classes")
    kept = stored(sets.select("doc_id", "key", "n", "digest"), "documents")
    dropped(docs.sparkSession, sets)

    near = first = None
    for k in range(len(_ORDERS)):
        mins = F.filter(F.slice("mins", 1 + k * KEYS, KEYS), lambda x: x.isNotNull())
        part = F.col("cid") if first is None else F.coalesce("component", "cid")
        known = classes if first is None else classes.join(first, F.col("cid") == F.col("node"), "left")
        keys = known.select("cid", part.alias("part"), F.explode(mins).alias("key"))
        links = linked_in_blocks(keys, classes, docs, size, num, den)
        near = links if near is None else near.unionByName(links)
        first = connected_components(near)

    joined = classes.select("cid", "prefix").join(first, F.col("cid") == F.col("node"), "left")
    lists = joined.select("cid", F.coalesce("component", "cid").alias("part"), F.posexplode("prefix").alias("place", "token"))
    ends = lists.withColumn("low", F.expr("min(part) over (partition by token)")).withColumn("high", F.expr("max(part) over (partition by token)"))
    ends = stored(ends.filter("low <> high").select("token", "cid", "part", "place"), "lists")
    pairs = stored(candidates(ends, classes.select("cid", "n", "k", "last"), num, den), "pairs")
    dropped(docs.sparkSession, ends)
    far = verified(pairs, classes, docs, size, num, den)
    parts = connected_components(near.unionByName(far))

    labelled = classes.select("cid", "digest", "copies", "rep").join(parts, F.col("cid") == F.col("node"), "left").withColumn("component", F.coalesce("component", "cid"))
    least = labelled.groupBy("component").agg(F.min(F.col("rep.doc_id")).alias("component_id"))
    named = labelled.join(least, "component").select("digest", "copies", "component_id")
    out = kept.filter("n > 0").join(named, "digest").select("doc_id", "key", F.col("n").alias("n_shingles"), F.col("copies").alias("class_size"), "component_id")
    alone = kept.filter("n = 0").select("doc_id", "key", F.col("n").alias("n_shingles"), F.lit(1).cast("long").alias("class_size"), F.col("doc_id").alias("component_id"))
    return out.unionByName(alone)


def one_of_each(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one document of each component, the one of the smallest doc_id.

    Rows that repeat both doc_id and text count as one, and of several texts of the doc_id
    that stays one stays. Every row with a null doc_id stays, also one that repeats, and
    so do documents without words. All columns stay, whatever their names; an empty table
    gives no rows.
    """
    return guarded(docs, lambda rows: _one_of_each(rows, size, num, den))


def _one_of_each(docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    found = similar_components(docs, size, num, den).filter("n_shingles > 0 and doc_id is not null")
    stay = found.groupBy("component_id").agg(F.min(F.struct("doc_id", "key")).alias("stay"))
    leave = found.join(stay, "component_id").filter(F.struct("doc_id", "key") != F.col("stay")).select(F.col("doc_id").alias("__go"), F.col("key").alias("__go_key"))
    own = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    keyed = docs.withColumns({"__id": F.col("doc_id").cast("long"), "__key": F.xxhash64("text"), "__row": own})
    rest = keyed.join(leave, (F.col("__id") == F.col("__go")) & (F.col("__key") == F.col("__go_key")), "left_anti")
    return rest.dropDuplicates(["__id", "__key", "__row"]).drop("__id", "__key", "__row")
