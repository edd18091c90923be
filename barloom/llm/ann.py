"""Nearest neighbours by inner product: inverted lists with an adaptive dimension scan.

Vectors get one more component so that the largest inner product is the smallest
Euclidean distance, and are rotated at random. A list stores its vectors in blocks
of columns. For each query a scan adds up squared differences block by block; after
each block a hypothesis test on the distance estimated from the components so far
abandons candidates that are unlikely to beat the k-th best. Survivors get their
exact inner product from the original vectors. The nearest lists give each query a
k-th best; all other lists are scanned with it, but for those that the triangle
inequality rules out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import record_batch, stored

FIT_SAMPLE = 20_000  # vectors that centroids are fitted on
LIST_SIZE = 256  # distinct vectors a list is meant to have
MOST_LISTS = 4096
PROBES = 24  # lists that give the k-th best with which the others are scanned
CELL = 4096  # distinct vectors, or queries, of one task at most
WIDE = 16_384  # the same where whole groups of lists are scanned
COLUMNS = 16  # components in each block of columns
EPSILON = 2.1  # the test's width


def lifted(x: np.ndarray, norm: float) -> np.ndarray:
    """Add the component that makes all lengths norm."""
    return np.hstack([x, np.sqrt(np.maximum(norm * norm - (x * x).sum(axis=1), 0))[:, None]])


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def fit_centroids(x: np.ndarray, lists: int, rounds: int = 12, seed: int = 11) -> np.ndarray:
    """k-means; an empty cluster takes a random vector."""
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), size=lists, replace=lists > len(x))]
    for _ in range(rounds):
        near = nearest(x, centers, 1)[:, 0]
        order = np.argsort(near, kind="stable")
        counts = np.bincount(near, minlength=lists)
        filled = counts > 0
        starts = (np.cumsum(counts) - counts)[filled]
        centers[filled] = np.add.reduceat(x[order], starts, axis=0) / counts[filled, None]
        if not filled.all():
            centers[~filled] = x[rng.choice(len(x), size=int((~filled).sum()))]
    return centers


def nearest(x: np.ndarray, centers: np.ndarray, k: int) -> np.ndarray:
    """The k nearest centers of each row, nearest first."""
    out = []
    half = (centers * centers).sum(axis=1) / 2
    for at in range(0, len(x), 2048):
        d = half - x[at : at + 2048] @ centers.T
        if k == 1:
            out.append(d.argmin(axis=1)[:, None])
        else:
            part = np.argpartition(d, k - 1, axis=1)[:, :k] if k < d.shape[1] else np.tile(np.arange(d.shape[1]), (len(d), 1))
            out.append(np.take_along_axis(part, np.take_along_axis(d, part, axis=1).argsort(axis=1, kind="stable"), axis=1))
    return np.concatenate(out) if out else np.zeros((0, k), dtype=np.int64)


def adaptive_scan(queries: np.ndarray, vectors: np.ndarray, k: int, epsilon: float = EPSILON) -> list[np.ndarray]:
    """For each rotated query the vectors that no test abandoned.

    The first vectors are compared in full and give the k-th distance; the rest are
    scanned in blocks of columns and abandoned once the distance estimated from d
    components exceeds (1 + epsilon / sqrt(d)) times it.
    """
    n, dim = vectors.shape
    first = min(n, max(4 * k, 128))
    blocks = [np.ascontiguousarray(vectors[first:, c : c + COLUMNS]) for c in range(0, dim, COLUMNS)]
    sizes = [(b * b).sum(axis=1) for b in blocks]
    out = []
    full = ((vectors[:first] ** 2).sum(axis=1) - 2 * queries @ vectors[:first].T) + (queries**2).sum(axis=1)[:, None]
    worst = np.partition(full, k - 1, axis=1)[:, k - 1] if first > k else np.full(len(queries), np.inf)
    head = [np.flatnonzero(row <= w * (1 + 1e-9) + 1e-12) for row, w in zip(full, worst, strict=True)]
    if first == n:
        return head
    q0 = queries[:, :COLUMNS]
    partial = sizes[0][None, :] - 2 * q0 @ blocks[0].T + (q0**2).sum(axis=1)[:, None]

    def limit(w: np.ndarray | float, done: int):
        return w * (done / dim) * (1 + epsilon / np.sqrt(done)) ** 2

    keep = partial <= limit(worst, COLUMNS)[:, None]
    for i, q in enumerate(queries):
        left = np.flatnonzero(keep[i])
        distance = partial[i, left]
        for b, c in enumerate(range(COLUMNS, dim, COLUMNS), start=1):
            if not len(left):
                break
            difference = blocks[b][left] - q[c : c + COLUMNS]
            distance = distance + np.einsum("ij,ij->i", difference, difference)
            done = min(dim, c + COLUMNS)
            good = distance <= (limit(worst[i], done) if done < dim else worst[i] * (1 + 1e-9) + 1e-12)
            left, distance = left[good], distance[good]
        out.append(np.concatenate([head[i], left + first]))
    return out


def threshold_scan(queries: np.ndarray, vectors: np.ndarray, worst: np.ndarray, allowed: np.ndarray, epsilon: float = EPSILON) -> list[np.ndarray]:
    """For each rotated query the allowed vectors that no test against its worst abandoned.

    Worst are squared distances known before the scan. Blocks of columns are added for
    all vectors while many are left, then for those left only.
    """
    dim = vectors.shape[1]
    slack = 1e-12 * ((queries**2).sum(axis=1) + ((vectors**2).sum(axis=1).max() if len(vectors) else 0.0))
    keep, partial, done = allowed.copy(), np.zeros(allowed.shape), 0

    def limit(done: int) -> np.ndarray:
        return worst * ((done / dim) * (1 + epsilon / np.sqrt(done)) ** 2 if done < dim else 1 + 1e-9) + slack

    while done < dim and (done == 0 or keep.mean() > 0.1):
        q, b = queries[:, done : done + COLUMNS], vectors[:, done : done + COLUMNS]
        partial += (b * b).sum(axis=1)[None, :] - 2 * q @ b.T + (q**2).sum(axis=1)[:, None]
        done = min(dim, done + COLUMNS)
        keep &= partial <= limit(done)[:, None]
    row, column = np.nonzero(keep)
    distance = partial[row, column]
    while done < dim and len(row):
        difference = vectors[column, done : done + COLUMNS] - queries[row, done : done + COLUMNS]
        distance = distance + np.einsum("ij,ij->i", difference, difference)
        done = min(dim, done + COLUMNS)
        good = distance <= limit(done)[row]
        row, column, distance = row[good], column[good], distance[good]
    return np.split(column, np.searchsorted(row, np.arange(1, len(queries))))


def usable(vectors: DataFrame, dim: int | None = None) -> DataFrame:
    """vec_id and embedding (doubles) of the vectors that take part.

    Not those that are null, zero, hold null or non-finite components, have a null
    vec_id, or another length than dim (by default the commonest one, the smaller of
    equally common ones).
    """
    whole = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    good = "vec_id is not null and embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)"
    whole = whole.filter(good)
    if dim is None:
        common = whole.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
        dim = common.d if common else 0
    return whole.filter(F.size("embedding") == dim)


def inner_product_neighbours(vectors: DataFrame, k: int = 20, every: int = 20, probes: int = PROBES, list_size: int = LIST_SIZE) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k nearest vectors.

    Queries are the vectors whose vec_id is divisible by every; a query's own vec_id is
    no candidate. Score is the double-precision inner product of the original vectors,
    the nearest first, ties to the smaller vec_id. Equal vectors are scanned once: of
    each distinct vector the k + 1 smallest ids are enough for any result. Repeated
    rows count once. A table without usable vectors gives no rows. Each query probes at
    least probes lists, and more until they hold k + 1 candidates, and then all lists
    that can hold a vector nearer than the k-th so far; only the test loses neighbours.
    Centroids come from FIT_SAMPLE vectors at most; all vectors are in the lists.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    ranked = rows.withColumn("nth", F.expr("dense_rank() over (partition by embedding order by vec_id)")).filter(F.col("nth") <= k + 1)
    distinct = ranked.groupBy("embedding").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))
    base = stored(distinct.withColumn("vid", F.monotonically_increasing_id()), "vectors")
    about = base.agg(F.count("*").alias("n"), F.max(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)).alias("norm")).first()
    result = "query_id long, rank int, vec_id long, score double"
    if not about.n:
        return spark.createDataFrame([], result)
    n, norm = about.n, float(np.sqrt(about.norm))
    lists = int(min(MOST_LISTS, max(1, n // list_size)))
    sample = base.orderBy(F.xxhash64("embedding")).limit(FIT_SAMPLE).select("embedding") if n > FIT_SAMPLE else base.select("embedding")
    fit = lifted(np.array([r.embedding for r in sample.collect()]), norm)
    turn = rotation(fit.shape[1])
    centers = fit_centroids(fit @ turn, lists)
    sent = spark.sparkContext.broadcast((norm, turn, centers))

    def placed(count: np.ndarray | None):
        """Homes of vectors, or with the lists' sizes the lists that queries probe."""
        schema = pa.schema([("vid", pa.int64()), ("list", pa.list_(pa.int32())), ("far", pa.float64())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            norm, turn, centers = sent.value
            for batch in batches:
                if not len(batch):
                    continue
                x = batch.column("embedding").flatten().to_numpy().reshape(len(batch), -1)
                far = np.zeros(len(x))
                if count is None:
                    turned = lifted(x, norm) @ turn
                    home = nearest(turned, centers, 1).astype(np.int32)
                    out, far = list(home), np.sqrt(((turned - centers[home[:, 0]]) ** 2).sum(axis=1))
                else:
                    near = nearest(np.hstack([x, np.zeros((len(x), 1))]) @ turn, centers, len(centers))
                    enough = (np.cumsum(count[near], axis=1) >= k + 1).argmax(axis=1) + 1 if count.sum() > k else np.full(len(x), len(centers))
                    out = [r[: max(probes, e)] for r, e in zip(near.astype(np.int32), enough, strict=True)]
                yield record_batch(schema, [batch.column("vid"), pa.array(out, pa.list_(pa.int32())), pa.array(far)])

        return run

    ddl = "vid long, list array<int>, far double"
    homes = stored(base.select("vid", "embedding").mapInArrow(placed(None), ddl).select("vid", F.col("list")[0].alias("list"), "far"), "homes")
    sizes = homes.join(base.select("vid", F.size("ids").alias("many")), "vid").groupBy("list").agg(F.count("*").alias("n"), F.sum("many").alias("many"), F.max("far").alias("far")).collect()
    held = np.zeros(lists, dtype=np.int64)
    radius = np.full(lists, -np.inf)  # of lists without vectors
    for r in sizes:
        held[r.list], radius[r.list] = r.many, r.far
    cells = spark.createDataFrame([(r.list, -(-r.n // CELL)) for r in sizes], "list int, cells int")
    asked = rows.filter(F.col("vec_id") % every == 0)
    seekers = stored(asked.select("embedding").distinct().withColumn("vid", F.monotonically_increasing_id()), "queries")
    probes_of = stored(seekers.select("vid", "embedding").mapInArrow(placed(held), ddl).select("vid", "list"), "probes")
    probed = probes_of.select("vid", F.explode("list").alias("list"))
    many = probed.groupBy("list").agg(F.ceil(F.count("*") / CELL).cast("int").alias("parts"))
    grid = F.broadcast(cells.join(many, "list"))  # at most MOST_LISTS rows
    stock = homes.join(grid, "list").join(base, "vid").select("list", F.pmod(F.xxhash64("vid"), F.col("cells")).cast("int").alias("cell"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("query"), "embedding", "ids")
    asks = probed.join(grid, "list").join(seekers, "vid").select("list", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"), F.pmod(F.xxhash64("vid"), F.col("parts")).cast("int").alias("part"), F.col("vid").alias("query"), "embedding", F.array().cast("array<long>").alias("ids"))
    schema = pa.schema([("query", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def scan(group: pa.Table) -> pa.Table:
        norm, turn, _ = sent.value
        query = group.column("query").to_pylist()
        x = group.column("embedding").combine_chunks().flatten().to_numpy().reshape(len(query), -1)
        is_query = np.array([q is not None for q in query])
        queries, stock = x[is_query], x[~is_query]
        out = ([], [], [])
        if len(queries) and len(stock):
            ids = [i for i, q in zip(group.column("ids").to_pylist(), is_query, strict=True) if not q]
            names = [q for q in query if q is not None]
            turned = lifted(stock, norm) @ turn
            for at in range(0, len(queries), 512):
                part = queries[at : at + 512]
                left = adaptive_scan(np.hstack([part, np.zeros((len(part), 1))]) @ turn, turned, k + 1)
                for name, q, found in zip(names[at : at + 512], part, left, strict=True):
                    scores = [float(np.dot(stock[j], q)) for j in found]
                    best = sorted((-s, i) for s, j in zip(scores, found, strict=True) for i in ids[j])[: k + 1]
                    out[0].extend([name] * len(best))
                    out[1].extend(i for _, i in best)
                    out[2].extend(-s for s, _ in best)
        return pa.table([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    def foremost(found: DataFrame) -> DataFrame:
        return found.withColumn("nth", F.expr("row_number() over (partition by query order by score desc, vec_id)")).filter(F.col("nth") <= k + 1)

    found = stock.unionByName(asks).groupBy("list", "cell", "part").applyInArrow(scan, "query long, vec_id long, score double")
    top = stored(foremost(found).drop("nth"), "near")
    if lists > probes:
        bound = top.groupBy("query").agg(F.when(F.count("*") > k, F.min("score")).alias("least"))
        rest = seekers.join(probes_of, "vid").join(bound, F.col("vid") == F.col("query"), "left").select("vid", "embedding", "list", "least")
        top = foremost(top.unionByName(_rest_scanned(rest, homes, base, sent, sizes, radius, k)))
    else:
        top = foremost(top)
    best = top.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("nth", "vec_id", "score"))).alias("best"))
    named = asked.join(seekers, "embedding").select(F.col("vec_id").alias("query_id"), F.col("vid").alias("query")).distinct()
    own = named.join(best, "query").select("query_id", F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k).alias("best"))
    return own.select("query_id", F.posexplode("best").alias("at", "b")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))


def _rest_scanned(rest: DataFrame, homes: DataFrame, base: DataFrame, sent, sizes: list, radius: np.ndarray, k: int) -> DataFrame:
    """query, vec_id and score of what the lists that rest's queries have not probed hold.

    rest has each query's vid, embedding, probed lists and the least score that can
    still matter, null where any can. Lists go to tasks in groups; a query is sent once
    to each group that holds a list it needs.
    """
    spark = rest.sparkSession
    total = sum(r.n for r in sizes)
    wide = int(min(WIDE, max(1024, total // 16)))
    group_of, cells, full = np.full(len(radius), -1), [], wide
    for r in sorted(sizes, key=lambda r: r.list):
        if full + r.n > wide:
            cells, full = [*cells, 0], 0
        group_of[r.list], full = len(cells) - 1, full + r.n
        cells[-1] = max(1, -(-full // wide))
    schema = pa.schema([("vid", pa.int64()), ("group", pa.int32()), ("lists", pa.list_(pa.int32())), ("worst", pa.float64())])

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        norm, turn, centers = sent.value
        for batch in batches:
            if not len(batch):
                continue
            x = batch.column("embedding").flatten().to_numpy().reshape(len(batch), -1)
            size = (x * x).sum(axis=1)
            least = batch.column("least").to_numpy(zero_copy_only=False).astype(np.float64)
            worst = np.where(np.isnan(least), np.inf, np.maximum(norm * norm + size - 2 * least, 0))
            turned = np.hstack([x, np.zeros((len(x), 1))]) @ turn
            away = np.sqrt(np.maximum((turned**2).sum(axis=1)[:, None] - 2 * turned @ centers.T + (centers**2).sum(axis=1), 0))
            want = away - radius <= (np.sqrt(worst) + 1e-6 * np.sqrt(norm * norm + size))[:, None]
            want &= np.isfinite(radius)
            out = ([], [], [], [])
            for i, (vid, probed) in enumerate(zip(batch.column("vid").to_pylist(), batch.column("list").to_pylist(), strict=True)):
                want[i, probed] = False
                lists = np.flatnonzero(want[i])
                groups, starts = np.unique(group_of[lists], return_index=True)
                out[0].extend([vid] * len(groups))
                out[1].extend(groups.tolist())
                out[2].extend(part.astype(np.int32) for part in (np.split(lists, starts[1:]) if len(lists) else []))
                out[3].extend([float(worst[i])] * len(groups))
            yield record_batch(schema, [pa.array(c, f.type) for c, f in zip(out, schema, strict=True)])

    asks = stored(rest.mapInArrow(needed, "vid long, group int, lists array<int>, worst double"), "rest")
    many = asks.groupBy("group").agg(F.ceil(F.count("*") / WIDE).cast("int").alias("parts"))
    places = spark.createDataFrame([(int(g), int(c)) for g, c in enumerate(cells)], "group int, cells int")
    grid = F.broadcast(places.join(many, "group"))
    lists = F.broadcast(spark.createDataFrame([(r.list, int(group_of[r.list])) for r in sizes], "list int, group int"))
    none = F.lit(None)
    stock = homes.join(lists, "list").join(grid, "group").join(base, "vid").select("group", F.pmod(F.xxhash64("vid"), F.col("cells")).cast("int").alias("cell"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), none.cast("long").alias("query"), none.cast("double").alias("worst"), F.array("list").alias("lists"), "embedding", "ids")
    sought = asks.join(grid, "group").join(rest.select("vid", "embedding"), "vid").select("group", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"), F.pmod(F.xxhash64("vid"), F.col("parts")).cast("int").alias("part"), F.col("vid").alias("query"), "worst", "lists", "embedding", F.array().cast("array<long>").alias("ids"))
    result = pa.schema([("query", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def scan(group: pa.Table) -> pa.Table:
        norm, turn, centers = sent.value
        is_query = group.column("query").is_valid().to_numpy()
        x = group.column("embedding").combine_chunks().flatten().to_numpy().reshape(len(is_query), -1)
        out = ([], [], [])
        asking, held = group.filter(pa.array(is_query)), group.filter(pa.array(~is_query))
        if len(asking) and len(held):
            queries, stock = x[is_query], x[~is_query]
            ids = held.column("ids").to_pylist()
            home = held.column("lists").combine_chunks().flatten().to_numpy()
            names, worst, lists = asking.column("query").to_pylist(), asking.column("worst").to_numpy(), asking.column("lists").to_pylist()
            turned = lifted(stock, norm) @ turn
            for at in range(0, len(queries), 128):
                part = queries[at : at + 128]
                open_lists = np.zeros((len(part), len(centers)), dtype=bool)
                for i, own in enumerate(lists[at : at + 128]):
                    open_lists[i, own] = True
                left = threshold_scan(np.hstack([part, np.zeros((len(part), 1))]) @ turn, turned, worst[at : at + 128], open_lists[:, home])
                for name, q, found in zip(names[at : at + 128], part, left, strict=True):
                    scores = [float(np.dot(stock[j], q)) for j in found]
                    best = sorted((-s, i) for s, j in zip(scores, found, strict=True) for i in ids[j])[: k + 1]
                    out[0].extend([name] * len(best))
                    out[1].extend(i for _, i in best)
                    out[2].extend(-s for s, _ in best)
        return pa.table([pa.array(c, f.type) for c, f in zip(out, result, strict=True)], schema=result)

    return stock.unionByName(sought).groupBy("group", "cell", "part").applyInArrow(scan, "query long, vec_id long, score double")
