"""Quality by co-training: a view of the text and a view of the metadata.

Each view has a logistic model. Both start from labelled documents; in each round
either model labels the unlabelled documents it is surest of for the other. The
models are calibrated on labelled documents that neither learned from, and a last
logistic model over the two calibrated views scores all documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import dropped, is_held_out, record_batch, stored, texts_of, trimmed
from barloom.llm.toxicity import fit_logistic

FIT_DOCUMENTS = 12_000  # labelled documents that the views are fitted on
POOL_DOCUMENTS = 12_000  # unlabelled documents whose share ADDED bounds what a round adds
ROUNDS = 5
ADDED = 0.05  # share of the unlabelled documents that a view labels in a round
SURE = 0.9  # likelihood that a pseudo-label needs
METADATA_SLOTS = 64
PARTS = 64  # rows of sums that reach the driver

_KINDS = {"upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "digit": b"0123456789", "symbol": b"#$%&*+<=>@^_~\\{}[]", "bar": b"|", "shout": b"!?", "stop": b".,;:'\"()-/", "space": b" \t", "line": b"\n\r"}


def text_features(text: str) -> np.ndarray:
    """Shares of character classes, word and line statistics; no metadata."""
    data = text.encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    n = max(1, len(data))
    shares = [counts[list(k)].sum() / n for k in _KINDS.values()] + [counts[128:].sum() / n]
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    m, k = max(1, len(words)), max(1, len(lines))
    same = sum(a == b for a, b in zip(words, words[1:], strict=False)) / m
    shape = [len(set(words)) / m, same, 1 - len(set(lines)) / k, min(40.0, len(data) / m) / 10, np.log1p(m) / 5, np.log1p(m / k) / 3, float(not words)]
    used = counts[counts > 0] / n
    return np.array([*np.sqrt(shares), *shape, float(-(used * np.log(used)).sum()) if len(used) else 0.0])


def metadata_features(lang: str | None, source: str | None, size: int | None) -> np.ndarray:
    """Hashed language and source, and the recorded length; no text."""
    out = np.zeros(METADATA_SLOTS + 8)
    for name, value in (("lang", lang), ("source", source)):
        out[int.from_bytes(hashlib.blake2b(f"{name}={value}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") % METADATA_SLOTS] = 1.0
    if size is not None:
        scale = np.log1p(max(0, size))
        out[METADATA_SLOTS:] = np.exp(-((scale - np.arange(2, 10)) ** 2))
    return out


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _apply(beta: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(beta[0] + x @ beta[1:], -30, 30)))


@dataclass
class CoTrained:
    """Scaling, models, calibrations and the combination of the two views."""

    scale: list[tuple[np.ndarray, np.ndarray]]
    models: list[np.ndarray]
    calibrations: list[np.ndarray]
    combination: np.ndarray

    def scores(self, views: list[np.ndarray]) -> np.ndarray:
        columns = []
        for (mean, spread), model, own, x in zip(self.scale, self.models, self.calibrations, views, strict=True):
            columns.append(_logit(_apply(own, _logit(_apply(model, (x - mean) / spread))[:, None])))
        return _apply(self.combination, np.stack(columns, axis=1))


class Pool:
    """Unlabelled documents in memory."""

    def __init__(self, views: list[np.ndarray]):
        self.views = views
        self.n = len(views[0])
        self.waiting = np.ones(self.n, dtype=bool)

    def moments(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Sums and sums of squares of each view's features."""
        return [(u.sum(axis=0), (u * u).sum(axis=0)) for u in self.views]

    def surest(self, models: list[np.ndarray], scale: list[tuple[np.ndarray, np.ndarray]], takes: tuple[int, int]) -> list[tuple[list[np.ndarray], list[int]]]:
        """For each view the documents it newly labels (features of both views) and their labels."""
        out = []
        for v in (0, 1):
            p = _apply(models[v], (self.views[v] - scale[v][0]) / scale[v][1])
            rows, labels = [], []
            for label, take, sure in ((1, takes[0], p), (0, takes[1], 1 - p)):
                order = np.flatnonzero(self.waiting & (sure > SURE))
                order = order[np.argsort(-sure[order], kind="stable")][:take]
                self.waiting[order] = False
                rows.extend(order.tolist())
                labels.extend([label] * len(order))
            out.append(([u[rows] for u in self.views], labels))
        return out


class StoredPool:
    """Unlabelled documents' features in a stored table (row, id, v0, v1), all scored in Spark each round."""

    def __init__(self, features: DataFrame):
        self.features = features
        self.spark = features.sparkSession
        self.labelled: set[int] = set()  # rows that have a pseudo-label
        width = (len(text_features("")), METADATA_SLOTS + 8)
        schema = pa.schema([("part", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.float64()))])
        ddl = "part int, n long, sums array<double>"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, total = 0, np.zeros(2 * sum(width))
            for batch in batches:
                if len(batch):
                    n += len(batch)
                    total += np.concatenate([y for u in _matrices(batch) for y in (u.sum(axis=0), (u * u).sum(axis=0))])
            if n:
                yield record_batch(schema, [[TaskContext.get().partitionId() % PARTS], [n], [total]])

        def add(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, n, total = 0, 0, np.zeros(2 * sum(width))
            for batch in group:
                part, n = batch.column("part")[0].as_py(), n + sum(batch.column("n").to_pylist())
                total += batch.column("sums").flatten().to_numpy().reshape(len(batch), -1).sum(axis=0)
            yield record_batch(schema, [[part], [n], [total]])

        rows = sorted(features.select("v0", "v1").mapInArrow(run, ddl).groupBy("part").applyInArrow(add, ddl).collect())
        self.n = sum(r.n for r in rows)
        total = np.sum([r.sums for r in rows], axis=0) if rows else np.zeros(2 * sum(width))
        each = np.split(total, np.cumsum([width[0], width[0], width[1]]))
        self.sums = [(each[0], each[1]), (each[2], each[3])]

    def moments(self) -> list[tuple[np.ndarray, np.ndarray]]:
        return self.sums

    def surest(self, models: list[np.ndarray], scale: list[tuple[np.ndarray, np.ndarray]], takes: tuple[int, int]) -> list[tuple[list[np.ndarray], list[int]]]:
        sent = self.spark.sparkContext.broadcast((models, scale, np.array(sorted(self.labelled), dtype=np.int64)))
        most = 2 * sum(takes)  # what one view takes may be what the other one wanted
        schema = pa.schema([("view", pa.int32()), ("label", pa.int32()), ("sure", pa.float64()), ("id", pa.int64()), ("row", pa.int64())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            models, scale, done = sent.value
            for batch in batches:
                if not len(batch):
                    continue
                row, ids = batch.column("row").to_numpy(), batch.column("id").to_numpy()
                waiting = ~np.isin(row, done)
                for v, u in enumerate(_matrices(batch)):
                    p = _apply(models[v], (u - scale[v][0]) / scale[v][1])
                    for label, sure in ((1, p), (0, 1 - p)):
                        order = np.flatnonzero(waiting & (sure > SURE))
                        order = order[np.lexsort((row[order], ids[order], -sure[order]))][:most]
                        if len(order):
                            n = len(order)
                            yield record_batch(schema, [np.full(n, v), np.full(n, label), sure[order], ids[order], row[order]])

        found = self.features.mapInArrow(run, "view int, label int, sure double, id long, row long")
        found = found.withColumn("nth", F.expr("row_number() over (partition by view, label order by sure desc, id, row)")).filter(F.col("nth") <= most)
        ranked = sorted(found.collect(), key=lambda r: (r.view, -r.label, r.nth))
        chosen: list[list[tuple[int, int]]] = [[], []]
        for v in (0, 1):
            for label, take in ((1, takes[0]), (0, takes[1])):
                rows = [r.row for r in ranked if r.view == v and r.label == label and r.row not in self.labelled][:take]
                self.labelled.update(rows)
                chosen[v].extend((r, label) for r in rows)
        rows = [r for c in chosen for r, _ in c]
        if not rows:
            return [([], [])] * 2
        features = self._of(rows)
        return [([np.array([features[r][u] for r, _ in c]) for u in (0, 1)] if c else [], [label for _, label in c]) for c in chosen]

    def _of(self, rows: list[int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Both views' features of some rows; no table of them is built on the driver."""
        sent = self.spark.sparkContext.broadcast(np.array(sorted(rows), dtype=np.int64))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(np.isin(batch.column("row").to_numpy(), sent.value)))

        found = self.features.select("row", "v0", "v1").mapInArrow(run, "row long, v0 array<double>, v1 array<double>").toArrow()
        return {r: (np.array(a), np.array(b)) for r, a, b in zip(*(found.column(c).to_pylist() for c in ("row", "v0", "v1")), strict=True)}


def _matrices(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [batch.column(c).flatten().to_numpy().reshape(len(batch), -1) for c in ("v0", "v1")]


def co_train(views: list[np.ndarray], y: np.ndarray, pool: list[np.ndarray] | Pool | StoredPool, rounds: int = ROUNDS, added: float = ADDED, most: int | None = None) -> CoTrained:
    """Fit on labelled views, y in 0 and 1; a fifth of the labelled rows calibrates.

    All of the pool give the scaling and are scored in each round. A view labels the share
    added of the pool in a round, or of most documents where the pool is larger.
    """
    pool = Pool(pool) if isinstance(pool, list) else pool
    scale, both = [], []
    for x, (sums, squares) in zip(views, pool.moments(), strict=True):
        n = max(1, len(x) + pool.n)
        mean = (x.sum(axis=0) + sums) / n
        spread = np.maximum(np.sqrt(np.maximum(((x * x).sum(axis=0) + squares) / n - mean * mean, 0)), 1e-3)
        scale.append((mean, spread))
        both.append((x - mean) / spread)
    last = np.arange(len(y)) % 5 == 4
    if len(set(y[~last])) < 2 or len(set(y[last])) < 2:
        last = np.zeros(len(y), dtype=bool)
    fit = ~last
    calibrate = last if last.any() else fit
    base = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.99
    if len(set(y)) < 2:
        width = [x.shape[1] for x in views]
        constant = np.array([_logit(np.array([base]))[0], 0.0, 0.0])
        return CoTrained(scale, [np.zeros(w + 1) for w in width], [np.zeros(2)] * 2, constant)
    gained: list[tuple[list[np.ndarray], list[int]]] = [([], []), ([], [])]  # pseudo-labelled documents for each view

    def train(v: int) -> np.ndarray:
        rows, labels = gained[v]
        x = np.vstack([both[v][fit], *rows])
        return fit_logistic(x, np.concatenate([y[fit], np.array(labels, dtype=np.int64)]), ridge=1.0)

    models = [train(0), train(1)]
    take = int(added * (pool.n if most is None else min(pool.n, most)))
    for _ in range(rounds):
        for v, (found, labels) in enumerate(pool.surest(models, scale, (int(take * base), int(take * (1 - base))))):
            if labels:
                mean, spread = scale[1 - v]
                gained[1 - v][0].append((found[1 - v] - mean) / spread)
                gained[1 - v][1].extend(labels)
        models = [train(0), train(1)]
    calibrations, columns = [], []
    for v in (0, 1):
        raw = _logit(_apply(models[v], both[v][calibrate]))[:, None]
        own = fit_logistic(raw, y[calibrate], ridge=0.1)
        calibrations.append(own)
        columns.append(_logit(_apply(own, raw)))
    return CoTrained(scale, models, calibrations, fit_logistic(np.stack(columns, axis=1), y[calibrate], ridge=0.1))


def _views(texts: list[str], metadata: list[tuple]) -> list[np.ndarray]:
    return [np.array([text_features(t) for t in texts]), np.array([metadata_features(*m) for m in metadata])]


_META = ("lang", "source", "n_chars")


def fit(docs: DataFrame, labels: DataFrame, most: int = FIT_DOCUMENTS, pool: int = POOL_DOCUMENTS) -> CoTrained:
    """Fit on a bounded sample of the labels, chosen by a hash of doc_id, and all unlabelled documents.

    Held-out labels are not used. Of a doc_id with several rows the one of the smallest
    features counts. pool bounds only how many documents a round adds.
    """
    known = labels.filter("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min("quality").cast("int").alias("q"))
    known = known.filter(~is_held_out(F.col("id"))).orderBy(F.xxhash64("id")).limit(most)
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text", F.col("lang").cast("string"), F.col("source").cast("string"), F.col("n_chars").cast("long"))
    labelled = rows.join(F.broadcast(known), "id").mapInArrow(_featured(["id", "q"]), "id long, q int, v0 array<double>, v1 array<double>")
    one = labelled.groupBy("id").agg(F.min(F.struct("v0", "v1", "q")).alias("r")).select("id", "r.q", "r.v0", "r.v1")  # one row an id
    labelled = one.toArrow().sort_by("id").combine_chunks()
    free = rows.filter("id is not null").mapInArrow(_featured(["id"]), "id long, v0 array<double>, v1 array<double>")  # texts do not go to the join
    free = free.join(labels.select(F.col("doc_id").cast("long").alias("id")), "id", "left_anti")
    free = stored(free.withColumn("row", F.monotonically_increasing_id()), "features")

    width = (len(text_features("")), METADATA_SLOTS + 8)
    views = [labelled.column(c).combine_chunks().flatten().to_numpy().reshape(-1, w) for c, w in zip(("v0", "v1"), width, strict=True)]
    model = co_train(views, np.clip(labelled.column("q").to_numpy(), 0, 1).astype(np.int64), StoredPool(free), most=pool)
    dropped(docs.sparkSession, free)
    return model


def _featured(columns: list[str]):
    """Some columns and the features of both views."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.float64())
        for batch in batches:
            if len(batch):
                meta = list(zip(*(batch.column(c).to_pylist() for c in _META), strict=True))
                own = [batch.column(c) for c in columns]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(list(u), kind) for u in _views(texts_of(batch), meta))], names=[*columns, "v0", "v1"])

    return lambda batches: trimmed(run(batches))


def _scorer(model: CoTrained, batch: pa.RecordBatch) -> np.ndarray:
    meta = list(zip(*(batch.column(c).to_pylist() for c in _META), strict=True))
    return model.scores(_views(texts_of(batch), meta)) if meta else np.zeros(0)


def score(docs: DataFrame, model: CoTrained, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score (likelihood of quality 1) and keep of every document.

    A null text counts as empty, null metadata as a value of its own. Repeated rows stay
    repeated; a null doc_id stays null; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield record_batch(schema, [batch.column("doc_id"), pa.array(_scorer(sent.value, batch))])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string"), F.col("source").cast("string"), F.col("n_chars").cast("long"))
    found = rows.mapInArrow(run, "doc_id long, score double")
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def kept_by_quality(docs: DataFrame, model: CoTrained, threshold: float = 0.5) -> DataFrame:
    """docs without those scored below threshold; all columns stay.

    Rows are judged one by one: null texts as empty, repeated rows alike.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scorer(sent.value, batch) >= threshold))

    return docs.mapInArrow(lambda batches: trimmed(run(batches)), docs.schema)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labels and score all documents."""
    return score(docs, fit(docs, labels))
