"""Toxicity from a weighted lexicon matched by Aho-Corasick.

Texts are folded first: accents stay, homoglyphs and digit substitutions inside words
become the letters they stand for. Entries are words and beginnings of words; an
exception phrase takes back the weight of the entries inside it. The score is a
logistic function of the summed weight, also in proportion to the length.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import dropped, is_held_out, record_batch, stored, texts_of

FIT_DOCUMENTS = 12_000  # labelled documents that the lexicon is learned from
SHORTEST = 4  # letters of a beginning

# Characters that are read as Latin letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l"}

_FOLD = str.maketrans(HOMOGLYPHS)
_HIDDEN = re.compile("[­​-‏⁠﻿]")
_MIXED = re.compile(r"(?<!\S)(?=\S*[a-zß-ÿ])(?=\S*[0-9@$!|])\S+")
_INNER = re.compile(r"(?<=[a-zß-ÿ0-9@$])[0-9@$!|](?=[a-zß-ÿ0-9@$])|(?<!\S)[0-9@$](?=[a-zß-ÿ])|(?<=[a-zß-ÿ])[013457](?![\w@])")
_NOT_WORD = re.compile(r"[\W_]+")


def folded(text: str) -> str:
    """Lower case with words between single spaces, one also at both ends."""
    if not text.isascii():
        text = _HIDDEN.sub("", unicodedata.normalize("NFKC", text))
    text = text.lower()
    if not text.isascii():
        text = text.translate(_FOLD)
    text = _MIXED.sub(lambda m: _INNER.sub(lambda d: DIGITS.get(d[0], d[0]), m[0]), text)
    return f" {_NOT_WORD.sub(' ', text).strip()} "


@dataclass
class Lexicon:
    """Weights of entries (a space before, and after if whole words) and of exceptions."""

    entries: dict[str, float] = field(default_factory=dict)
    exceptions: dict[str, float] = field(default_factory=dict)
    coefficients: tuple[float, ...] = (-3.0, 0.0, 0.0)

    def automaton(self):
        import ahocorasick

        out = ahocorasick.Automaton()
        for phrase, weight in [*self.entries.items(), *self.exceptions.items()]:
            out.add_word(phrase, (len(phrase), weight, phrase in self.exceptions))
        if len(out):
            out.make_automaton()
        return out


def measures(text: str, automaton) -> tuple[float, float]:
    """Log of the summed weight, and of the weight per hundred words."""
    text = folded(text)
    hits: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    if len(automaton):
        for end, (size, weight, exception) in automaton.iter(text):
            begin = end - size + 1
            if exception:
                spared.append((begin, end))
            else:
                hits[begin] = max(weight, hits.get(begin, 0.0))
    total, reach, k = 0.0, -1, 0  # reach: where the exceptions that have begun end
    spared.sort()
    for at in sorted(hits):
        while k < len(spared) and spared[k][0] <= at:
            reach = max(reach, spared[k][1])
            k += 1
        if at >= reach:
            total += hits[at]
    words = max(1, text.count(" ") - 1)
    return math.log1p(total), math.log1p(100 * total / (words + 50))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 40) -> np.ndarray:
    """Newton steps; the first coefficient is the constant."""
    x = np.hstack([np.ones((len(x), 1)), x])
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(x.shape[1]), x.T @ (y - p) - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def pieces(text: str) -> set[str]:
    """Words and beginnings of words of a text that may become entries."""
    words = set(folded(text).split())
    out = {f" {w} " for w in words}
    for w in words:
        out.update(f" {w[:size]}" for size in range(SHORTEST, min(9, len(w) + 1)))
    return out


def phrases(text: str, automaton) -> set[str]:
    """The entries of a text with the word before or after them."""
    text = folded(text)
    out = set()
    for end, (size, _, _) in automaton.iter(text):
        begin = end - size + 1
        stop = text.find(" ", begin + 1)
        before = text.rfind(" ", 0, begin) if begin else -1
        after = text.find(" ", stop + 1)
        if before >= 0:
            out.add(text[before : stop + 1])
        if after >= 0:
            out.add(text[begin : after + 1])
    return out


def chosen_entries(counts: Iterable[tuple[str, int, int]], n1: int, n0: int) -> dict[str, float]:
    """Weights of the pieces (piece, toxic documents, others) that are toxic far above the base rate.

    Of a beginning and its longer forms the stronger one stays.
    """
    share = n1 / (n1 + n0)
    weights, strong = {}, {}
    for piece, a, b in counts:
        weight = math.log((a + 0.5) / (n1 + 1)) - math.log((b + 0.5) / (n0 + 1))
        p = a / (a + b)
        strength = 2 * (a * math.log(p / share) + (b * math.log((1 - p) / (1 - share)) if b else 0.0)) if p > share else 0.0
        if weight > 1.6 and strength > 15:
            weights[piece], strong[piece] = weight, strength
    chosen: dict[str, float] = {}
    begun: set[str] = set()
    for piece in sorted(strong, key=lambda p: (-strong[p], -len(p), p)):
        # a longer form of a chosen beginning, or the beginning of a chosen form, adds little
        if piece not in begun and not any(piece[:size] in chosen for size in range(2, len(piece))):
            chosen[piece] = weights[piece]
            begun.update(piece[:size] for size in range(2, len(piece)))
    return chosen


def exceptions(counts: Iterable[tuple[str, int, int]], n1: int, n0: int) -> dict[str, float]:
    """Phrases (phrase, toxic documents, others) that other documents have far more often."""
    return {phrase: float(clean) for phrase, bad, clean in counts if clean >= 4 and clean / n0 > 4 * (bad + 0.5) / n1}


def learn(sample: DataFrame) -> Lexicon:
    """Entries, what spares them, and the score's coefficients, from texts and t (0 or 1).

    Pieces and phrases are counted in Spark; the driver gets the pieces of at least four
    toxic texts and two numbers a text.
    """
    totals = {r.t: r.n for r in sample.groupBy("t").agg(F.count("*").alias("n")).collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        return Lexicon(coefficients=(3.0 if n1 else -3.0, 0.0, 0.0))

    def counted(found, least: int, which: str) -> list[tuple[str, int, int]]:
        """(key, toxic texts, others) of the keys that found() gives for least texts of a kind."""
        schema = pa.schema([("key", pa.string()), ("t", pa.int32())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            every = found()
            for batch in batches:
                for text, t in zip(texts_of(batch), batch.column("t").to_pylist(), strict=True):
                    keys = list(every(text))
                    if keys:
                        yield record_batch(schema, [keys, [t] * len(keys)])

        rows = sample.select("text", "t").mapInArrow(run, "key string, t int").groupBy("key").agg(F.sum("t").alias("a"), F.sum(1 - F.col("t")).alias("b"))
        return sorted((r.key, r.a, r.b) for r in rows.filter(F.col(which) >= least).collect())

    lexicon = Lexicon(entries=chosen_entries(counted(lambda: pieces, 4, "a"), n1, n0))
    if lexicon.entries:
        first = Lexicon(lexicon.entries)

        def around():
            automaton = first.automaton()
            return lambda text: phrases(text, automaton)

        lexicon.exceptions = exceptions(counted(around, 4, "b"), n1, n0)
    known = Lexicon(lexicon.entries, lexicon.exceptions)
    schema = pa.schema([("x0", pa.float64()), ("x1", pa.float64()), ("t", pa.int32())])

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = known.automaton()
        for batch in batches:
            if len(batch):
                yield record_batch(schema, [*zip(*(measures(t, automaton) for t in texts_of(batch)), strict=True), batch.column("t")])

    rows = sorted(sample.select("text", "t").mapInArrow(measured, "x0 double, x1 double, t int").collect())
    x = np.array([(r.x0, r.x1) for r in rows])
    lexicon.coefficients = tuple(fit_logistic(x, np.array([r.t for r in rows], dtype=np.int64)).tolist())
    return lexicon


def fit(docs: DataFrame, labels: DataFrame, most: int = FIT_DOCUMENTS) -> Lexicon:
    """Learn from at most `most` labelled documents that are not held out.

    Which ones depends on a hash of doc_id only. Null labels, doc_ids and texts are
    left out; of repeated labels the larger counts, of the texts of a repeated doc_id
    the one of the smallest hash. The sample is stored; no text reaches the driver.
    """
    known = labels.filter("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").cast("int").alias("t"))
    known = known.filter(~is_held_out(F.col("id"))).orderBy(F.xxhash64("id")).limit(most)
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(known), "id").filter("text is not null")
    one = rows.groupBy("id").agg(F.min_by(F.struct("text", "t"), F.struct(F.xxhash64("text"), "text")).alias("r"))
    sample = stored(one.select("r.text", F.greatest(F.lit(0), F.least(F.lit(1), F.col("r.t"))).alias("t")), "sample")
    lexicon = learn(sample)
    dropped(docs.sparkSession, sample)
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    Null and empty texts get the score of a text without any entry. Repeated rows stay
    repeated, a null doc_id stays null and is not held out.
    """
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = sent.value.automaton()
        beta = np.array(sent.value.coefficients)
        for batch in batches:
            x = np.array([measures(t, automaton) for t in texts_of(batch)]).reshape(-1, 2)
            p = 1 / (1 + np.exp(-np.clip(beta[0] + x @ beta[1:], -30, 30)))
            yield record_batch(schema, [batch.column("doc_id"), pa.array(p)])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labels and score all documents."""
    return score(docs, fit(docs, labels))
