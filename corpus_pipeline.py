"""A corpus pipeline: quality, near duplicates, repeated passages, personal data, packing.

Stages take any table with the columns of documents, null in any of them, also an empty
one or one with further columns, which all stages but the last keep.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barloom.llm import ngram_join, packing, pii, quality, substring_dedup
from barloom.llm.common import stored, table
from barloom.llm.vocabulary import public_path

#: A language model's training sequences have this many ids.
SEQUENCE = 2048


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier does not reject.

    Learned from labels and the stage's own documents. Null texts count as empty, null
    metadata as a value of its own; repeated rows are kept or rejected alike. Without
    labels of both kinds all have the same score.
    """
    return quality.kept_by_quality(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 0.8 of its five-word shingles.

    The smallest doc_id stays. Rows with a null doc_id and texts without words all stay.
    """
    return ngram_join.one_of_each(docs, size=5, num=80, den=100)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 35 words or more that occur elsewhere.

    No row goes: a text that repeats as a whole becomes empty. Null and empty texts stay.
    """
    return substring_dedup.without_repeats(docs)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates for personal data, equal ones for equal data. No row goes."""
    return pii.without_personal_data(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences.

    A null or empty text is the end id alone; repeated rows are packed each.
    """
    return packing.pack_documents(docs, public_path("byte_bpe_50k.json"), capacity=SEQUENCE)


STAGES = [
    ("quality", keep_quality),
    ("near duplicates", one_of_near_duplicates),
    ("repeated passages", cut_repeats),
    ("personal data", replace_personal_data),
    ("packing", pack),
]

#: The classifier and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each stored before the next; no documents give no rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
