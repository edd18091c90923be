"""One query for each operator of this subpackage, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from barloom.llm import ann, bpe, media, ngram_join, packing, pii, quality, substring_dedup, token_files, toxicity
from barloom.llm.common import table
from barloom.llm.vocabulary import public_path


def op1_adaptive_dimension_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.inner_product_neighbours(table(spark, sf_dir, "embeddings"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"))


def op4_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(table(spark, sf_dir, "documents"), public_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.surrogate_report(table(spark, sf_dir, "documents"))


def op6_quality_co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removal_report(table(spark, sf_dir, "documents"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_components(table(spark, sf_dir, "documents"), size=3, num=90, den=100).select("doc_id", "n_shingles", "component_id", "class_size")


def op9_rans_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_round_trip(table(spark, sf_dir, "documents"), public_path("word_bpe_49k.json"))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


#: op7 as SQL over whole tables; the others are not expressible in SQL or are
#: approximate, and are tested against brute force.
ORACLES: dict[str, str] = {
    "op7_substring_dedup": r"""
        WITH words AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        docs AS (SELECT row_number() OVER () AS n, doc_id, w FROM words),
        starts AS (SELECT n, unnest(range(1, len(w) - 33)) AS i FROM docs WHERE len(w) >= 35),
        hashed AS (SELECT n, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM starts JOIN docs USING (n)),
        repeated AS (SELECT n, i FROM (SELECT n, i, count(*) OVER (PARTITION BY h) AS c FROM hashed) WHERE c > 1),
        gone AS (SELECT n, list(DISTINCT p) AS places FROM (SELECT n, unnest(range(i, i + 35)) AS p FROM repeated) GROUP BY n),
        kept AS (SELECT doc_id, w, CASE WHEN places IS NULL THEN w ELSE list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(places, x[2])), lambda x: x[1]) END AS k
                 FROM docs LEFT JOIN gone USING (n))
        SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - len(k))::BIGINT AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
