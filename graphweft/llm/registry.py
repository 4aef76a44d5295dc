"""The registered queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphweft.llm import audit, bpe, licenses, lines, media, mixing, neighbours, ngrams, oracles, packing, phrases, substrings, toxicity, urls
from graphweft.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]

#: Vocabulary of op9; the path is a parameter of the operator.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Vocabulary of op12.
PACKING_VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.similarity_components(table(spark, sf_dir, "documents"))


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), "id % 50 = 0")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_substrings(table(spark, sf_dir, "documents"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents")).drop("spans")


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those columns of the license scan that SQL can express."""
    return licenses.license_scan(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary_path())


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(PACKING_VOCABULARY))


def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_neighbours": op3_neighbours,
    "op5_substring_dedup": op5_substring_dedup,
    "op4_source_mixing": op4_source_mixing,
    "op6_toxicity": op6_toxicity,
    "op7_url_filters": op7_url_filters,
    "op8_license_scan": op8_license_scan,
    "license_base": license_base,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_media_columns": op10_media_columns,
    "op11_filter_audit": op11_filter_audit,
    "op12_best_fit_packing": op12_best_fit_packing,
    "op13_phrase_mining": op13_phrase_mining,
}

SQL: dict[str, str] = {"op1_line_dedup": lines.SQL, "op4_source_mixing": oracles.MIXING, "op5_substring_dedup": oracles.SUBSTRINGS, "op7_url_filters": oracles.URLS, "license_base": oracles.LICENSES, "op11_filter_audit": oracles.AUDIT, "op13_phrase_mining": oracles.PHRASES}
