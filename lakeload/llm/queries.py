"""The registered queries of the operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeload.llm import (
    ann,
    backoff_lm,
    bpe,
    decontaminate,
    divergence,
    html_extract,
    langid,
    licenses,
    ngram_join,
    pii,
    shards,
    token_counts,
    variants,
)
from lakeload.llm.common import read_table
from lakeload.session import shared_folder

RANKS = "byte_bpe_50k.tiktoken"
#: Ids of the rank file; the next ones are free.
RANKS_SIZE = 50256
TOKENIZER = "byte_bpe_50k.json"
#: Documents with more tokens than this are over the limit.
TOKEN_LIMIT = 512


def op1_site_template_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read_table(spark, sf_dir, "pages"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    return decontaminate.contaminated(docs, benchmark).select("doc_id", "item_id", "score", "end_word")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return bpe.round_trip_digests(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op4_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff_lm.score(read_table(spark, sf_dir, "documents"))


def op5_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return pii.span_table(docs, pii.fit(docs))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return ngram_join.near_duplicates(docs).select("doc_id", "class_id", "n_links")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"))


def op8_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, ranks = read_table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS)
    ids = shards.Tokens(width=2, end=RANKS_SIZE, pad=RANKS_SIZE + 1, ranks=ranks, pattern=public_tokenizers.PATTERN)
    return shards.write_shards(docs, shared_folder(spark, "shards"), tokens=ids)


def op9_ecoc_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = langid.fit(langid.training_rows(docs))
    found = langid.predict_table(docs.select("doc_id", "text"), model)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


def op10_multiprobe_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read_table(spark, sf_dir, "embeddings"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read_table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(read_table(spark, sf_dir, "documents"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    counts = token_counts.count_table(docs, public_tokenizers.path(TOKENIZER)).drop("text")
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_site_template_removal": op1_site_template_removal,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_backoff_lm": op4_backoff_lm,
    "op5_crf_pii": op5_crf_pii,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_license_scan": op7_license_scan,
    "op8_training_order": op8_training_order,
    "op9_ecoc_language_id": op9_ecoc_language_id,
    "op10_multiprobe_hashing": op10_multiprobe_hashing,
    "op11_source_divergence": op11_source_divergence,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_token_counts": op13_token_counts,
}
