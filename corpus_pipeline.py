"""The corpus pipeline: five stages, each written as a table that the next one reads.

1. language: documents without a letter, or too close to two languages, go.
2. near_duplicates: one document of each group of near-duplicates stays.
3. decontamination: documents with a passage of a benchmark item go.
4. personal_data: personal data is replaced by its kind; ``n_chars`` follows.
5. tokens: every text is encoded, decoded again and compared; columns are
   those of ``documents`` plus ``ids`` (token ids) and ``round_trip``.

Every stage takes the columns of ``documents``; further columns pass through, also
those named as what a stage adds. An empty table gives an empty one. Rows with
a null id are rows like others; texts are taken whole, however long. A stage bounds
the bytes of a batch for Python workers, in a session without a bound of its own.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeload.llm import bpe, decontaminate, langid, ngram_join, pii
from lakeload.llm.common import bound_batches, read_table, stored

RANKS = "byte_bpe_50k.tiktoken"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told. Null, empty and letterless texts go; repeated rows get the same answer."""
    bound_batches(spark)
    found = langid.predict_table(docs, langid.fit(docs))
    pred, flag = found.columns[-3], found.columns[-1]
    return found.where((F.col(pred) != "und") & ~F.col(flag)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, the one of the smallest id; of repeated rows one stays.

    Null and wordless texts are near-duplicates of nothing, and stay. Ties of ids go to the smaller hash of the text.
    """
    bound_batches(spark)
    return ngram_join.one_per_class(docs, ngram_join.near_duplicates(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item. Null and empty texts stay; repeated rows stay or go together."""
    bound_batches(spark)
    matches = decontaminate.contaminated(docs, read_table(spark, sf_dir, "benchmark"))
    return decontaminate.without_contaminated(docs, matches)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind, and their new ``n_chars``. Null and empty texts are unchanged."""
    bound_batches(spark)
    clean = pii.redact_table(docs, pii.fit(docs))
    text = F.col(clean.columns[-1])
    changed = {"text": text}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(text.isNull(), F.col("n_chars")).otherwise(F.char_length(text).cast("bigint"))
    return clean.withColumns(changed).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and whether decoding gives it again. Null and empty texts have no ids."""
    bound_batches(spark)
    return bpe.encode_table(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, check=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("tokens", tokens),
]

#: Trained models, hashing and alignment cannot be said in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
