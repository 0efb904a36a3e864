"""The source audit against SQL with a row for each group and term."""

import random

import duckdb
import pytest

from lakeload.llm import divergence

SF_DIR = "/root/testdata/sf0.001"
COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


def by_sql(docs):
    base = duckdb.connect()
    base.register("documents", docs.toArrow())
    found = base.execute(divergence.oracle_sql()).fetchall()
    return sorted(found)


def by_spark(docs):
    return sorted(tuple(r) for r in divergence.audit(docs).select(COLUMNS).collect())


def test_given_documents_equal_sql(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text", "lang", "source")
    assert by_spark(docs) == by_sql(docs)


def made_rows():
    """Long terms with common prefixes, many groups, odd characters, nulls, repeats."""
    chance = random.Random(3)
    stems = ["a" * 3, "b" * 9, "Über", "c" * 40, "дом" * 12, "x" * 17, "zz", "e" * 300]
    rows = []
    for k in range(150):
        words = [chance.choice(stems) + chance.choice(["", "A", "b" * chance.randrange(30), "é"]) for _ in range(12)]
        lang = chance.choice(["en", "fr", None, ""])
        rows.append((k, chance.choice([" ", "1", "\n", "_"]).join(words), lang, f"s{chance.randrange(4)}", k))
    rows += [(200 + k, None, "none", f"s{k}", 0) for k in range(3)]
    rows += [(7, "repeated repeated row", "re", None, 0)] * 3 + [(8, "only here repeated", "re", "x", 0)]
    return rows


SCHEMA = "doc_id bigint, text string, lang string, source string, term bigint"


def test_long_terms_nulls_repeats_and_clashing_names(spark):
    docs = spark.createDataFrame(made_rows(), SCHEMA)
    found = by_spark(docs)
    assert found == by_sql(docs)
    items = {(lang, item) for lang, _, part, item, _, _ in found if part == "term"}
    assert ("re", "row") in items and ("re", "only") not in items
    assert any(len(item) >= 300 for _, item in items)
    assert ("none", "s0", "pair", "s1", 0, 1) in found


def test_bounded_tables_and_full_filters_change_nothing(spark, monkeypatch):
    docs = spark.createDataFrame(made_rows(), SCHEMA)
    want = by_sql(docs)
    monkeypatch.setattr(divergence, "KEYS", 5)
    monkeypatch.setattr(divergence, "GROUPS", 0)
    monkeypatch.setattr("lakeload.llm.common.FILTER_BITS", 10)
    assert by_spark(docs) == want


@pytest.mark.parametrize("rows", [[], [(1, "", "en", "a", 0)], [(None, None, None, None, None)]])
def test_empty_tables_and_texts(spark, rows):
    assert by_spark(spark.createDataFrame(rows, SCHEMA)) == []
