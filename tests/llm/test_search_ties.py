"""Nearest neighbours: ties, few vectors, and the bound of visits, against brute force."""

import numpy as np
import pytest

from lakeload.llm import ann
from tests.llm.test_corpus_operators import found_search, plain_search

SCHEMA = "vec_id bigint, embedding array<double>, score string, bucket int, digest int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)


def scaled_copies(count, dimension=16, others=100):
    draw = np.random.default_rng(count)
    base = draw.normal(size=dimension)
    rows = [(k, draw.normal(size=dimension).tolist()) for k in range(others)]
    rows += [(others + k, (base * draw.uniform(0.1, 9)).tolist()) for k in range(count)]
    return [*rows, (10_000, base.tolist()), (10_050, (base * 3).tolist())]


@pytest.mark.parametrize("block", [16, 4096])
def test_equal_scores_go_to_the_smaller_ids(spark, monkeypatch, block):
    monkeypatch.setattr(ann, "BLOCK", block)
    rows = scaled_copies(60)
    assert found_search(table(spark, rows)) == plain_search(rows)


def test_ties_are_kept_through_hashing(spark, monkeypatch):
    monkeypatch.setattr(ann, "SAMPLE", 150)
    monkeypatch.setattr(ann, "FIT_QUERIES", 10)
    rows = scaled_copies(300)
    found, want = found_search(table(spark, rows)), plain_search(rows)
    assert {q: found[q] for q in (10_000, 10_050)} == {q: want[q] for q in (10_000, 10_050)}


def test_all_are_compared_where_visits_do_not_reach(spark, monkeypatch):
    monkeypatch.setattr(ann, "SAMPLE", 150)
    monkeypatch.setattr(ann, "FIT_QUERIES", 10)
    monkeypatch.setattr(ann, "MAX_PROBES", 1)
    draw = np.random.default_rng(1)
    rows = [(k, draw.normal(size=32).tolist()) for k in range(400)]
    assert found_search(table(spark, rows)) == plain_search(rows)


def test_few_vectors_find_all_others(spark):
    draw = np.random.default_rng(2)
    rows = [(50 * k, draw.normal(size=24).tolist()) for k in range(4)]
    assert found_search(table(spark, rows)) == plain_search(rows)
