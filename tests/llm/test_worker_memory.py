"""What operators leave to Python workers: key filters without them, and memory that is given back."""

import tracemalloc

import corpus_pipeline
import pyarrow as pa
import regex
from pyspark.sql import functions as F

from lakeload.llm import common, decontaminate, splitting


def test_key_filter_needs_no_worker(spark, tmp_path):
    rows = spark.createDataFrame([*((k, k % 1000, "x") for k in range(3000)), (None,) * 3], "id int, k bigint, text string")
    rows.write.parquet(f"{tmp_path}/rows")
    spark.createDataFrame([(7,), (999,), (None,)], "k bigint").write.parquet(f"{tmp_path}/keys")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    mark = common.key_filter(spark.read.parquet(f"{tmp_path}/keys"))
    marked = mark(rows, F.col("k"), "maybe")
    assert marked.columns == [*rows.columns, "maybe"]
    assert "Python" not in marked._jdf.queryExecution().executedPlan().toString()
    found = marked.collect()
    assert len(found) == 3001
    passed = [r["k"] for r in found if r["maybe"]]
    assert sum(k in (7, 999, None) for k in passed) == 7 and len(passed) < 1000
    assert all(r["maybe"] is not None for r in found)


def test_an_empty_key_filter_lets_nothing_pass(spark):
    mark = common.key_filter(spark.createDataFrame([], "k bigint"))
    assert mark(spark.range(50), F.col("id"), "maybe").where("maybe").count() == 0


def test_memory_is_given_back_after_each_batch(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "release", lambda: calls.append(1))
    batches = [pa.RecordBatch.from_pydict({"a": list(range(n))}) for n in (7, 0, 3)]
    got = [b.num_rows for b in common.small(iter(batches), 4)]
    assert got == [4, 3, 0, 3] and len(calls) == 3


def test_the_characters_of_a_class_are_not_held_one_by_one():
    tracemalloc.start()
    try:
        found = splitting._assigned.__wrapped__()
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 8_000_000
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    assert found == "".join(regex.findall(r"[^\p{Cn}\p{Co}]+", every))


def test_classes_are_the_same_whatever_the_block(monkeypatch):
    classes = (r"\p{L}", r"\p{N}", r"\s")
    expected = [splitting.library_class.__wrapped__(name) for name in classes]
    monkeypatch.setattr(splitting, "BLOCK", 1 << 20)
    assert [splitting.library_class.__wrapped__(name) for name in classes] == expected


def test_decontamination_starts_no_workers_for_its_item_sizes(spark, tmp_path):
    passage = " ".join(f"word{k}" for k in range(20))
    rows = [(k, f"start {k} {passage} end") for k in range(3)] + [(9, "nothing of it"), (None, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/docs")
    spark.createDataFrame([(1, passage), (2, "another item of six words")], "item_id bigint, text string").write.parquet(
        f"{tmp_path}/items"
    )
    matches = decontaminate.contaminated(spark.read.parquet(f"{tmp_path}/docs"), spark.read.parquet(f"{tmp_path}/items"))
    assert "ExistingRDD" not in matches._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["doc_id"], r["item_id"], r["end_word"]) for r in matches.collect()) == [(k, 1, 22) for k in range(3)]


def test_a_stage_bounds_what_a_worker_gets_at_once(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    large = spark.range(0, 20_000, 1, 1).selectExpr("id", "repeat('abcdefgh', 250) AS text")

    def rows(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    spark.conf.unset(name)
    try:
        corpus_pipeline.tokens(spark, docs, "")
        found = [r["n"] for r in large.mapInArrow(rows, "n bigint").collect()]
        assert sum(found) == 20_000 and max(found) < 3000
        spark.conf.set(name, "1m")  # a bound of the session's own stays
        corpus_pipeline.tokens(spark, docs, "")
        assert spark.conf.get(name) == "1m"
    finally:
        spark.conf.unset(name)
