"""Shards of token ids by a rank file, and tables that change between their reads."""

import base64
from dataclasses import replace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from lakeload.llm import queries, shards

PATH, PATTERN = public_tokenizers.path(queries.RANKS), public_tokenizers.PATTERN
KIND = shards.Tokens(width=2, end=50_256, pad=50_257, ranks=PATH, pattern=PATTERN)


def landed(spark, tmp_path, rows, parts=3):
    schema = "doc_id bigint, text string, shard string, ids int"
    spark.createDataFrame([(*r, "x", 1) for r in rows], schema).repartition(parts).write.parquet(f"{tmp_path}/docs")
    return spark.read.parquet(f"{tmp_path}/docs")


def test_ids_of_texts_round_trip(spark, tmp_path):
    rows = [(k, f"Text {k} über {'word ' * (k % 70)}") for k in range(150)]
    docs = landed(spark, tmp_path, [*rows, (None, None), (7, ""), rows[3], rows[3], (8, "x" * 50_000)])
    found = shards.write_shards(docs, f"{tmp_path}/out", 5, 32, 50, KIND).collect()
    with open(PATH, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    stream = [i for r in docs.collect() for i in [*library.encode_ordinary(r["text"] or ""), 50_256]]
    count = -(-len(stream) // 32)
    grid = shards.read_slots(f"{tmp_path}/out", 0, count, 32, 50, 2)
    ordered = grid[shards.Permutation(count, 5).slot(np.arange(count))].reshape(-1).tolist()
    assert ordered[: len(stream)] == stream and set(ordered[len(stream) :]) <= {50_257}
    assert sorted(r["slot"] for r in found) == list(range(count))


@pytest.mark.parametrize("change", ["missing", "moved"])
def test_a_table_that_changes_is_refused(spark, tmp_path, monkeypatch, change):
    docs = landed(spark, tmp_path, [(k, "some text " * (k % 9)) for k in range(300)])
    plan = shards._plan

    def other(docs, tokens):
        starts = plan(docs, tokens)
        parts = sorted(p for p in starts if p >= 0)
        if change == "missing":
            del starts[parts[-1]]
        else:
            starts[parts[-1]] = 0
        return starts

    monkeypatch.setattr(shards, "_plan", other)
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 30))  # a task for each file
    try:
        with pytest.raises(Exception, match="did not come in the same rows"):
            shards.write_shards(docs, f"{tmp_path}/out", 5, 32, 50).collect()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_ids_out_of_range_are_refused(spark, tmp_path):
    docs = spark.createDataFrame([(1, [50_256])], "doc_id bigint, ids array<int>")
    docs.write.parquet(f"{tmp_path}/ids")
    with pytest.raises(Exception, match="token ids"):
        kind = shards.Tokens("ids", 2, 50_256, 50_257)
        shards.write_shards(spark.read.parquet(f"{tmp_path}/ids"), f"{tmp_path}/out", tokens=kind).collect()


def test_stored_lengths_give_the_ids_without_encoding(monkeypatch):
    texts = pa.array(["Some text, über 12", None, "", "x" * 900 + " \U0001f600"])
    data, begins = KIND.stream(texts)
    encode, sizes = shards._encoding(PATH, PATTERN).encode_to_numpy, shards._token_bytes(PATH)
    lengths = [sizes[encode(text or "")] for text in texts.to_pylist()]
    monkeypatch.setattr(shards, "_encoding", None)
    again, same = KIND.stream(texts, iter(lengths))
    assert again == data and same.tolist() == begins.tolist()
    with pytest.raises(RuntimeError, match="did not come in the same rows"):
        KIND.stream(texts, iter(lengths[::-1]))
    with pytest.raises(RuntimeError, match="did not come in the same rows"):
        KIND.stream(texts, iter(lengths[:2]))


def test_texts_are_encoded_once(spark, tmp_path, monkeypatch):
    docs = landed(spark, tmp_path, [(k, f"text {k} " * (k % 9)) for k in range(60)])
    used = []
    monkeypatch.setattr(shards, "shared_folder", lambda _, label: used.append(label) or f"{tmp_path}/{label}")
    shards.write_shards(docs, f"{tmp_path}/out", 5, 32, 50, KIND).collect()
    kind = replace(KIND, lengths=f"{tmp_path}/lengths")
    parts = [p for p in range(docs.rdd.getNumPartitions()) if (tmp_path / "lengths" / str(p)).exists()]
    stored = [one for p in parts for one in shards._stored_lengths(kind, p)]
    assert used == ["lengths"] and len(stored) == 60
    assert [int(one.sum()) for one in stored] == [len(r["text"]) for r in docs.collect()]
