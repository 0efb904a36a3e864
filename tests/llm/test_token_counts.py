"""Token counts against the tokenizer library itself."""

import json
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lakeload.llm import queries, token_counts

SF_DIR = "/root/testdata/sf0.001"
PATH = public_tokenizers.path(queries.TOKENIZER)
SPECIAL = "<|endoftext|>"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def expected(library, texts):
    return [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_query_equals_library(spark, library):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip([d.doc_id for d in docs], expected(library, [d.text or "" for d in docs]), strict=True))
    got = queries.op13_token_counts(spark, SF_DIR).collect()
    assert {r.doc_id: r.n_tokens for r in got} == want and len(got) == len(docs)
    sizes = {d.doc_id: len((d.text or "").encode()) for d in docs}
    assert all(r.n_bytes == sizes[r.doc_id] and r.over_limit == (r.n_tokens > 512) for r in got)


def test_every_character_class_is_the_librarys(library):
    chosen = random.Random(7).sample([c for c in range(0x30000) if not 0xD800 <= c < 0xE000], 6000)
    texts = [f"a{c}b {c}{c} 1{c}{c}x{c} .{c}'s{c}" for c in map(chr, [*range(0x2100), *chosen])]
    counter = token_counts.load_counter(PATH)
    assert [counter.count(text) for text in texts] == expected(library, texts)


def test_special_strings_and_very_long_pretokens(library):
    texts = [
        "", " ", "\n\n", SPECIAL, f"a{SPECIAL}b {SPECIAL}{SPECIAL} ", SPECIAL[:-1], "x" * 200_000,
        "ab" * 50_000, " " * 60_000 + "a", "'s't're've'm'll'd", "𝔘𝔫𝔦 été ß 数字 ١٢", "a\x1cb\x85c\xa0d",
    ]
    counter = token_counts.load_counter(PATH)
    assert [counter.count(text) for text in texts] == expected(library, texts)


def test_stale_pairs_with_a_small_merge_table():
    letters = token_counts.byte_letters()
    vocab = {letter: i for i, letter in enumerate(letters)} | {"ab": 256, "bc": 257, "abc": 258, "aa": 259}
    spec = {
        "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True},
        "model": {"type": "BPE", "vocab": vocab, "merges": ["b c", "a b", "a bc", "a a"]},
    }
    counter = token_counts.Counter(spec)
    library = Tokenizer.from_str(json.dumps({"version": "1.0", "added_tokens": [], **spec, "pre_tokenizer": {
        **spec["pre_tokenizer"], "trim_offsets": True}}))
    texts = ["".join(random.Random(i).choices("abc", k=i % 17)) for i in range(300)]
    assert [counter.count(t) for t in texts] == expected(library, texts)


def test_nulls_repeats_clashing_names_and_empty_tables(spark):
    schema = "n_tokens string, doc_id bigint, text string"
    rows = [("x", 1, None), ("x", 1, None), (None, None, "a b"), ("", 2, "")]
    out = token_counts.count_table(spark.createDataFrame(rows, schema), PATH)
    assert out.columns == ["n_tokens", "doc_id", "text", "n_bytes", "n_tokens_"]
    assert sorted((r.n_bytes, r.n_tokens_) for r in out.collect()) == [(0, 0), (0, 0), (0, 0), (3, 2)]
    assert token_counts.count_table(spark.createDataFrame([], schema), PATH).count() == 0


def test_other_kinds_of_files_are_refused():
    spec = {"model": {"type": "BPE", "vocab": {}, "merges": []}, "normalizer": {"type": "Lowercase"}}
    with pytest.raises(ValueError, match="byte-level"):
        token_counts.Counter(spec)
