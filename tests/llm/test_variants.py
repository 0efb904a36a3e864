"""Spelling variants against SQL by deleted letters, and against all pairs."""

import itertools
import random
import re
from collections import Counter

import duckdb
import pytest

from lakeload.llm import variants

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, word string, n int"


def by_sql(docs):
    base = duckdb.connect()
    base.register("documents", docs.select("doc_id", "text").toArrow())
    return sorted(base.execute(variants.oracle_sql()).fetchall())


def by_spark(docs):
    return sorted(tuple(r) for r in variants.variants(docs).collect())


def brute_force(docs):
    """Every pair of words, by a plain edit distance."""
    counts = Counter()
    for row in docs.select("doc_id", "text").collect():
        doc_id = "" if row.doc_id is None else str(row.doc_id)
        for run in re.findall("[A-Za-zÀ-ÿ]+", row.text or ""):
            word = variants.slipped(doc_id, "".join(c.lower() if c.isascii() else c for c in run))
            counts[word] += len(word) >= 7
    words = {w: n for w, n in counts.items() if n >= 2}

    def without(word):
        return [word[:i] + word[i + 1 :] for i in range(len(word))]

    around = {w: [] for w in words}
    for a, b in itertools.permutations(words, 2):
        replaced = len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1
        if replaced or a in without(b) or b in without(a):
            around[a].append((-words[b], b))
    forms = {}
    for word, found in around.items():
        if found and -min(found)[0] >= 10 * words[word]:
            forms[word] = min(found)[1]
    out = []
    for word, n in words.items():
        root = word
        while root in forms:
            root = forms[root]
        form = forms.get(word)
        out.append((word, form, root, n, len(around[word]), words.get(form)))
    return sorted(out)


def made_rows():
    chance = random.Random(5)
    bases = ["abcdefgh", "straßenBahn", "Übermütig", "aaaaaaaaa", "zurückgabe", "abcdefg", "permuted"]
    rows = []
    for k in range(260):
        word = chance.choice(bases)
        for _ in range(chance.choice([0, 0, 1, 1, 2])):
            at, letter = chance.randrange(len(word)), chance.choice("abeü×")
            word = chance.choice([word[:at] + letter + word[at + 1 :], word[:at] + word[at + 1 :], word[:at] + letter + word[at:]])
        rows.append((k % 90, f"{word} {word}, {chance.choice(bases)}-" * chance.choice([1, 1, 2, 30]), word, k))
    rows += [(500, "chainedwords " * 300 + "chainedword " * 25 + "chainedwor " * 2, "", 0)]
    return [*rows, (None, None, "x", 1), (None, "withoutid withoutid", None, None), (3, "", "", 0), *[rows[0]] * 3]


def test_given_documents_equal_sql(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    found = by_spark(docs)
    assert found == by_sql(docs) and any(row[1] for row in found)


def test_all_pairs_nulls_repeats_and_clashing_names(spark):
    docs = spark.createDataFrame(made_rows(), SCHEMA)
    found = by_spark(docs)
    assert found == brute_force(docs) == by_sql(docs)
    assert any(root != form for _, form, root, *_ in found if form)  # forms of forms


@pytest.mark.parametrize(("paired", "groups"), [(1, 3), (3, 4), (64, 5), (0, 3)])
def test_large_groups_lose_no_pair(spark, monkeypatch, paired, groups):
    """Words of the same letters fill their signatures; so do those of one letter."""
    letters = ["".join(p) for p in itertools.permutations("abcdefg")][::7]
    words = sorted({*letters, *(w[:3] + x + w[3:] for w in letters[::9] for x in "xy"), "a" * 7, "a" * 8, "a" * 9})
    table = spark.createDataFrame([(w, 2 + k) for k, w in enumerate(words)], "word string, n bigint").repartition(3)
    pairs = {(r.word, r.other, r.other_n) for r in variants.near_words(table, paired, groups).collect()}
    n = {w: 2 + k for k, w in enumerate(words)}
    near = ((a, b) for a, b in itertools.combinations(words, 2) if variants.near(*sorted((a, b), key=len)))
    want = {pair for a, b in near for pair in ((a, b, n[b]), (b, a, n[a]))}
    assert pairs == want and want


@pytest.mark.parametrize("rows", [[], [(1, None, None, None)], [(1, "few short words", "", 1)]])
def test_empty_tables_and_texts(spark, rows):
    assert by_spark(spark.createDataFrame(rows, SCHEMA)) == []


def test_very_long_words(spark):
    long = "ab" * 20_000
    rows = [(1, f"{long} {long}", "", 0), (2, f"{long}x {long}x", "", 0)]
    found = by_spark(spark.createDataFrame(rows, SCHEMA))
    assert [(len(r[0]) >= 39_999, r[4]) for r in found] == [(True, 1), (True, 1)]
