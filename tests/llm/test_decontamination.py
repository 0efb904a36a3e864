"""Decontamination of passages whose only seed is frequent, against aligning everything."""

import random

import numpy as np

from lakeload.llm import decontaminate
from lakeload.llm.common import ngrams


def plain_score(item, words):
    best, row = 0, [0] * (len(words) + 1)
    for x in item:
        new = [0]
        for j, y in enumerate(words):
            new.append(max(0, row[j] + (2 if x == y else -1), row[j + 1] - 1, new[j] - 1))
        best, row = max(best, *new), new
    return best / (2 * len(item))


def test_windows_of_frequent_seeds_are_aligned(spark):
    item = [f"w{k}" for k in range(32)]
    # the first four words are kept, then every fourth one is changed: a single seed
    passage = [w if k < 4 or k % 4 else f"x{k}" for k, w in enumerate(item)]
    rows = [(k, " ".join([f"a{k}", *passage, "z"])) for k in range(30)]
    rows += [(100 + k, " ".join(["same", *passage, "copy"])) for k in range(60)]
    rows += [(200 + k, " ".join([f"b{k}", *item[:4], *(f"c{k}_{i}" for i in range(30))])) for k in range(80)]
    rows += [(300, " ".join([*item[:4], *reversed(item[4:])])), (None, rows[0][1]), (301, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    benchmark = spark.createDataFrame([(7, " ".join(item))], "item_id bigint, text string")
    wanted = {}
    for doc_id, text in rows:
        score = plain_score(item, (text or "").split())
        if score >= decontaminate.THRESHOLD:
            wanted[doc_id] = score
    assert len(wanted) == 91
    for rare in (decontaminate.RARE, 10**6):  # rarity does not change what is found
        found = decontaminate.contaminated(docs, benchmark, rare=rare).collect()
        assert {r["doc_id"]: r["score"] for r in found} == wanted and len(found) == len(wanted)
        assert {r["end_word"] for r in found} == {33}


def test_bound_is_never_below_the_alignment():
    draw = np.random.default_rng(4)
    for _ in range(500):
        n = int(draw.integers(1, 5))
        item, window = (draw.integers(0, 5, draw.integers(n, 20)).astype(np.uint64) for _ in range(2))
        seeds = len(np.flatnonzero(np.isin(ngrams(item, n), ngrams(window, n))))
        assert decontaminate.best_possible(item, window, seeds, n) >= decontaminate.align(item, window)[0]
