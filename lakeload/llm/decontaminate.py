"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are runs of letters, digits and underscores in lower case.

1. One pass over the texts looks up every run of four words among those of the
   test items. A hit opens a window of the text, as wide as the item needs
   around the hit; overlapping windows of one item are merged. Only windows
   leave the pass, with the hashes of their words and the seeds they hold, and
   only those with enough words in common to reach the threshold (an exact
   bound: it drops no match).
2. Seeds are counted over all windows of the corpus. A window with one seed
   that is not rare, that is, more than ``rare`` windows have it and more than
   eight times the median of its item, is aligned once for all windows of the
   same words; the others are aligned where they are. Rarity only tells how a
   window is aligned, never whether.
3. Every window is aligned with its item by Smith-Waterman on words (match 2,
   mismatch and gap -1). A document is contaminated by an item if the best
   score is at least ``threshold`` of the score of a full match.

The test items are sent to the tasks in slices of a checked size, one pass per
slice; usual benchmarks take one. Null or wordless texts and items match
nothing. Items of fewer than four words have one seed, all their words.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeload.llm.common import WordHashes, key_filter, ngrams, row_key, small, stored

SEED_WORDS = 4
RARE = 50
THRESHOLD = 0.4
#: A slice of the test items holds about so many characters.
SLICE_CHARS = 8_000_000
_WORDS = re.compile(r"\w+")


@dataclass(frozen=True)
class Items:
    """Test items with their seeds in one sorted array."""

    ids: list[int | None]
    words: list[np.ndarray]
    seeds: np.ndarray  # sorted, with repeats
    item: np.ndarray  # of each seed
    place: np.ndarray  # of each seed in its item
    filter: np.ndarray  # by the top 20 bits of a seed


def _hashed(text: str | None, hashes: WordHashes) -> np.ndarray:
    found = _WORDS.findall((text or "").lower())
    return hashes.of(found, len(found))


def build_items(rows: list[tuple[int | None, str | None]], n: int = SEED_WORDS) -> Items:
    hashes, ids, words, parts = WordHashes(), [], [], []
    for item_id, text in rows:
        found = _hashed(text, hashes)
        if not len(found):
            continue
        seeds = ngrams(found, min(n, len(found)))
        parts.append((seeds, np.full(len(seeds), len(ids), np.int32), np.arange(len(seeds), dtype=np.int32)))
        ids.append(item_id)
        words.append(found)
    empty = (np.empty(0, np.uint64), np.empty(0, np.int32), np.empty(0, np.int32))
    seeds, item, place = (np.concatenate(x) for x in zip(empty, *parts, strict=True))
    order = np.argsort(seeds, kind="stable")
    filter_ = np.zeros(1 << 20, bool)
    filter_[seeds >> np.uint64(44)] = True
    return Items(ids, words, seeds[order], item[order], place[order], filter_)


def find_windows(words: np.ndarray, items: Items, sizes: list[int]) -> list[tuple[int, int, int, list[int]]]:
    """(item, start, end, seed places) of the windows of one text."""
    hits = []
    for n in sizes:
        grams = ngrams(words, n)
        at = np.flatnonzero(items.filter[grams >> np.uint64(44)])
        low = np.searchsorted(items.seeds, grams[at], "left")
        high = np.searchsorted(items.seeds, grams[at], "right")
        for p, a, b in zip(at[high > low], low[high > low], high[high > low], strict=True):
            for k in range(a, b):
                hits.append((int(items.item[k]), int(p), int(items.place[k])))
    out: list[tuple[int, int, int, list[int]]] = []
    spans = []
    for item, p, q in hits:
        m = len(items.words[item])
        slack = m // 2 + 4
        spans.append((item, max(0, p - q - slack), min(len(words), p - q + m + slack), q))
    for item, start, end, q in sorted(spans):
        if out and out[-1][0] == item and start <= out[-1][2]:
            last = out[-1]
            last[3].append(q)
            out[-1] = (item, last[1], max(last[2], end), last[3])
        else:
            out.append((item, start, end, [q]))
    return out


def best_possible(item: np.ndarray, window: np.ndarray, seeds: int, n: int) -> int:
    """No alignment of a window that holds ``seeds`` seeds of ``n`` words scores more than this.

    A word matches at most as often as both hold it. A run of k matches without
    a break holds k - n + 1 seeds, and each break between runs costs 1.
    """
    values, counts = np.unique(item, return_counts=True)
    shared = window[np.isin(window, values)]
    found, others = np.unique(shared, return_counts=True)
    matches = int(np.minimum(counts[np.searchsorted(values, found)], others).sum())
    breaks = math.ceil((matches - seeds) / (n - 1)) - 1 if n > 1 else 0
    return 2 * matches - max(0, breaks)


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int]:
    """Best Smith-Waterman score, and the end (exclusive) of the alignment in the window."""
    steps = np.arange(len(window) + 1)
    above = np.zeros(len(window) + 1, np.int64)
    best, end = 0, 0
    for word in item:
        row = np.zeros_like(above)
        row[1:] = np.maximum(above[:-1] + np.where(window == word, 2, -1), above[1:] - 1)
        np.maximum(row, 0, out=row)
        # gaps along the row: the best start to the left, less its distance
        row = np.maximum.accumulate(row + steps) - steps
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
        above = row
    return best, end


def _slice_windows(docs: DataFrame, items: Items, n: int, threshold: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)
    sizes = sorted({min(n, len(w)) for w in items.words})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, hashes = shared.value, WordHashes()
        for batch in small(batches):
            rows = []
            for doc_id, text_hash, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = _hashed(text, hashes)
                for item, start, end, places in find_windows(words, items, sizes):
                    own, window, seeds = items.words[item], words[start:end], sorted(set(places))
                    if best_possible(own, window, len(seeds), min(n, len(own))) / (2 * len(own)) >= threshold:
                        rows.append((doc_id, text_hash, item, start, window.tobytes(), seeds))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names
            )

    names = ["doc_id", "text_hash", "item", "start", "words", "seeds"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int32())]
    schema = "doc_id bigint, text_hash bigint, item int, start int, words binary, seeds array<int>"
    narrow = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return stored(narrow.mapInArrow(run, schema), "windows")


def _aligned(windows: DataFrame, items: Items, threshold: float) -> DataFrame:
    """The rows of ``windows`` whose words reach the threshold, with item_id, score and end."""
    shared = windows.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, known = shared.value, {}
        for batch in small(batches):
            keep, found = [], []
            for item, words in zip(batch["item"].to_pylist(), batch["words"].to_pylist(), strict=True):
                key = item, words
                if key not in known:  # many documents share a passage
                    if len(known) > 20_000:
                        known.clear()
                    known[key] = align(items.words[item], np.frombuffer(words, np.uint64))
                score, end = known[key]
                share = score / (2 * len(items.words[item]))
                keep.append(share >= threshold)
                if keep[-1]:
                    found.append((items.ids[item], share, end))
            columns = list(zip(*found, strict=True)) or [[]] * 3
            added = [pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)]
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([*kept.columns, *added], [*kept.schema.names, *names])

    names = ["item_id", "score", "end"]
    kinds = [pa.int64(), pa.float64(), pa.int32()]
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in windows.schema.fields]
    return windows.mapInArrow(run, ", ".join([*fields, "item_id bigint, score double, end int"]))


def _slice_matches(docs: DataFrame, items: Items, n: int, rare: int, threshold: float) -> DataFrame:
    windows = _slice_windows(docs, items, n, threshold)
    counts = windows.select("item", F.explode("seeds").alias("seed")).groupBy("item", "seed").agg(
        F.count("*").alias("n")
    )
    # seeds that no window has count as 0 in the median of their item
    size = [max(1, len(w) - n + 1) for w in items.words]
    # from Arrow: rows given as a list would start Python workers of another kind beside those of the operators
    totals = docs.sparkSession.createDataFrame(
        pa.table([pa.array(range(len(size)), pa.int32()), pa.array(size, pa.int32())], ["item", "total"])
    )
    seen = counts.groupBy("item").agg(F.sort_array(F.collect_list("n")).alias("counts"))  # at most one per seed
    missing = F.col("total") - F.size("counts")
    middle = F.floor(F.col("total") / 2)
    median = F.when(middle < missing, F.lit(0)).otherwise(F.col("counts")[(middle - missing).cast("int")])
    limits = seen.join(totals, "item").select(
        "item", F.greatest(F.lit(rare), 8 * (median + 1)).alias("limit")
    )
    single = windows.where(F.size("seeds") == 1).withColumn("seed", F.col("seeds")[0])
    single = single.join(counts, ["item", "seed"]).join(limits, "item")
    columns = ["doc_id", "text_hash", "item", "start", "words"]
    few = single.where(F.col("n") <= F.col("limit")).select(*columns)
    direct = _aligned(few.unionByName(windows.where(F.size("seeds") > 1).select(*columns)), items, threshold)
    # windows of frequent seeds are often copies: each passage is aligned once, then joined to its documents
    many = single.where(F.col("n") > F.col("limit")).select(*columns)
    passages = _aligned(many.select("item", "words").distinct(), items, threshold)
    matches = direct.unionByName(many.join(passages, ["item", "words"]))
    end = (F.col("start") + F.col("end")).cast("bigint")
    return matches.select("doc_id", "text_hash", "item_id", "score", end.alias("end_word"))


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    seed_words: int = SEED_WORDS,
    rare: int = RARE,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """(doc_id, text_hash, item_id, score, end_word): the best alignment of each document and item.

    Repeated rows count once. ``end_word`` is the place of the word after the
    aligned passage, the first one for equal scores.
    """
    docs, benchmark = docs.select("doc_id", "text"), benchmark.select("item_id", "text").distinct()
    size = benchmark.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    slices = max(1, math.ceil(size / SLICE_CHARS))
    parts = []
    for k in range(slices):
        rows = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k).collect()
        items = build_items(sorted(((r["item_id"], r["text"]) for r in rows), key=repr), seed_words)
        if items.ids:
            parts.append(_slice_matches(docs, items, seed_words, rare, threshold))
    if not parts:
        return docs.sparkSession.createDataFrame(
            [], "doc_id bigint, text_hash bigint, item_id bigint, score double, end_word bigint"
        )
    matches = reduce(DataFrame.unionByName, parts)
    best = F.max(F.struct("score", (-F.col("end_word")).alias("place"))).alias("best")
    best = matches.groupBy("doc_id", "text_hash", "item_id").agg(best)
    return best.select(
        "doc_id", "text_hash", "item_id", "best.score", (-F.col("best.place")).alias("end_word")
    )


def without_contaminated(docs: DataFrame, matches: DataFrame) -> DataFrame:
    """The rows of ``docs`` that no test item matches. Few others than the matching rows are shuffled."""
    bad = matches.select(F.coalesce("doc_id", F.lit(-1)).alias("__id"), F.col("text_hash").alias("__hash"))
    bad = stored(bad.distinct(), "bad")
    mark = key_filter(bad.select(row_key(F.col("__id"), F.col("__hash"))))
    keyed = docs.withColumns({"__id": F.coalesce("doc_id", F.lit(-1)), "__hash": F.xxhash64("text")})
    keyed = mark(keyed, row_key(F.col("__id"), F.col("__hash")), "__maybe")
    rest = keyed.where("__maybe").join(bad, ["__id", "__hash"], "left_anti")
    return keyed.where("NOT __maybe").select(*docs.columns).unionByName(rest.select(*docs.columns))
