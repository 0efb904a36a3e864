"""Spelling variants: words that differ by one letter, grouped under the frequent form.

Two words that differ by one inserted, deleted or replaced letter have letter
multisets at a Hamming distance of at most two: a multiset is a binary vector
with one dimension per letter and occurrence. PartEnum signatures find such
pairs exactly. The dimensions are partitioned into groups; a replaced letter
touches at most two of them and an inserted or deleted one touches one, so the
vectors agree on all groups but two, or but one. A word's signatures enumerate
these choices of groups and project its vector on the rest. One letter also
leaves one half of a word as it is, so each signature goes with either half;
without that, multisets of short words are too much alike. Words that share a
signature meet by an equi-join (one shuffle by signature) and are verified.

Words of a signature are compared in pairs up to ``PAIRED`` of them. A larger
group, however large, is not: its words go on to a second join by the word with
one letter left out, whose groups the size of the alphabet bounds and where
every pair is a result. So no group is held whole and no pair is lost.

The number of groups of dimensions follows from the number of words; it changes
the work, not the result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations
from operator import ne

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeload.llm.common import chain, mix, stored

#: Letters that a word must have, and its occurrences.
MIN_LETTERS, MIN_COUNT = 7, 2
#: A form is this many times as frequent as its variant.
RATIO = 10
#: One run of letters in so many, by its hash, loses a letter.
SLIP = 31
#: Words of a signature that are compared in pairs.
PAIRED = 64
#: Words that a task counts before it hands them on.
KEYS = 250_000

_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
_ROWS = 500
# Pairs of words meet as equals (one letter replaced), or as a shorter and a longer one.
_EQUAL, _SHORTER, _LONGER = 0, 1, 2


def _runs(min_letters: int) -> re.Pattern[str]:
    return re.compile(f"[A-Za-zÀ-ÿ]{{{min_letters},}}")


def slipped(doc_id: str, word: str) -> str:
    """The word as the document has it: one letter short if its hash says so."""
    h = zlib.crc32(f"{doc_id}:{word}".encode())
    at = h % len(word)
    return word if h % SLIP else word[:at] + word[at + 1 :]


def word_counts(docs: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): words of enough letters and occurrences in column ``text`` of all rows, by ``doc_id``."""
    runs = _runs(min_letters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for first in range(0, batch.num_rows, _ROWS):
                rows = batch.slice(first, _ROWS)
                for doc_id, text in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                    start = zlib.crc32(f"{doc_id}:".encode())
                    lowered = text.lower() if text.isascii() else text.translate(_LOWER)
                    for word, n in Counter(runs.findall(lowered)).items():
                        h = zlib.crc32(word.encode(), start)
                        if h % SLIP == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < min_letters:
                                continue
                        found[word] += n
                if len(found) >= KEYS:
                    yield pa.RecordBatch.from_pydict({"word": [*found], "n": [*found.values()]})
                    found.clear()
        if found:
            yield pa.RecordBatch.from_pydict({"word": [*found], "n": [*found.values()]})

    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    )
    counts = rows.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= min_count)


def groups_for(words: int) -> int:
    """Groups of dimensions: more for more words, so that signatures stay selective."""
    return 3 if words < 5_000_000 else 4 if words < 100_000_000 else 5


class _Dimensions(dict):
    """Group and hash of a dimension, which is a letter and its how-manieth occurrence."""

    def __init__(self, groups: int) -> None:
        super().__init__()
        self.groups = groups

    def __missing__(self, dimension: tuple[str, int]) -> tuple[int, int]:
        letter, nth = dimension
        value = xxhash.xxh3_64_intdigest(f"{letter}{nth}".encode())
        self[dimension] = found = value % self.groups, value
        return found

    def sums(self, word: str) -> list[int]:
        """A hash of the word's vector on each group."""
        seen: dict[str, int] = {}
        out = [0] * self.groups
        for letter in word:
            nth = seen.get(letter, 0)
            seen[letter] = nth + 1
            group, value = self[letter, nth]
            out[group] += value
        return [value & 0xFFFFFFFFFFFFFFFF for value in out]


def _halves(word: str) -> list[bytes]:
    """The halves that a word can share with one of its length, one longer, and one shorter."""
    half, less = len(word) // 2, (len(word) - 1) // 2
    return [
        (word[:half]).encode(), (word[half:]).encode(),
        (word[:half]).encode(), (word[half:]).encode(),
        (word[:less]).encode(), (word[less + 1 :]).encode(),
    ]


def signatures(words: DataFrame, groups: int) -> DataFrame:
    """(key, side, word, n): a row for each signature of each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dimensions = _Dimensions(groups)
        digest = xxhash.xxh3_64_intdigest
        # of two groups each letter may be in: equal words differ in two at most, others in one
        equal = [[g for g in range(groups) if g not in out] for out in combinations(range(groups), 2)]
        unequal = [[g for g in range(groups) if g != out] for out in range(groups)]
        for batch in batches:
            for first in range(0, batch.num_rows, 5_000):
                rows = batch.slice(first, 5_000)
                texts = rows.column(0).to_pylist()
                sums = np.array([dimensions.sums(word) for word in texts], np.uint64).reshape(-1, groups)
                half = np.array([[digest(h) for h in _halves(w)] for w in texts], np.uint64).reshape(-1, 6)
                lengths = np.array([len(w) for w in texts], np.uint64)
                keys, sides = [], []
                for place in range(6):
                    side = (_EQUAL, _SHORTER, _LONGER)[place // 2]
                    # words meet under the length of the shorter one, and by the same half
                    start = mix(lengths - np.uint64(side == _LONGER), 2 * (side != _EQUAL) + place % 2)
                    for number, kept in enumerate(equal if side == _EQUAL else unequal):
                        vector = chain(start, sums[:, kept].sum(axis=1, dtype=np.uint64) + np.uint64(number))
                        keys.append(chain(vector, half[:, place]))
                        sides.append(np.full(len(texts), side, np.int8))
                at = pa.array(np.tile(np.arange(len(texts)), len(keys)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(sides)),
                     rows.column(0).take(at), rows.column(1).take(at)],
                    ["key", "side", "word", "n"],
                )

    return words.select("word", "n").mapInArrow(run, "key bigint, side tinyint, word string, n bigint")


def near(short: str, long: str) -> bool:
    """One letter replaced, or one letter of ``long`` left out."""
    if len(short) == len(long):
        return sum(map(ne, short, long)) == 1
    if len(long) - len(short) != 1:
        return False
    at = next((k for k, letter in enumerate(short) if letter != long[k]), len(short))
    return short[at:] == long[at + 1 :]


_MET = pa.schema(
    [("word", pa.string()), ("n", pa.int64()), ("other", pa.string()), ("other_n", pa.int64()), ("side", pa.int8())]
)
_MET_DDL = "word string, n bigint, other string, other_n bigint, side tinyint"


def _pairs_of(rows: list[tuple[int, str, int]]) -> Iterator[tuple]:
    """Near pairs among the words of a group."""
    for i, (side, word, n) in enumerate(rows):
        for other_side, other, m in rows[:i]:
            if side == other_side:
                found = side == _EQUAL and near(word, other)
            elif side == _LONGER:
                found = near(other, word)
            else:
                found = near(word, other)
            if found:
                yield word, n, other, m, None


def _meet(rows: DataFrame, limit: int | None) -> DataFrame:
    """Pairs of near words that share a key; words of groups beyond ``limit`` as they are, with their side.

    Without a limit the groups are those of words with one letter left out,
    which the alphabet bounds. Rows come sorted by key; a task holds no more than
    a batch, and no more of a group than ``limit``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, over = None, [], False
        out: list[tuple] = []

        def close() -> None:
            if not over and len(held) > 1:
                out.extend(_pairs_of(held))

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*out)) or [[]] * len(_MET)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _MET)], schema=_MET)

        for batch in batches:
            keys = batch.column(0).to_numpy()
            if not len(keys):
                continue
            cuts = np.flatnonzero(np.diff(keys)) + 1
            starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(keys)]])
            # groups of one row inside the batch meet nobody; the first and the last may go on
            wanted = ends - starts > 1
            wanted[[0, -1]] = True
            starts, ends = starts[wanted], ends[wanted]
            at = np.concatenate([np.arange(a, b) for a, b in zip(starts, ends, strict=True)])
            sides, words, ns = (batch.column(c).take(pa.array(at)).to_pylist() for c in (1, 2, 3))
            taken = 0
            for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                if keys[a] != key:
                    close()
                    key, held, over = keys[a], [], False
                for k in range(taken, taken + b - a):
                    held.append((sides[k], words[k], ns[k]))
                    if limit is not None and (over or len(held) > limit):
                        over = True
                        out.extend((word, n, None, None, side) for side, word, n in held)
                        held.clear()
                taken += b - a
                if len(out) >= 10_000:
                    yield batch_of()
        close()
        yield batch_of()

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, _MET_DDL)


def _without_a_letter(words: DataFrame) -> DataFrame:
    """(key, side, word, n): words by what is left of them without a letter, for those of large groups."""
    left = F.expr("transform(sequence(1, char_length(word)), i -> struct(i AS i, overlay(word placing '' from i for 1) AS t))")
    spread = words.where(F.col("side") != _SHORTER).select("side", "word", "n", F.explode(left).alias("left"))
    # a replaced letter leaves the same text at the same place; a longer word leaves the shorter one
    place = F.when(F.col("side") == _EQUAL, F.col("left.i")).otherwise(0)
    spread = spread.select(F.xxhash64(place, "left.t").alias("key"), "side", "word", "n").distinct()
    shorter = words.where(F.col("side") == _SHORTER).select(F.xxhash64(F.lit(0), "word").alias("key"), "side", "word", "n")
    return spread.unionAll(shorter)


def near_words(words: DataFrame, paired: int = PAIRED, groups: int | None = None) -> DataFrame:
    """(word, n, other, other_n): every word with each word that is one letter away, both ways."""
    groups = groups or groups_for(words.count())
    met = stored(_meet(signatures(words, groups), paired), "near-words")
    large = met.where(F.col("side").isNotNull()).select("side", "word", "n").distinct()
    rest = stored(_meet(_without_a_letter(large), None), "near-words")
    pairs = met.where(F.col("side").isNull()).unionAll(rest).drop("side")
    back = pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"),
                        F.col("n").alias("other_n"))
    # one shuffle: rows of a word are together, so are those of a word and another
    return pairs.unionAll(back).repartition("word").dropDuplicates(["word", "other"])


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): where the forms lead to; every round doubles the steps, and forms grow tenfold a step."""
    current = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = current.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = current.join(step, "root", "left")
        moved = F.col("next").isNotNull().alias("moved")
        joined = stored(joined.select("word", F.coalesce("next", "root").alias("root"), moved), "roots")
        current = joined.drop("moved")
        if not joined.where("moved").head(1):
            return current


def variants(
    docs: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, ratio: int = RATIO
) -> DataFrame:
    """(word, form, root, n, n_near, form_n): a row for each word of the texts.

    ``form`` is the most frequent word one letter away (ties: the smallest by
    code points) if it is ``ratio`` times as frequent, else null; ``root`` is
    where forms lead to, the word itself without one. Rows of ``docs`` count
    each, repeated or not; a null text has no words, a null id counts as empty
    text; further columns are not read. An empty table gives no rows.
    """
    words = stored(word_counts(docs, min_letters, min_count), "words")
    best = F.min(F.struct((-F.col("other_n")).alias("minus"), "other")).alias("best")
    around = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best)
    found = words.join(around, "word", "left")
    has_form = -F.col("best.minus") >= ratio * F.col("n")
    found = found.select(
        "word",
        F.when(has_form, F.col("best.other")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(has_form, -F.col("best.minus")).alias("form_n"),
    )
    found = stored(found, "variants")
    roots = _roots(found.where("form IS NOT NULL"))
    out = found.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def oracle_sql(min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, ratio: int = RATIO) -> str:
    """The same in DuckDB's SQL: near words share what is left of them without a letter."""
    upper = "".join(map(chr, range(65, 91)))
    lower = upper.lower()
    return f"""
    WITH RECURSIVE crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
            lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
        runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc_id, unnest(regexp_extract_all(
            translate(text, '{upper}', '{lower}'), '[A-Za-z\\x{{C0}}-\\x{{FF}}]{{{min_letters},}}')) AS run
            FROM documents),
        counted AS (SELECT doc_id, run, count(*) AS n, hex(encode(doc_id || ':' || run)) AS h FROM runs GROUP BY ALL),
        hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(h), 2),
                lambda i: 16 * instr('123456789ABCDEF', h[i]) + instr('123456789ABCDEF', h[i + 1]))),
                lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS crc
            FROM counted, crc_table),
        slipped AS (SELECT n, CASE WHEN crc % {SLIP} <> 0 THEN run
            ELSE substr(run, 1, crc % length(run)) || substr(run, crc % length(run) + 2) END AS word FROM hashed),
        words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM slipped WHERE length(word) >= {min_letters}
            GROUP BY word HAVING sum(n) >= {min_count}),
        places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
        less AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS t FROM places),
        near AS (SELECT a.word, b.word AS other, b.n AS other_n FROM less a JOIN less b
                ON a.t = b.t AND a.i = b.i AND a.word <> b.word
            UNION SELECT l.word, w.word, w.n FROM less l JOIN words w ON w.word = l.t
            UNION SELECT w.word, l.word, l.n FROM less l JOIN words w ON w.word = l.t),
        around AS (SELECT word, count(*) AS n_near, max(other_n) AS top,
            first(other ORDER BY other_n DESC, other) AS best FROM near GROUP BY word),
        found AS (SELECT w.word, CASE WHEN a.top >= {ratio} * w.n THEN a.best END AS form, w.n,
            coalesce(a.n_near, 0) AS n_near, CASE WHEN a.top >= {ratio} * w.n THEN a.top END AS form_n
            FROM words w LEFT JOIN around a ON a.word = w.word),
        steps AS (SELECT word, word AS place FROM found
            UNION ALL SELECT s.word, f.form FROM steps s JOIN found f ON f.word = s.place WHERE f.form IS NOT NULL),
        roots AS (SELECT s.word, s.place AS root FROM steps s JOIN found f ON f.word = s.place WHERE f.form IS NULL)
    SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM found f JOIN roots r ON r.word = f.word"""
