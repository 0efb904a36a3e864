"""How the sources of a language differ in their words, over an iceberg of terms.

Only terms in at least ``MIN_DOCS`` documents of a language count. They are found
by prefix refinement: a document that holds a term holds each of its prefixes,
so a prefix in too few documents has no kept term below it. Prefixes of 8, 16,
32, ... bytes are counted level by level, by distinct documents; a level only
extends prefixes that the level before kept, and terms that end within its
length are counted themselves, by source. It ends when no longer prefix is left.

Tasks count their documents in bounded tables and give partial counts, so a
frequent term is one row a table flush and no hot key. The kept prefixes go to
the tasks as a set of bits of bounded size (``common.FILTER_BITS``): it may let
a dead prefix pass, whose extensions then fail by their own counts, so results
do not depend on it. The first level reads the texts; then the longer terms of
each document below a kept prefix are stored once, and deeper levels read these.

A row is a document, also if its id repeats. Null texts, languages and sources
count as empty; a group without a kept term still gets its rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lakeload.llm.common import ROWS, bit_set, small, stored

#: Documents of a language that a kept term must be in.
MIN_DOCS = 3
#: Ranks of the terms that speak most for a source.
TOP_TERMS = 200
#: Bytes of the first prefixes; every level doubles them.
FIRST = 8
#: Keys that a task counts, or remembers, before it hands them on or forgets them.
KEYS = 1_000_000
#: Groups (of language and source) that are sent to all tasks; more are joined by a shuffle.
GROUPS = 20_000

_SCALE = 1_000_000_000
# Bytes of terms as they are, A to Z in lower case, and a space for all others.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_COUNTS = pa.schema(
    [("lang", pa.string()), ("source", pa.string()), ("key", pa.binary()), ("whole", pa.bool_()),
     ("docs", pa.int64()), ("n", pa.int64())]
)
_COUNTS_DDL = "lang string, source string, key binary, whole boolean, docs bigint, n bigint"
_OPEN = pa.schema(
    [("lang", pa.string()), ("source", pa.string()), ("terms", pa.list_(pa.binary())), ("ns", pa.list_(pa.int64()))]
)
_OPEN_DDL = "lang string, source string, terms array<binary>, ns array<bigint>"


class _Alive:
    """The kept prefixes of ``length`` bytes, as bits."""

    def __init__(self, length: int, table: object, bits: int) -> None:
        self.length, self.table, self.bits = length, table, bits

    def seed(self, lang: str) -> int:
        return xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"), 42)

    def has(self, prefix: bytes, seed: int) -> bool:
        spot = xxhash.xxh64_intdigest(prefix, seed) >> (64 - self.bits)
        return bool(int(self.table.value[spot >> 6]) >> (spot & 63) & 1)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str, list[bytes]]]:
    """Language, source and terms in order of each document; bytes lower-case A to Z only."""
    for batch in small(batches):
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield lang, source, text.encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split()


class _Keys(dict):
    """What a level counts for a term: the term, its prefix, or None if it is out; for one language."""

    def __init__(self, lang: str, length: int, alive: _Alive) -> None:
        super().__init__()
        self.length, self.alive, self.seed = length, alive, alive.seed(lang)

    def __missing__(self, term: bytes) -> bytes | None:
        before, key = self.alive.length, term[: self.length]
        if len(term) <= before or not self.alive.has(term[:before], self.seed):
            key = None
        # long terms have longer lives in fewer documents, and take more room
        if len(self) >= KEYS // (4 + self.length // 16):
            self.clear()
        self[term] = key
        return key


def _first_level(docs: DataFrame, length: int, min_docs: int) -> DataFrame:
    """Counts of terms of up to ``length`` bytes, by source, and of prefixes of longer ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times: dict[tuple[str, str], Counter] = {}
        docs: dict[tuple[str, str], Counter] = {}
        prefixes: dict[str, Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for group, found in times.items():
                held = docs[group]
                yield _counts(*group, list(found), [held[key] for key in found], list(found.values()))
            for lang, found in prefixes.items():
                yield _counts(lang, None, list(found), list(found.values()), [0] * len(found))
            for tables in (times, docs, prefixes):
                tables.clear()

        counted = 0
        for lang, source, words in _texts(batches):
            if (lang, source) not in times:
                times[lang, source], docs[lang, source] = Counter(), Counter()
                counted += 1
            own, opened = times[lang, source], prefixes.setdefault(lang, Counter())
            counted -= len(own) + len(opened)
            short = [word for word in words if len(word) <= length]
            own.update(short)
            docs[lang, source].update(set(short))
            opened.update({word[:length] for word in words if len(word) > length})
            counted += len(own) + len(opened)
            if counted >= KEYS:
                yield from flush()
                counted = 0
        yield from flush()

    return _kept(docs.mapInArrow(run, _COUNTS_DDL), min_docs)


def _kept(parts: DataFrame, min_docs: int) -> DataFrame:
    """(lang, source, key, whole, n, lang_n) of terms and prefixes in enough documents of their language.

    One shuffle, by language and key, of what tasks have counted already.
    """
    sums = parts.repartition("lang", "key").groupBy("lang", "source", "key", "whole")
    sums = sums.agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    of_key = Window.partitionBy("lang", "key", "whole")
    sums = sums.withColumns({"all": F.sum("docs").over(of_key), "lang_n": F.sum("n").over(of_key)})
    return sums.where(F.col("all") >= min_docs).drop("docs", "all")


def _next_level(open_docs: DataFrame, length: int, alive: _Alive, min_docs: int) -> DataFrame:
    """The same for documents of open terms, below the prefixes that are alive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: dict[str, _Keys] = {}
        terms: dict[tuple[str, str], dict[bytes, int]] = {}
        prefixes: dict[str, Counter] = {}
        counted = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), found in terms.items():
                packed = list(found.values())
                yield _counts(lang, source, list(found), [v & _LOW for v in packed], [v >> 32 for v in packed])
            for lang, found in prefixes.items():
                yield _counts(lang, None, list(found), list(found.values()), [0] * len(found))
            terms.clear()
            prefixes.clear()

        for batch in small(batches):
            for lang, source, words, ns in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key_of = _keys_of(keys, lang, length, alive)
                own, found = terms.setdefault((lang, source), {}), prefixes.setdefault(lang, Counter())
                opened = set()
                for word, n in zip(words, ns, strict=True):
                    key = key_of[word]
                    if key is None:
                        continue
                    if len(word) > length:
                        opened.add(key)
                    else:
                        seen = own.get(word)
                        if seen is None:
                            seen, counted = 0, counted + 1 + length // 64
                        own[word] = seen + (n << 32) + 1
                counted += len(opened) * (1 + length // 64)
                found.update(opened)
            if counted + len(terms) >= KEYS:
                yield from flush()
                counted = 0
        yield from flush()

    return _kept(open_docs.mapInArrow(run, _COUNTS_DDL), min_docs)


def _keys_of(keys: dict[str, _Keys], lang: str, length: int, alive: _Alive) -> _Keys:
    """What is remembered for a language; of many languages the earlier ones are forgotten."""
    if lang not in keys:
        if len(keys) >= 16:
            keys.clear()
        keys[lang] = _Keys(lang, length, alive)
    return keys[lang]


_LOW = (1 << 32) - 1


def _counts(lang: str, source: str | None, keys: list, docs: list, ns: list) -> pa.RecordBatch:
    size = len(keys)
    columns = [[lang] * size, [source] * size, keys, [source is not None] * size, docs, ns]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _COUNTS)], schema=_COUNTS)


def _open_documents(docs: DataFrame, alive: _Alive) -> DataFrame:
    """The terms of each document that go on below a kept prefix; documents without any are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: dict[str, _Keys] = {}
        out: list[tuple] = []

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*out)) or [[]] * len(_OPEN)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _OPEN)], schema=_OPEN)

        for lang, source, words in _texts(batches):
            key_of = _keys_of(keys, lang, alive.length, alive)
            going = Counter([word for word in words if len(word) > alive.length and key_of[word] is not None])
            if going:
                out.append((lang, source, [*going], [*going.values()]))
            if len(out) >= ROWS:
                yield batch_of()
        yield batch_of()

    return docs.mapInArrow(run, _OPEN_DDL)


def term_counts(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, term, n, lang_n): occurrences of the kept terms in each source and each language.

    ``docs`` has text columns ``lang``, ``source`` and ``text`` without nulls.
    """
    spark = docs.sparkSession
    docs = docs.select("lang", "source", "text")
    length, levels = FIRST, []
    level = _first_level(docs, length, min_docs)
    while True:
        level = stored(level, f"terms-{length}")
        levels.append(level.where("whole"))
        table, bits, size = bit_set(level.where("NOT whole").select(F.xxhash64("lang", "key")))
        if not size:
            break
        alive = _Alive(length, spark.sparkContext.broadcast(table), bits)
        if length == FIRST:
            open_docs = stored(_open_documents(docs, alive), "open-terms")
        length *= 2
        level = _next_level(open_docs, length, alive, min_docs)
    whole = reduce(DataFrame.unionAll, levels)
    return whole.select("lang", "source", F.decode("key", "UTF-8").alias("term"), "n", "lang_n")


def _share(n: str, total: str, terms: str) -> str:
    """SQL of 1 + floor(10^9 (n + 1) / (total + terms)); decimals where the product may exceed 64 bits."""
    exact = f"(CAST({n} + 1 AS decimal(20,0)) * {_SCALE}BD) div ({total} + {terms})"
    return f"(1 + CASE WHEN {n} < 9000000000 THEN (({n} + 1L) * {_SCALE}L) div ({total} + {terms}) ELSE {exact} END)"


def _distance(p: str, q: str) -> str:
    """SQL of floor((p - q)^2 / q)."""
    return f"((({p}) - ({q})) * (({p}) - ({q})) div ({q}))"


def _groups(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """(lang, source, total, lang_total, v, base): one row a group, also for groups without terms.

    ``base`` is the share of a kept term that the source does not have.
    """
    occurring = docs.select("lang", "source").distinct()
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = counts.groupBy("lang", "term").agg(F.sum("n").alias("n"))
    langs = langs.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count("*").alias("v"))
    found = occurring.join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    found = found.fillna(0, ["total", "lang_total", "v"])
    base = F.expr(f"CASE WHEN v > 0 THEN {_share('0', 'total', 'v')} END")
    return stored(found.withColumn("base", base), "groups")


def _pairs(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """Distance of each group from each other source of its language, over all kept terms.

    A term that neither source has gives the distance of their base shares. What
    terms of one source add to that only depends on their number of occurrences,
    so it is summed from a histogram of these; what terms of both add comes from
    pairs of sources within a term. No term is paired with a source without it.
    """
    other = groups.select("lang", F.col("source").alias("other"), F.col("base").alias("other_base"))
    both = groups.join(other, "lang").where("source <> other")
    shares = counts.select("lang", "source", "term", "share", "base")
    histogram = shares.groupBy("lang", "source", "share", "base").agg(F.count("*").alias("terms"))
    sides = histogram.join(other, "lang").where("source <> other")
    rest = _distance("base", "other_base")
    from_p = sides.selectExpr(
        "lang", "source", "other", f"terms * ({_distance('share', 'other_base')} - {rest}) AS part"
    )
    from_q = sides.selectExpr(
        "lang", "other AS source", "source AS other",
        f"terms * ({_distance('other_base', 'share')} - {_distance('other_base', 'base')}) AS part",
    )
    of_term = shares.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "share", "base")).alias("held"))
    # a source and those behind it in the list: every two once, for both of their distances
    shared = of_term.where("size(held) > 1").select("lang", "held", F.posexplode("held").alias("at", "p"))
    shared = shared.select("lang", "p", F.explode(F.expr("slice(held, at + 2, size(held))")).alias("q"))
    there, back = (
        f"{_distance(f'{a}.share', f'{b}.share')} - {_distance(f'{a}.share', f'{b}.base')}"
        f" - {_distance(f'{a}.base', f'{b}.share')} + {_distance(f'{a}.base', f'{b}.base')}"
        for a, b in (("p", "q"), ("q", "p"))
    )
    shared = shared.selectExpr("lang", "p.source AS a", "q.source AS b", f"{there} AS there", f"{back} AS back")
    shared = shared.groupBy("lang", "a", "b").agg(F.sum("there").alias("there"), F.sum("back").alias("back"))
    ways = "inline(array(struct(a AS source, b AS other, there AS part), struct(b AS source, a AS other, back AS part)))"
    from_both = shared.selectExpr("lang", ways)
    plain = both.selectExpr("lang", "source", "other", f"CASE WHEN v > 0 THEN v * {rest} ELSE 0 END AS part")
    parts = plain.unionAll(from_p).unionAll(from_q).unionAll(from_both)
    sums = parts.groupBy("lang", "source", "other").agg(F.sum("part").alias("value"))
    return sums.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """How far apart the sources of each language are, and by which terms.

    Returns (lang, source, part, item, value, rank). Part ``pair``: each other
    source of the language and the sum, over the kept terms, of the distances of
    their shares. Part ``term``: the ``top`` terms whose share in the source
    exceeds the language's, and the distance. All numbers are whole. Ranks start
    at 1 in each group and part, larger values first, then items by their bytes.
    Rows are documents, repeated or not; nulls count as empty texts; further
    columns are not read. An empty table gives no rows.
    """
    docs = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = stored(term_counts(docs, min_docs), "kept-terms")
    groups = _groups(docs, counts)
    few = groups.count() <= GROUPS
    shares = counts.join(F.broadcast(groups) if few else groups, ["lang", "source"])
    shares = shares.withColumn("share", F.expr(_share("n", "total", "v")))
    terms = shares.withColumn("q", F.expr(_share("lang_n", "lang_total", "v"))).where("share > q")
    terms = terms.selectExpr(
        "lang", "source", "'term' AS part", "term AS item", f"{_distance('share', 'q')} AS value"
    )
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    best = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    pairs = _pairs(shares, groups).withColumn("rank", F.row_number().over(order))
    return pairs.unionByName(best)


def oracle_sql(min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> str:
    """The same audit in DuckDB's SQL, with a row for each group and kept term."""
    upper = "".join(map(chr, range(65, 91)))

    def share(n: str, total: str) -> str:
        return f"1 + (CAST({n} + 1 AS HUGEINT) * {_SCALE}) // ({total} + v)"

    return f"""
    WITH docs AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
            translate(coalesce(text, ''), '{upper}', '{upper.lower()}') AS text FROM documents),
        words AS (SELECT id, lang, source, unnest(
            regexp_extract_all(text, '[^\\x{{00}}-\\x{{40}}\\x{{5B}}-\\x{{60}}\\x{{7B}}-\\x{{7F}}]+')) AS term FROM docs),
        kept AS (SELECT lang, term, count(*) AS lang_n FROM words GROUP BY lang, term
            HAVING count(DISTINCT id) >= {min_docs}),
        langs AS (SELECT lang, sum(lang_n) AS lang_total, count(*) AS v FROM kept GROUP BY lang),
        groups AS (SELECT DISTINCT lang, source FROM docs),
        counts AS (SELECT lang, source, term, count(*) AS n FROM words GROUP BY ALL),
        dense AS (SELECT g.lang, g.source, k.term, k.lang_n, coalesce(c.n, 0) AS n,
                sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total, lang_total, v
            FROM groups g JOIN kept k ON g.lang = k.lang JOIN langs l ON l.lang = g.lang
            LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
        shares AS (SELECT lang, source, term, n, {share('n', 'total')} AS p, {share('lang_n', 'lang_total')} AS q
            FROM dense),
        sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
            FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
            GROUP BY ALL),
        pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value
            FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
        parts AS (SELECT lang, source, 'pair' AS part, item, CAST(value AS BIGINT) AS value FROM pairs
            UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM shares
            WHERE n > 0 AND p > q),
        ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part
            ORDER BY value DESC, item) AS INTEGER) AS rank FROM parts)
    SELECT * FROM ranked WHERE part = 'pair' OR rank <= {top}"""
