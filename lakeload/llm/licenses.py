"""Licence scan: normalised passages against licence templates by Dice coefficient.

A passage is the whole text or one of its lines. It is put in lower case, runs
of characters other than a-z and 0-9 become one space, and the distinct pairs of
neighbouring words are taken. A template matches if the Dice coefficient of both
sets of pairs, 2 |A and B| / (|A| + |B|), is at least ``threshold``.

Size bounds prune: a coefficient of t needs t / (2 - t) <= |A| / |B| <= (2 - t) / t,
so a passage meets only templates of about its size, and a passage with fewer
words than the smallest template allows is left before its pairs are built. A
match also shares at least t / (2 - t) of the template's pairs. For each template
some words are chosen so that fewer pairs than that are without them; a passage
with none of these words cannot match and is left before anything is built.

A notice may also run over several lines or stand inside a longer one. Runs of
as many words as the template has, placed at each of its pairs in the text, are
passages too; ``line`` is where the run begins. A run is left out where the whole
text or a line that it touches matches the template already, and of overlapping
runs the best counts, the first one for equal coefficients.

Everything is a DataFrame expression: two scans, no shuffle, no Python on the
executors. A null text has no passage; line 0 is the whole text, lines count from
1 and are left out where the text is a single line (its runs have line 1).
Repeated rows are repeated. The SQL has the notices over whole texts and lines.
"""

from __future__ import annotations

import math
import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

# Notices of common public licences.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
    ),
    (
        "Apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is "
        'distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without '
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions:",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
        "option) any later version.",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    (
        "CC-BY-4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met:",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]

_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED '
    "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
    "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
    "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER "
    "CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
    "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_TWO_CLAUSES = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
    "the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, "
    "this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the "
    "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
    "materials provided with the distribution. "
)

# Whole texts of short licences. Longer ones hold their notice, which is found as a run.
TEXTS: list[tuple[str, str]] = [
    (
        "MIT",
        TEMPLATES[5][1] + " The above copyright notice and this permission notice shall be included in all copies or "
        'substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS '
        "OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE "
        "AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR "
        "OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION "
        "WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("BSD-2-Clause", _TWO_CLAUSES + _DISCLAIMER),
    (
        "BSD-3-Clause",
        _TWO_CLAUSES + "3. Neither the name of the copyright holder nor the names of its contributors may be used to "
        "endorse or promote products derived from this software without specific prior written permission. "
        + _DISCLAIMER,
    ),
    (
        "ISC",
        TEMPLATES[15][1] + ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO '
        "THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE "
        "LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM "
        "LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING "
        "OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
]


def _words(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), " ")


def _pairs(words: Column) -> Column:
    """Distinct pairs of neighbouring words; none for fewer than two words."""
    left = F.slice(words, F.lit(1), F.size(words) - 1)
    right = F.slice(words, F.lit(2), F.size(words) - 1)
    joined = F.zip_with(left, right, lambda a, b: F.concat_ws(" ", a, b))
    return F.when(F.size(words) > 1, F.array_distinct(joined)).otherwise(F.array().cast("array<string>"))


def _template_words(text: str) -> list[str]:
    kept = "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower())
    return kept.split()


def key_words(pairs: list[str], threshold: float) -> list[str]:
    """Words of which every match holds one, until too few pairs are without them.

    Long words come first, then numbers: short words are part of too many others.
    """
    needed = threshold * len(pairs) / (2 - threshold)
    words = {w for pair in pairs for w in pair.split()}
    words = sorted(words, key=lambda w: (len(w) < 5, not w.isdigit(), -len(w), w))
    chosen: list[str] = []
    rest = [pair.split() for pair in pairs]
    for word in words:
        if len(rest) < needed - 1e-9:
            break
        if any(word in pair for pair in rest):
            chosen.append(word)
            rest = [pair for pair in rest if word not in pair]
    return chosen


def _dice(own: Column, pairs: Column) -> Column:
    return 2.0 * F.size(F.array_intersect(own, pairs)) / (F.size(own) + F.size(pairs))


def _once(value: Column) -> Column:
    """``value``, worked out once per row: filters on it are not moved below it."""
    return F.explode(F.array(value))


def _runs(able: DataFrame, literals: list[Column], pairs: list[str], threshold: float) -> DataFrame:
    """The rows of :func:`scan` for runs of words that no line and no whole text stands for."""
    lines = F.split("text", "\n")
    numbered = F.transform(
        lines,
        lambda text, at: F.transform(
            F.filter(_words(text), lambda w: w != ""), lambda w: F.struct(w.alias("word"), (at + 1).alias("line"))
        ),
    )
    words = able.select("doc_id", "text", lines.alias("lines"), _once(F.flatten(numbered)).alias("words"))
    words = words.where(F.size("words") > 1)
    left = F.slice("words", F.lit(1), F.size("words") - 1)
    right = F.slice("words", F.lit(2), F.size("words") - 1)
    joined = F.zip_with(left, right, lambda a, b: F.concat_ws(" ", a["word"], b["word"]))
    paired = words.select("*", _once(joined).alias("all"))
    placed = F.transform("all", lambda pair, at: F.struct(at.alias("at"), pair.alias("pair")))
    hits = paired.select("*", _once(F.filter(placed, lambda x: x["pair"].isin(pairs))).alias("hits"))
    hits = hits.where(F.size("hits") > 0)

    def own(t: Column) -> Column:
        return F.filter("hits", lambda x: F.array_contains(t["pairs"], x["pair"]))

    hits = hits.select("*", F.explode(F.filter(F.array(*literals), lambda t: F.size(own(t)) >= t["needed"])).alias("t"))
    hits = hits.select("*", _once(F.transform(own(F.col("t")), lambda x: x["at"])).alias("at"))
    # a run that matches holds enough pairs of the template: the last of these lies inside it
    dense = F.filter("at", lambda start, k: F.get("at", k + F.col("t.needed") - 1) <= start + F.col("t.length") - 2)
    dense = hits.select("*", _once(dense).alias("starts")).where(F.size("starts") > 0)
    scored = F.transform(
        "starts",
        lambda start: F.struct(
            start.alias("start"),
            _dice(F.array_distinct(F.slice("all", start + 1, F.col("t.length") - 1)), F.col("t.pairs")).alias("dice"),
        ),
    )
    found = dense.select("*", _once(F.filter(scored, lambda x: x["dice"] >= threshold)).alias("runs"))
    found = found.where(F.size("runs") > 0)

    def add(chosen: Column, run: Column) -> Column:
        last = F.get(chosen, F.size(chosen) - 1)
        apart = last.isNull() | (run["start"] >= last["start"] + F.col("t.length"))
        others = F.slice(chosen, F.lit(1), F.size(chosen) - 1)
        better = F.when(run["dice"] > last["dice"], F.concat(others, F.array(run))).otherwise(chosen)
        return F.when(apart, F.concat(chosen, F.array(run))).otherwise(better)

    empty = F.array().cast("array<struct<start:int,dice:double>>")
    found = found.select("doc_id", "text", "lines", "words", "t", F.explode(F.aggregate("runs", empty, add)).alias("run"))
    last = F.least(F.col("run.start") + F.col("t.length"), F.size("words")) - 1
    found = found.select(
        "doc_id", "text", "lines", "t", "run", F.col("words")[F.col("run.start")]["line"].alias("line"),
        F.col("words")[last]["line"].alias("end"),
    )

    def matches(text: Column) -> Column:
        own = _pairs(_words(text))
        return (F.size(own) > 0) & (_dice(own, F.col("t.pairs")) >= threshold)

    touched = F.slice("lines", F.col("line"), F.col("end") - F.col("line") + 1)
    found = found.where(~matches(F.col("text")) & ~F.exists(touched, matches))
    return found.select("doc_id", "line", "t.template", "t.license", F.col("run.dice").alias("dice"))


def scan(
    docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD
) -> DataFrame:
    """(doc_id, line, template, license, dice) of every passage and template that match.

    ``template`` is the place in the list, from 0. ``threshold`` lies above 0.
    The list is ``TEMPLATES`` and then ``TEXTS`` if none is given.
    """
    templates = TEMPLATES + TEXTS if templates is None else templates
    known, literals, keys, every = [], [], set(), set()
    for place, (name, text) in enumerate(templates):
        words = _template_words(text)
        pairs = list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))
        if not pairs:
            continue
        known.append(len(pairs))
        every.update(pairs)
        keys.update(key_words(pairs, threshold))
        literals.append(
            F.struct(
                F.lit(place).alias("template"),
                F.lit(name).alias("license"),
                F.array(*map(F.lit, pairs)).alias("pairs"),
                # integer bounds with room for rounding; the coefficient itself decides
                F.lit(math.floor(len(pairs) * threshold / (2 - threshold))).alias("least"),
                F.lit(math.ceil(len(pairs) * (2 - threshold) / threshold)).alias("most"),
                F.lit(len(words)).alias("length"),
                F.lit(max(1, math.ceil(len(pairs) * threshold / (2 - threshold) - 1e-9))).alias("needed"),
            )
        )
    if not literals:
        return docs.sparkSession.createDataFrame(
            [], "doc_id bigint, line int, template int, license string, dice double"
        )
    fewest = math.floor(min(known) * threshold / (2 - threshold)) + 1

    # a word that holds another one needs no test of its own
    tested = sorted(w for w in keys if not any(other in w for other in keys - {w}))

    def may_match(text: str) -> Column:
        # as an element of an array, the text is put in lower case once for all tests
        return F.exists(
            F.array(F.lower(text)),
            lambda low: reduce(operator.or_, (F.contains(low, F.lit(word)) for word in tested)),
        )

    lines = F.split("text", "\n")
    passages = F.when(F.size(lines) > 1, F.concat(F.array("text"), lines)).otherwise(F.array("text"))
    able = docs.where(may_match("text"))
    units = able.select("doc_id", F.posexplode(passages).alias("line", "passage")).where(may_match("passage"))
    words = units.withColumn("words", _words(F.col("passage"))).where(F.size("words") >= fewest)
    paired = words.select("doc_id", "line", _pairs(F.col("words")).alias("own"))
    sized = F.size("own")
    near = paired.where((sized >= fewest - 1) & (sized <= math.ceil(max(known) * (2 - threshold) / threshold)))
    fits = F.filter(F.array(*literals), lambda t: (t["least"] <= sized) & (sized <= t["most"]))
    met = near.select("doc_id", "line", "own", F.explode(fits).alias("t"))
    dice = _dice(F.col("own"), F.col("t.pairs"))
    scored = met.select("doc_id", "line", "t.template", "t.license", dice.alias("dice"))
    runs = _runs(able.select("doc_id", "text"), literals, sorted(every), threshold)
    return scored.where(F.col("dice") >= threshold).unionByName(runs)


def oracle_sql(templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> str:
    """DuckDB SQL over ``documents`` for the same rows, without pruning."""
    rows = ", ".join(
        f"({k}, '{name}', '{text.replace(chr(39), chr(39) * 2)}')"
        for k, (name, text) in enumerate(TEMPLATES if templates is None else templates)
    )
    norm = "string_split(trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g')), ' ')"
    pairs = "list_distinct([{0}[k] || ' ' || {0}[k + 1] for k in range(1, len({0}))])"
    return f"""
        WITH templates(template, license, content) AS (VALUES {rows}),
        t AS (SELECT template, license, {pairs.format("w")} AS pairs
              FROM (SELECT *, {norm.format("content")} AS w FROM templates)),
        units AS (
            SELECT doc_id, 0 AS line, text AS passage FROM documents WHERE text IS NOT NULL
            UNION ALL
            SELECT doc_id, unnest(range(1, len(parts) + 1)) AS line, unnest(parts) AS passage
            FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)
            WHERE len(parts) > 1),
        own AS (SELECT doc_id, line, {pairs.format("w")} AS pairs
                FROM (SELECT doc_id, line, {norm.format("passage")} AS w FROM units)),
        scored AS (
            SELECT doc_id, line, template, license,
                   2.0::DOUBLE * len(list_intersect(own.pairs, t.pairs)) / (len(own.pairs) + len(t.pairs)) AS dice
            FROM own, t WHERE len(own.pairs) > 0)
        SELECT doc_id, line::INTEGER AS line, template::INTEGER AS template, license, dice
        FROM scored WHERE dice >= {threshold}"""
