"""Personal data by fixed patterns and a linear-chain conditional random field.

The base finds email, ip, card and phone by pattern. The field adds spans that
the patterns miss: its labels are the four kinds and "other", its features the
shapes of a token and of its neighbours. It is trained on a small labelled
table (text with spans) and decoded by Viterbi, for all texts of a batch at once.

A token without a digit or @ can only be "other". The best path therefore falls
apart at such tokens, and only the runs of tokens between them are decoded,
which gives the same labels as decoding the whole text. Neighbouring tokens of
one kind are one span; spans that touch a base span are not added.

All places are code points, ends are exclusive. A null text counts as empty.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeload.llm.common import extended, free_name, small

KINDS = ("email", "ip", "card", "phone")
#: About so many documents are learned from, chosen by a hash of id and text.
SAMPLE_DOCUMENTS = 3000
#: Runs of tokens are cut to this length for training.
TRAIN_RUN = 50
FEATURES = 1 << 12
Span = tuple[int, int, int]  # kind, start, end

# The patterns allow no other match than those in the module's contract: a run of
# digits can only be entered at its start, and nothing is scanned twice.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_NO_DIGIT = re.compile("[^0-9]+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+")
_EDGES = "\"'`.,;:!?()[]{}<>|"


def _emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        done = match.end() if match else at + 1
        if match:
            yield 0, start, done
        at = text.find("@", done)


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans by pattern, by kind and then by start."""
    spans = list(_emails(text)) if "@" in text else []
    if not _DIGIT.search(text):
        return spans
    for match in _IP.finditer(text):
        # a part of many digits may be small by leading zeros; more than three others are too many
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in match.group().split(".")):
            spans.append((1, *match.span()))
    for match in _CARD.finditer(text):
        if match.end() - match.start() < 16:
            continue
        digits = _NO_DIGIT.sub("", match.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            spans.append((2, *match.span()))
    if "+" in text:
        for match in _PHONE.finditer(text):
            if 8 <= len(_NO_DIGIT.sub("", match.group())) <= 15:
                spans.append((3, *match.span()))
    return spans


def spans_text(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for kind, start, end in sorted(spans))


def _shape(token: str) -> str:
    """Digits as d, letters as a or A, runs shortened, other characters as they are."""
    out = []
    for c in token[:80]:
        c = "d" if "0" <= c <= "9" else ("A" if c.isupper() else "a") if c.isalpha() else c
        if not out or out[-1] != c:
            out.append(c)
    return "".join(out)


def _features(token: str, before: str, after: str) -> list[int]:
    """Hashed features of a token; as many for each token."""
    number = _NO_DIGIT.sub("", token)
    digits = len(number)
    core = token.strip(_EDGES)
    parts = core.split(".")
    facts = (
        "b",
        "s" + _shape(token),
        "c" + _shape(core),
        f"n{min(digits, 20)}",
        f"l{min(len(core), 25)}",
        f"d{core.count('.')}@{core.count('@')}",
        f"f{token[:1]}{min(digits, 12)}",
        f"u{luhn(number)}" if 12 <= digits <= 19 else "u",
        f"i{all(len(p) <= 3 and int(p) <= 255 for p in parts)}" if _DOTTED.fullmatch(core) else f"i{len(parts)}",
        "p" + _shape(before)[:8] + "|" + _shape(core),
        "q" + _shape(core) + "|" + _shape(after)[:8],
    )
    return [xxhash.xxh32_intdigest(fact.encode("utf-8", "surrogatepass")) % FEATURES for fact in facts]



def find_runs(text: str) -> list[tuple[list[tuple[int, int]], list[list[int]]]]:
    """Runs of neighbouring tokens that hold a digit or @: their places and features."""
    matches = list(_TOKEN.finditer(text))
    out: list[tuple[list[tuple[int, int]], list[list[int]]]] = []
    last_end = None
    for k, match in enumerate(matches):
        start, end = match.span()
        joined = last_end is not None and text[last_end:start].isspace()
        before = matches[k - 1].group() if joined else _word_before(text, start)
        after = _word_after(text, end)
        features = _features(match.group(), before, after)
        if joined:
            out[-1][0].append((start, end))
            out[-1][1].append(features)
        else:
            out.append(([(start, end)], [features]))
        last_end = end
    return out


def _word_before(text: str, start: int) -> str:
    return text[max(0, start - 24) : start].rstrip().rpartition(" ")[2]


def _word_after(text: str, end: int) -> str:
    return text[end : end + 24].lstrip().partition(" ")[0]


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # features x labels; label 0 is "other"
    moves: np.ndarray  # labels x labels
    start: np.ndarray
    stop: np.ndarray

    def viterbi(self, runs: list[list[list[int]]]) -> list[list[int]]:
        """Best labels of many runs at once, one step per place for all of them."""
        if not runs:
            return []
        order = sorted(range(len(runs)), key=lambda k: -len(runs[k]))
        lengths = np.array([len(runs[k]) for k in order])
        offsets = np.r_[0, np.cumsum(lengths)[:-1]]
        flat = np.array([f for k in order for f in runs[k]], np.int32)
        scores = self.weights[flat].sum(axis=1)
        labels = np.zeros(len(flat), np.int8)
        back = np.zeros((len(flat), self.moves.shape[0]), np.int8)
        best = scores[offsets] + self.start
        final = np.zeros_like(best)
        for t in range(int(lengths[0])):
            alive = int(np.searchsorted(-lengths, -t, "left"))  # runs longer than t
            if t:
                options = best[:alive, :, None] + self.moves
                back[offsets[:alive] + t] = options.argmax(axis=1)
                best = options.max(axis=1) + scores[offsets[:alive] + t]
            final[:alive] = best
        last = (final + self.stop).argmax(axis=1)
        for t in range(int(lengths[0]) - 1, -1, -1):
            alive = int(np.searchsorted(-lengths, -t, "left"))
            ends = lengths[:alive] == t + 1
            at = offsets[:alive] + t
            here = np.where(ends, last[:alive], 0)
            if t + 1 < lengths[0]:
                more = ~ends
                nxt = at[more] + 1
                here[more] = back[nxt, labels[nxt]]
            labels[at] = here
        out: list[list[int]] = [[] for _ in runs]
        for k, offset, length in zip(order, offsets, lengths, strict=True):
            out[k] = labels[offset : offset + length].tolist()
        return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def train(rows: list[tuple[list[list[int]], list[int]]], steps: int = 150, penalty: float = 1e-3) -> Model:
    """Maximise the conditional likelihood of labelled runs, by Adam over all of them.

    A row is (features of each token, label of each token). Without rows the
    model labels everything "other".
    """
    labels_n = len(KINDS) + 1
    weights = np.zeros((FEATURES, labels_n))
    moves, start, stop = np.zeros((labels_n, labels_n)), np.zeros(labels_n), np.zeros(labels_n)
    start[0] = 0.1  # ties go to "other"
    if not rows:
        return Model(weights, moves, start, stop)
    n, longest = len(rows), max(len(y) for _, y in rows)
    width = len(rows[0][0][0])
    x = np.zeros((n, longest, width), np.int32)
    y = np.zeros((n, longest), np.int64)
    mask = np.zeros((n, longest), bool)
    for k, (features, labels) in enumerate(rows):
        x[k, : len(labels)], y[k, : len(labels)], mask[k, : len(labels)] = features, labels, True
    ends = mask.sum(axis=1) - 1
    every = np.arange(n)
    parameters = [weights, moves, start, stop]
    momentum = [np.zeros_like(p) for p in parameters]
    speed = [np.zeros_like(p) for p in parameters]
    one = np.eye(labels_n)
    for step in range(1, steps + 1):
        scores = weights[x].sum(axis=2)
        forward, backward = np.zeros_like(scores), np.zeros_like(scores)
        forward[:, 0] = scores[:, 0] + start
        for t in range(1, longest):
            new = _log_sum(forward[:, t - 1, :, None] + moves, 1) + scores[:, t]
            forward[:, t] = np.where(mask[:, t, None], new, forward[:, t - 1])
        total = _log_sum(forward[:, -1] + stop, 1)
        backward[every, ends] = stop
        for t in range(longest - 2, -1, -1):
            new = _log_sum(moves + (scores[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            inner = (t < ends)[:, None]
            backward[:, t] = np.where(inner, new, backward[:, t])
        share = np.exp(np.minimum(forward + backward - total[:, None, None], 0)) * mask[:, :, None]
        wrong = (one[y] * mask[:, :, None] - share) / n
        gradient_w = np.zeros_like(weights)
        flat = np.repeat(wrong.reshape(-1, labels_n), width, axis=0)
        for label in range(labels_n):
            gradient_w[:, label] = np.bincount(x.reshape(-1), flat[:, label], FEATURES)
        gradient_m = np.zeros_like(moves)
        for t in range(1, longest):
            on = mask[:, t]
            if not on.any():
                break
            pair = forward[on, t - 1, :, None] + moves + (scores[on, t] + backward[on, t])[:, None, :]
            pair = np.exp(np.minimum(pair - total[on, None, None], 0)).sum(axis=0)
            seen = np.zeros_like(moves)
            np.add.at(seen, (y[on, t - 1], y[on, t]), 1)
            gradient_m += (seen - pair) / n
        gradients = [gradient_w, gradient_m, wrong[:, 0].sum(axis=0), wrong[every, ends].sum(axis=0)]
        for p, g, m, v in zip(parameters, gradients, momentum, speed, strict=True):
            g = g - penalty * p
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(weights, moves, start, stop)


def labelled_runs(text: str, spans: list[Span]) -> list[tuple[list[list[int]], list[int]]]:
    """Training rows of one text with known spans."""
    out = []
    for places, features in find_runs(text):
        labels = []
        for start, end in places:
            kinds = [kind for kind, a, b in spans if a < end and start < b]
            labels.append(1 + kinds[0] if kinds else 0)
        for k in range(0, len(labels), TRAIN_RUN):
            out.append((features[k : k + TRAIN_RUN], labels[k : k + TRAIN_RUN]))
    return out


def fit(docs: DataFrame, documents: int = SAMPLE_DOCUMENTS) -> Model:
    """Train on a bounded sample of ``docs`` (doc_id, text) labelled by the base patterns."""
    some = docs.where(F.col("text").rlike("[0-9@]")).select("doc_id", "text")
    steps = 1 << 30
    # different rows, about: a much repeated row must not crowd out the others
    count = docs.agg(F.approx_count_distinct(F.xxhash64("doc_id", "text"))).first()[0]
    limit = int(steps * min(1.0, documents / max(1, count)))
    some = some.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(steps)) < limit)
    # repeated rows share their hash: one of them counts, so that a much repeated row is one row of the sample
    some = some.dropDuplicates(["doc_id", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            rows = [r for text in batch.column(1).to_pylist() for r in labelled_runs(text, base_spans(text))]
            features = pa.array([sum(f, []) for f, _ in rows], pa.list_(pa.int32()))
            labels = pa.array([y for _, y in rows], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([features, labels], ["features", "labels"])

    table = some.mapInArrow(run, "features array<int>, labels array<int>").toArrow().to_pylist()
    rows = []
    for row in table:
        width = len(row["features"]) // len(row["labels"])
        rows.append(([row["features"][k * width : (k + 1) * width] for k in range(len(row["labels"]))], row["labels"]))
    return train(sorted(rows))


def find_spans(texts: list[str | None], model: Model) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of every text of a batch."""
    texts = [text or "" for text in texts]
    base = [base_spans(text) for text in texts]
    found = [find_runs(text) for text in texts]
    labels = iter(model.viterbi([features for runs in found for _, features in runs]))
    out = []
    for text, known, runs in zip(texts, base, found, strict=True):
        added: list[Span] = []
        covered = _merged(known)
        for places, _ in runs:
            open_kind, open_start, open_end = 0, 0, 0
            for (start, end), label in zip([*places, (0, 0)], [*next(labels), 0], strict=True):
                if label and label == open_kind:
                    open_end = end
                    continue
                if open_kind:
                    span = _trimmed(text, open_start, open_end)
                    if span and not _touches(covered, *span):
                        added.append((open_kind - 1, *span))
                open_kind, open_start, open_end = label, start, end
        out.append((known, known + added))
    return out


def _trimmed(text: str, start: int, end: int) -> tuple[int, int] | None:
    """The span without punctuation at its edges."""
    while start < end and text[start] in _EDGES.replace("(", ""):
        start += 1
    while start < end and text[end - 1] in _EDGES.replace(")", ""):
        end -= 1
    return (start, end) if start < end else None


def _merged(spans: list[Span]) -> list[tuple[int, int]]:
    """Disjoint intervals that cover the same places, by start."""
    out: list[tuple[int, int]] = []
    for start, end in sorted((a, b) for _, a, b in spans):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _touches(intervals: list[tuple[int, int]], start: int, end: int) -> bool:
    k = bisect_left(intervals, (end, -1))  # the first that starts at or after the end
    return k > 0 and intervals[k - 1][1] > start


def redact(text: str, spans: list[Span]) -> str:
    """``text`` with every span replaced by its kind in brackets; overlapping spans are one."""
    out, done, open_ = [], 0, None
    for start, end, kind in sorted((a, b, k) for k, a, b in spans):
        if open_ and start < open_[1]:
            open_[1] = max(open_[1], end)
            continue
        if open_:
            out += [text[done : open_[0]], f"[{KINDS[open_[2]].upper()}]"]
            done = open_[1]
        open_ = [start, end, kind]
    if open_:
        out += [text[done : open_[0]], f"[{KINDS[open_[2]].upper()}]"]
        done = open_[1]
    return "".join(out) + text[done:]


def span_table(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of ``docs``: doc_id, the number of base spans per kind, base_sha256, spans."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            rows = find_spans(batch.column(1).to_pylist(), shared.value)
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in rows], pa.int64()) for k in range(4)]
            digests = [hashlib.sha256(spans_text(base).encode()).hexdigest() for base, _ in rows]
            spans = [spans_text(full) for _, full in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, pa.array(digests, pa.string()), pa.array(spans, pa.string())], names
            )

    names = ["doc_id", *(f"n_{kind}" for kind in KINDS), "base_sha256", "spans"]
    schema = ", ".join(
        f"{name} {'string' if name in ('base_sha256', 'spans') else 'bigint'}" for name in names
    )
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def redact_table(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` plus ``redacted``, the text with all spans replaced (null stays null)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = free_name("redacted", docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            found = find_spans(texts, shared.value)
            clean = [
                None if text is None else redact(text, full) if full else text
                for text, (_, full) in zip(texts, found, strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(clean, pa.string())], [*batch.schema.names, out]
            )

    return docs.mapInArrow(run, extended(docs.schema, **{out: "string"}))
