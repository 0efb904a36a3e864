"""Language identification by error-correcting output codes.

Every language has a codeword of +1 and -1; each bit is a binary classifier
(naive Bayes log-odds with a fitted logistic scale) over hashed byte n-grams. A text is decoded by weighting
the logistic loss of every bit by that bit's accuracy on training rows and
taking the codeword with the smallest loss. ``ambiguous`` flags a text whose
two nearest codewords lie closer than ``margin``.

Letters are read in lower case, any run of other characters is one space. The
output of a classifier is a mean over positions, so that length has no effect.
Null texts and texts without a letter are ``und`` with score 0. Without any
labelled row there is no language to choose, and every text is ``und``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeload.llm.common import extended, small
from lakeload.llm.common import free_name as _free

#: About so many labelled rows of each language are learned from, chosen by a hash of id and text.
SAMPLE_PER_LANGUAGE = 800
BUCKETS = 1 << 15
#: Two codewords whose losses differ by less are too close to tell apart.
MARGIN = 0.02
_OTHER = re.compile(r"[\W\d_]+")


def _codewords(count: int, seed: int = 5) -> np.ndarray:
    """Codewords far from each other: one bit per language, and random ones chosen greedily."""
    if count <= 1:
        return np.ones((count, 1))
    bits = [2.0 * np.eye(count)[k] - 1 for k in range(count)]
    rng = np.random.default_rng(seed)
    while len(bits) < count + max(3, 2 * int(np.ceil(np.log2(count)))):
        best, best_distance = None, -1.0
        for _ in range(64):
            bit = rng.choice([-1.0, 1.0], count)
            if abs(bit.sum()) == count:
                continue
            far = _least_distance(np.array([*bits, bit]).T)
            if far > best_distance:
                best, best_distance = bit, far
        bits.append(best)
    return np.array(bits).T


def _least_distance(words: np.ndarray) -> float:
    differ = (words[:, None, :] != words[None, :, :]).sum(axis=2).astype(float)
    np.fill_diagonal(differ, np.inf)
    return differ.min()


def _bytes_of(text: str | None) -> bytes:
    return b" " + _OTHER.sub(" ", (text or "").lower()).strip().encode("utf-8", "replace") + b" "


def _features(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashed ids of the 2- and 4-byte runs at every position but the last three."""
    raw = np.frombuffer(data + b"   ", np.uint8).astype(np.uint32)
    two = raw[:-3] | (raw[1:-2] << np.uint32(8))
    four = two | (raw[2:-1] << np.uint32(16)) | (raw[3:] << np.uint32(24))
    with np.errstate(over="ignore"):
        short = (two * np.uint32(2654435769)) >> np.uint32(17)
        long = (four * np.uint32(2246822519)) >> np.uint32(17)
    return short, long


@dataclass(frozen=True)
class Model:
    languages: list[str]
    codewords: np.ndarray  # languages x bits
    weights: np.ndarray  # buckets x bits, for 2- and 4-byte runs alike
    bias: np.ndarray
    bit_weight: np.ndarray

    def margins(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Classifier outputs (texts x bits), and whether the text has a letter."""
        out = np.zeros((len(texts), self.weights.shape[1]))
        lettered = np.zeros(len(texts), bool)
        for i, text in enumerate(texts):
            data = _bytes_of(text)
            if len(data) <= 2:
                continue
            lettered[i] = True
            short, long = _features(data)
            total = self.weights.take(short, axis=0).sum(axis=0, dtype=np.float64)
            total += self.weights.take(long, axis=0).sum(axis=0, dtype=np.float64)
            out[i] = total / (2 * len(short)) + self.bias
        return out, lettered

    def predict(self, texts: list[str | None], margin: float) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score from 0 to 1, and the ambiguity flag of every text."""
        values, lettered = self.margins(texts)
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        # loss-weighted decoding: logistic loss of each bit against each codeword
        loss = np.logaddexp(0.0, -values[:, None, :] * self.codewords[None, :, :])
        loss = (loss * self.bit_weight).sum(axis=2)
        odds = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
        share = odds / odds.sum(axis=1, keepdims=True)
        order = np.argsort(loss, axis=1, kind="stable")
        best = order[:, 0]
        rows = np.arange(len(texts))
        score = np.where(lettered, share[rows, best], 0.0)
        if len(self.languages) > 1:
            close = loss[rows, order[:, 1]] - loss[rows, best] < margin
        else:
            close = np.zeros(len(texts), bool)
        names = [self.languages[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)]
        return names, score, close | ~lettered


def train(rows: list[tuple[str, np.ndarray, np.ndarray]]) -> Model:
    """Fit the classifiers; a row is (language, feature ids, their shares of the text)."""
    languages = sorted({lang for lang, _, _ in rows})
    if not languages:
        return Model([], np.ones((0, 1)), np.zeros((BUCKETS, 1), np.float32), np.zeros(1), np.ones(1))
    code = {lang: k for k, lang in enumerate(languages)}
    codewords = _codewords(len(languages))
    sums = np.zeros((len(languages), BUCKETS))
    for lang, ids, shares in rows:
        sums[code[lang], ids] += shares
    labels = np.array([code[lang] for lang, _, _ in rows])
    bits = codewords.shape[1]
    weights = np.zeros((BUCKETS, bits), np.float32)
    for b in range(bits):
        rates = []
        for sign in (1, -1):
            side = sums[codewords[:, b] == sign].sum(axis=0)
            # smoothing of a hundredth of a text, spread over the buckets
            rates.append((side + 0.01 / BUCKETS) / (side.sum() + 0.01))
        weights[:, b] = np.log(rates[0]) - np.log(rates[1])
    raw = np.array([(weights[ids] * shares[:, None]).sum(axis=0) for _, ids, shares in rows])
    scale, bias, accuracy = np.ones(bits), np.zeros(bits), np.ones(bits)
    for b in range(bits):
        target = codewords[labels, b]
        if np.all(target == target[0]):
            scale[b], bias[b] = 0.0, 4.0 * target[0]
            continue
        scale[b], bias[b] = _logistic(raw[:, b], target)
        accuracy[b] = ((raw[:, b] * scale[b] + bias[b] > 0) == (target > 0)).mean()
    return Model(languages, codewords, (weights * scale).astype(np.float32), bias, accuracy / accuracy.sum() * bits)


def _logistic(x: np.ndarray, target: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton steps with a small penalty."""
    center, spread = x.mean(), x.std() or 1.0
    z = np.column_stack([(x - center) / spread, np.ones(len(x))])
    theta = np.zeros(2)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ theta, -30, 30)))
        gradient = z.T @ (p - (target > 0)) + 0.01 * theta
        hessian = (z * (p * (1 - p))[:, None]).T @ z + 0.01 * np.eye(2)
        theta -= np.linalg.solve(hessian, gradient)
    return theta[0] / spread, theta[1] - theta[0] * center / spread


def _sampled(docs: DataFrame, per_language: int) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """Features of the sampled rows. Only counts per language and this bounded sample reach the driver."""
    known = docs.where(F.col("lang").isNotNull())
    # different rows, about: a much repeated row must not crowd out the others
    different = F.approx_count_distinct(F.xxhash64("doc_id", "text")).alias("n")
    counts = {row["lang"]: max(1, row["n"]) for row in known.groupBy("lang").agg(different).collect()}
    if not counts:
        return []
    # a row is taken if its hash lies in the share of the hash space that holds the wanted number of rows
    steps = 1 << 30
    limits = F.create_map(
        *(F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, int(steps * min(1.0, per_language / n))))
    )
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(steps))
    chosen = known.where(F.col("text").isNotNull() & (place < limits[F.col("lang")]))
    # repeated rows share their hash: one of them counts, so that a much repeated row is one row of the sample
    chosen = chosen.dropDuplicates(["doc_id", "text", "lang"]).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            langs, ids, shares = [], [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = _bytes_of(text)
                if len(data) <= 2:
                    continue
                found, times = np.unique(np.concatenate(_features(data)), return_counts=True)
                langs.append(lang)
                ids.append(found.astype(np.int32))
                shares.append((times / times.sum()).astype(np.float32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array(ids, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))],
                ["lang", "ids", "shares"],
            )

    table = chosen.mapInArrow(run, "lang string, ids array<int>, shares array<float>").toArrow()
    rows = [
        (lang.as_py(), np.array(ids.values), np.array(shares.values))
        for lang, ids, shares in zip(table["lang"], table["ids"], table["shares"], strict=True)
    ]
    # partitions arrive in order, so the sums do not depend on timing; order rows anyway for other plans
    return sorted(rows, key=lambda r: (r[0], len(r[1]), r[1].tobytes(), r[2].tobytes()))


def fit(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Train on the rows of ``docs`` (doc_id, text, lang) that have a language."""
    return train(_sampled(docs.select("doc_id", "text", "lang"), per_language))


def predict_table(docs: DataFrame, model: Model, margin: float = MARGIN) -> DataFrame:
    """All columns of ``docs`` plus lang_pred, score and ambiguous; only ``text`` is an input."""
    names = [_free(name, docs.columns) for name in ("lang_pred", "score", "ambiguous")]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x bits numbers, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in small(batches):
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            langs, score, close = model.predict(texts, margin)
            added = [pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(close, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, *names])

    schema = extended(docs.schema, **dict(zip(names, ("string", "double", "boolean"), strict=True)))
    return docs.mapInArrow(run, schema)


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows to learn from: those not held out, with a known language."""
    return docs.where(~held_out() & F.col("lang").isNotNull())


def held_out() -> Column:
    """True for every fourth document: crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
