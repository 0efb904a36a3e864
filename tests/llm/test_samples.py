"""Samples that models learn from stay within their bounds; decoding to codewords, step by step."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeload.llm import langid, pii

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", range(3))
def test_a_row_repeated_often_is_one_row_of_the_sample(spark, monkeypatch, key):
    learned = []
    monkeypatch.setattr(pii, "train", lambda rows: learned.append(len(rows)) or None)
    monkeypatch.setattr(langid, "train", lambda rows: learned.append(len(rows)) or None)
    same = spark.range(20_000).select(F.lit(key).cast("bigint").alias("doc_id"), F.lit("call +49 30 1234567").alias("text"))
    others = spark.range(100, 400).selectExpr("id AS doc_id", "concat('mail me at x', id, '@y.de now') AS text")
    docs = same.unionAll(others).withColumn("lang", F.lit("en")).repartition(8)
    pii.fit(docs, 50)
    langid.fit(docs, 50)
    # of about 300 different rows some 50 are wanted
    assert all(20 <= n <= 110 for n in learned) and len(learned) == 2


def test_decoding_is_to_the_nearest_codeword(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    model = langid.fit(langid.training_rows(docs))
    texts = [r.text for r in docs.select("text").limit(60).collect()] + [None, "", "12 34", "a", "été"]
    names, scores, flags = model.predict(texts, langid.MARGIN)
    for text, name, score, flag in zip(texts, names, scores, flags, strict=True):
        data = langid._bytes_of(text)
        if len(data) <= 2:
            assert (name, score, flag) == ("und", 0.0, True)
            continue
        runs = np.concatenate(langid._features(data)).tolist()
        outputs = [math.fsum(float(model.weights[r, b]) for r in runs) / len(runs) + model.bias[b] for b in range(len(model.bias))]
        losses = [
            sum(w * math.log1p(math.exp(-o * c)) for w, o, c in zip(model.bit_weight, outputs, word, strict=True))
            for word in model.codewords
        ]
        order = sorted(range(len(losses)), key=losses.__getitem__)
        assert name == model.languages[order[0]]
        odds = [math.exp(min(losses) - loss) for loss in losses]
        assert score == pytest.approx(max(odds) / sum(odds), rel=1e-4)
        gap = losses[order[1]] - losses[order[0]]
        assert flag == (gap < langid.MARGIN) or gap == pytest.approx(langid.MARGIN, rel=1e-3)
