"""The quality model learns from every byte of every labelled row."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import quality_model


@pytest.mark.parametrize("unit", [4 << 20, 100_000])
def test_words_anywhere_in_a_text_are_learnt(spark, monkeypatch, unit):
    monkeypatch.setattr(quality_model, "UNIT", unit)
    rng = random.Random(2)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    phrase = "the seventh lantern hangs beneath an unpainted wooden bridge today"
    rows = [(i, noise(3000) + (noise(20) + phrase) * 20 * (i % 2) + noise(30_000)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i, _ in rows], "doc_id long, quality int")
    model = quality_model.fit(docs, labels, lambda k: F.lit(True))
    assert phrase[5:40].encode() in model.bad and phrase[5:40].encode() not in model.good
    got = {r.doc_id: r.predicted for r in quality_model.classify(docs, model).collect()}
    assert sum(got[i] == 1 - i % 2 for i, _ in rows) >= 38  # the rest of a text is noise
