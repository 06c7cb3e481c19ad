"""Trained models: held-out accuracy, folds, and what they must not read."""

import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeweave.llm import language, quality, toxicity
from tapeweave.llm.ftrl import Ftrl, probability

MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def medium():
    docs, labels = (pd.read_parquet(f"{MEDIUM}/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels


def test_language_on_the_held_out_fold(spark, medium):
    docs, _ = medium
    rows = language.op5_language_id(spark, MEDIUM).toPandas().merge(docs, on="doc_id")
    assert len(rows) == len(docs)
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in rows.doc_id]).all()
    held = rows[rows.held_out]
    assert (held.lang_pred == held.lang).mean() >= 0.98
    assert held.score.between(0, 1).all()
    # Calibrated: the mean score is about the accuracy.
    assert abs(held.score.mean() - (held.lang_pred == held.lang).mean()) < 0.05


def test_language_ignores_held_out_labels(spark, medium):
    docs, _ = medium
    part = spark.createDataFrame(docs.head(150)[["doc_id", "text", "lang"]])
    spoilt = part.withColumn("lang", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, "xx").otherwise(F.col("lang")))
    assert language.identify(part).orderBy("doc_id").collect() == language.identify(spoilt).orderBy("doc_id").collect()


def test_document_frequencies(spark):
    texts = spark.createDataFrame([("ab",), ("b",), ("",), ("abab",)], "text string").repartition(2)
    found = language.document_frequencies(texts)
    (one, _), (two, _), _ = language.char_ngrams(*language.code_points(["ab"]))
    assert found[-1] == 4 and found[one[0]] == 2 and found[one[1]] == 3 and found[two[0]] == 2


def test_temperature():
    rng = np.random.default_rng(0)
    logits = rng.normal(size=(4000, 3)) * 2
    chance = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
    truth = np.array([rng.choice(3, p=p) for p in chance])
    assert abs(language.calibrated(logits * 3, truth) - 3) < 0.4


def test_toxicity(spark, medium):
    docs, labels = medium
    rows = toxicity.op8_toxicity(spark, MEDIUM).toPandas()
    assert len(rows) == len(docs) and ((rows.score >= 0.7) == rows.predicted).all()
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in rows.doc_id]).all()
    marked = rows.merge(labels, on="doc_id")
    held = marked[marked.held_out]
    toxic, clean = held[held.toxic == 1].score.to_numpy(), held[held.toxic == 0].score.to_numpy()
    # Few toxic rows to learn from here: their scores must still rank first, and clean rows stay clean.
    assert (toxic[:, None] > clean[None]).mean() > 0.8
    assert (clean >= 0.7).mean() < 0.01


def test_toxicity_of_new_texts(spark):
    rng = np.random.default_rng(1)
    words = [f"w{k}" for k in range(400)]
    rows, marks = [], []
    for k in range(900):
        text = list(rng.choice(words, size=rng.integers(5, 60)))
        toxic = k % 6 == 0
        if toxic:
            text.insert(int(rng.integers(len(text))), str(rng.choice(["rotter", "vermin", "bad egg"])))
        elif k % 6 == 1:
            text.insert(int(rng.integers(len(text))), str(rng.choice(["bad", "egg"])))
        rows.append((k, " ".join(text)))
        marks.append((k, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scored = toxicity.scored(docs, spark.createDataFrame(marks, "doc_id long, toxic int")).toPandas()
    held = scored.merge(pd.DataFrame(marks, columns=["doc_id", "toxic"]))
    held = held[held.held_out]
    assert (held[held.toxic == 1].predicted == 1).mean() > 0.9 and (held[held.toxic == 0].predicted == 1).mean() < 0.02


def test_quality_agrees_with_labels(spark, medium):
    """The labels are not read; the weak labels must still find what they mark."""
    docs, labels = medium
    marked = quality.op6_weak_label_quality(spark, MEDIUM).toPandas().merge(labels, on="doc_id")
    assert marked[marked.quality == 1].accepted.mean() > 0.98
    assert marked[marked.quality == 0].accepted.mean() < 0.15


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(2)
    n = 20_000
    bad = rng.random(n) < 0.2
    cast = np.full((n, len(quality.LABELLERS)), quality.NONE)
    for k, (_, _, vote, _, _) in enumerate(quality.LABELLERS):
        right = (bad if vote == quality.BAD else ~bad) & (rng.random(n) < 0.5)
        wrong = (bad if vote == quality.GOOD else ~bad) & (rng.random(n) < 0.01)
        cast[right | wrong, k] = vote
    patterns, where, counts = np.unique(quality.pattern(cast), return_inverse=True, return_counts=True)
    model = quality.label_model(patterns, counts.astype(float))
    posterior = np.array([model["posterior"][p] for p in patterns.tolist()])[where]
    assert ((posterior > 0.5) == bad).mean() > 0.9
    assert all(share > 0.8 for _, share in quality.accuracies(model))


def test_ftrl_is_sparse_and_learns():
    used = []
    for l1 in (0.1, 20.0):
        rng = np.random.default_rng(3)
        model = Ftrl(50, l1=l1)
        for _ in range(3000):
            at = np.unique(rng.integers(0, 50, size=5))
            model.fit(at, np.ones(len(at)), float(7 in at))
        weights = model.all_weights()[:, 0]
        used.append((weights[:-1] != 0).sum())
        # A strong penalty also shrinks the weight that stays.
        assert probability(weights[7] + weights[-1]) > 0.7 > 0.2 > probability(weights[-1])
    assert used[1] < 10 < used[0]
