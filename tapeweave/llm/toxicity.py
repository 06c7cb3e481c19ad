"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are present or not: words, the first STEM letters of words, pairs of neighbouring
words and pairs with one word between. L1 leaves few weights, which every task gets. The
fit runs in one task on a bounded sample of labelled rows (SAMPLE_ROWS, half of each label
where there are enough); the intercept is then moved to the share of all labelled rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeweave.llm.common import bounded_sample, fold, table
from tapeweave.llm.ftrl import Ftrl, probability
from tapeweave.llm.textcodes import Words, chunks, code_points

KIND_BITS = 22
KINDS = 4
STEM = 4
SAMPLE_ROWS = 10_000
EPOCHS = 6
#: Training rows that a feature must stand in.
LEAST_ROWS = 3
THRESHOLD = 0.7
FOLDS, HELD_OUT = 3, 1


def features(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind: hashed features and their texts, repeats included."""
    codes, bounds = code_points([t.lower() for t in texts])
    words = Words(codes, bounds, "isalnum", stem=STEM)
    found = [(words.hashes, words.text), (words.stems, words.text), words.runs(2), words.runs(2, gap=2)]
    shift = np.uint64(64 - KIND_BITS)
    return [((h >> shift).astype(np.int64) + (k << KIND_BITS), text) for k, (h, text) in enumerate(found)]


def fit(sample: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """Features with a weight, the weights, and the intercept, from sample(text, toxic, spot)."""

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        batches = list(batches)
        if not batches:
            return
        rows = pd.concat(batches, ignore_index=True)
        rows = rows.sort_values(["spot", "text"], kind="stable")  # any order of arrival gives one model
        size = KINDS << KIND_BITS
        stands = np.zeros(size, dtype=np.uint8)
        examples = []
        for text, label in zip(rows["text"], rows["toxic"], strict=True):
            at = np.unique(np.concatenate([h for h, _ in features([text or ""])]))
            stands[at] = np.minimum(stands[at], 250) + 1
            examples.append((at.astype(np.int32), float(label)))
        examples = [(at[stands[at] >= LEAST_ROWS], label) for at, label in examples]
        model = Ftrl(size, alpha=1.0, l1=3.0, l2=0.05)
        for _ in range(EPOCHS):
            for at, label in examples:
                model.fit(at, np.ones(len(at)), label)
        weights = model.all_weights()[:, 0]
        at = np.flatnonzero(weights)
        yield pd.DataFrame({"feature": at.astype("int64"), "weight": weights[at]})

    # One task: the sample is bounded.
    found = sample.repartition(1).mapInPandas(train, "feature long, weight double").collect()
    found = sorted((row["feature"], row["weight"]) for row in found)
    last = KINDS << KIND_BITS
    at = np.array([f for f, _ in found if f < last], dtype=np.int64)
    weights = np.array([w for f, w in found if f < last])
    return at, weights, next((w for f, w in found if f == last), 0.0)


def learn(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """The model from docs(doc_id, text) with labels(doc_id, toxic) outside the held-out fold.

    Labels that are null, or on a doc_id that is null or unknown, teach nothing.
    """
    marked = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("toxic IN (0, 1)").distinct()
    marked = marked.filter(F.coalesce(fold("doc_id", FOLDS), F.lit(HELD_OUT)) != HELD_OUT)
    # The sample is drawn from the labels alone, before any text is read.
    chosen = bounded_sample(marked, "toxic", ["doc_id"], SAMPLE_ROWS)
    counts = {row["toxic"]: row["count"] for row in marked.groupBy("toxic").count().collect()}
    spot = F.xxhash64(F.lit("order"), "doc_id")
    sample = docs.select("doc_id", "text").join(chosen, "doc_id").select("text", "toxic", spot.alias("spot"))
    at, weights, intercept = fit(sample)
    if len(counts) == 2:
        each = SAMPLE_ROWS // 2
        rates = [min(1.0, each / counts[k]) for k in (0, 1)]
        intercept += math.log(rates[0] / rates[1])
    return at, weights, intercept


def scorer(spark: SparkSession, model: tuple[np.ndarray, np.ndarray, float]):
    """A column function: text to score. The weights are few: L1, and a bounded training sample."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        at, weights, intercept = shared.value
        out = np.full(len(texts), intercept)
        if len(at):
            known = np.zeros(KINDS << KIND_BITS >> 3, dtype=bool)  # most features end here
            known[at >> 3] = True
            for first, part in chunks(texts.tolist()):
                for hashed, text in features(part):
                    near = known[hashed >> 3]
                    hashed, text = hashed[near], text[near]
                    spot = np.minimum(np.searchsorted(at, hashed), len(at) - 1)
                    hit = at[spot] == hashed
                    once = np.unique(np.column_stack([text[hit], spot[hit]]), axis=0)
                    np.add.at(out, first + once[:, 0], weights[once[:, 1]])
        return pd.Series(probability(out))

    return score


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, held_out, score, predicted.

    Null and empty texts get the score of no features. A null doc_id is in no fold and not
    held out. Without labels every score is 0.5. Repeated rows give repeated results; an
    empty table gives an empty one. Other columns are left out.
    """
    score = scorer(docs.sparkSession, learn(docs, labels))
    return docs.select(
        "doc_id",
        (F.coalesce(fold("doc_id", FOLDS), F.lit(-1)) == HELD_OUT).alias("held_out"),
        score(F.col("text")).alias("score"),
    ).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
