"""Language of texts: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies are counted over all training rows. The model is fitted by
follow-the-regularised-leader with an elastic net on a bounded sample of them
(SAMPLE_ROWS, evenly over languages), in one task; a fifth of the sample is kept from the
fit and sets the temperature that turns logits into probabilities. The weights
(FEATURES x languages at most) go to every task, which scores whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeweave.llm.common import bounded_sample, fold, table
from tapeweave.llm.ftrl import Ftrl, softmax
from tapeweave.llm.textcodes import _GOLD, chunks, code_points, mixed

BITS = 16
FEATURES = 1 << BITS
ORDERS = (1, 2, 3)
SAMPLE_ROWS = 6000
EPOCHS = 3
SCALE = 30.0
FOLDS, HELD_OUT = 5, 0


def char_ngrams(codes: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: hashed n-grams, and where each text's n-grams begin (and the last end)."""
    values = mixed((codes.astype(np.uint64) + np.uint64(1)) * _GOLD)
    lengths = np.diff(bounds)
    for n in ORDERS:
        count = max(0, len(codes) - n + 1)
        grams = values[:count].copy()
        for k in range(1, n):
            grams = grams * _GOLD + values[k : k + count]
        hashed = (mixed(grams + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int64)
        if n > 1:  # none over the end of a text
            whole = np.ones(count, dtype=bool)
            for end in bounds[1:-1]:
                whole[max(0, end - n + 1) : end] = False
            hashed = hashed[whole]
        sizes = np.maximum(lengths - n + 1, 0)
        yield hashed, np.concatenate([[0], np.cumsum(sizes)])


def _lowered(texts: list[str]) -> list[str]:
    return [t.lower() for t in texts]


def document_frequencies(texts: DataFrame) -> np.ndarray:
    """In how many rows of texts(text) each hashed n-gram stands; the last entry is the rows."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = np.zeros(FEATURES + 1, dtype=np.int64)
        seen = np.zeros(FEATURES, dtype=bool)
        for batch in batches:
            for _, part in chunks(batch["text"].tolist()):
                grams = list(char_ngrams(*code_points(_lowered(part))))
                for k in range(len(part)):
                    for hashed, first in grams:
                        seen[hashed[first[k] : first[k + 1]]] = True
                    found[:-1] += seen
                    seen[:] = False
                found[-1] += len(part)
        at = np.flatnonzero(found)
        yield pd.DataFrame({"feature": at, "n": found[at]})

    counts = texts.select("text").mapInPandas(count, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    out = np.zeros(FEATURES + 1)
    for row in counts.collect():  # one row per feature at most
        out[row["feature"]] = row["n"]
    return out


def inverse_frequencies(frequencies: np.ndarray) -> np.ndarray:
    return np.log((1.0 + frequencies[-1]) / (1.0 + frequencies[:-1])) + 0.1


def _tfidf(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    grams = [hashed for hashed, _ in char_ngrams(*code_points([text.lower()]))]
    at, times = np.unique(np.concatenate(grams), return_counts=True)
    weights = times * idf[at]
    return at, SCALE * weights / max(weights.sum(), 1e-9)


def fit(sample: DataFrame, idf: np.ndarray, languages: list[str]) -> dict:
    """Weights (features + intercept, languages) and temperature from sample(text, lang, calibrates)."""
    number = {lang: k for k, lang in enumerate(languages)}

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        batches = list(batches)
        if not batches:
            return
        rows = pd.concat(batches, ignore_index=True)
        rows = rows.sort_values(["spot", "text"], kind="stable")  # any order of arrival gives one model
        learns = rows[~rows["calibrates"]]
        model = Ftrl(FEATURES, len(languages), alpha=0.5, l1=0.05, l2=0.05)
        examples = [(*_tfidf(t, idf), number[lang]) for t, lang in zip(learns["text"], learns["lang"], strict=True) if t]
        for _ in range(EPOCHS):
            for at, values, label in examples:
                model.fit(at, values, label)
        weights = model.all_weights()
        tested = rows[rows["calibrates"]]
        logits, truth = [], []
        for text, lang in zip(tested["text"], tested["lang"], strict=True):
            if text:
                at, values = _tfidf(text, idf)
                logits.append(values @ weights[at] + weights[-1])
                truth.append(number[lang])
        temperature = calibrated(np.array(logits), np.array(truth)) if logits else 1.0
        at, cls = np.nonzero(weights)
        yield pd.DataFrame(
            {
                "feature": np.append(at, -1).astype("int64"),
                "cls": np.append(cls, 0).astype("int64"),
                "weight": np.append(weights[at, cls], temperature),
            }
        )

    weights, temperature = np.zeros((FEATURES + 1, len(languages))), 1.0
    # One task: the sample is bounded.
    for row in sample.repartition(1).mapInPandas(train, "feature long, cls long, weight double").collect():
        if row["feature"] < 0:
            temperature = row["weight"]
        else:
            weights[row["feature"], row["cls"]] = row["weight"]
    return {"weights": weights, "temperature": temperature, "languages": languages, "idf": idf}


def calibrated(logits: np.ndarray, truth: np.ndarray) -> float:
    """The temperature with the least negative log-likelihood, to one hundredth of its logarithm."""
    temperatures = np.exp(np.arange(-3.0, 3.0, 0.01))
    losses = [
        -np.log(np.maximum(softmax(logits / t)[np.arange(len(truth)), truth], 1e-12)).mean() for t in temperatures
    ]
    return float(temperatures[int(np.argmin(losses))])


def learn(docs: DataFrame) -> dict | None:
    """The model from docs(doc_id, text, lang), from rows outside the held-out fold alone."""
    training = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).filter(
        F.coalesce(fold("doc_id", FOLDS), F.lit(-1)) != HELD_OUT
    )
    training = training.select("doc_id", "text", "lang")
    sample = bounded_sample(training, "lang", ["doc_id", "text"], SAMPLE_ROWS)
    languages = sorted(row["lang"] for row in training.select("lang").distinct().collect())
    if not languages:
        return None
    idf = inverse_frequencies(document_frequencies(training))
    spot = F.xxhash64(F.lit("order"), "doc_id", "text")
    return fit(
        sample.select("text", "lang", spot.alias("spot"), (F.pmod(spot, F.lit(5)) == 0).alias("calibrates")),
        idf,
        languages,
    )


def predictor(spark: SparkSession, model: dict | None):
    """A column function: text to (lang_pred, score). The model has a size bound by its parameters."""
    if model is None:
        return lambda text: F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    scaled = model["weights"][:-1] * model["idf"][:, None]
    gathered = np.column_stack([scaled, model["idf"]]).astype(np.float32)
    shared = spark.sparkContext.broadcast(
        (gathered, model["weights"][-1], model["temperature"], np.array(model["languages"], dtype=object))
    )

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        gathered, intercept, temperature, languages = shared.value
        most = max(1 << 16, (4 << 20) // gathered.shape[1])
        sums = np.zeros((len(texts), gathered.shape[1]))
        for first, part in chunks(texts.tolist(), most):
            for hashed, starts in char_ngrams(*code_points(_lowered(part))):
                for lo in range(0, len(hashed), most):  # a text longer than a chunk in slices
                    hi = min(lo + most, len(hashed))
                    edges = np.clip(starts, lo, hi) - lo
                    full = np.flatnonzero(np.diff(edges))
                    if len(full):
                        rows = gathered[hashed[lo:hi]]
                        sums[first + full] += np.add.reduceat(rows, edges[full], axis=0, dtype=np.float64)
        logits = SCALE * sums[:, :-1] / np.maximum(sums[:, -1:], 1e-9) + intercept
        chance = softmax(logits / temperature)
        best = chance.argmax(axis=1)
        lettered = np.array([bool(t) and any(map(str.isalpha, t)) for t in texts])
        return pd.DataFrame(
            {
                "lang_pred": np.where(lettered, languages[best], "und"),
                "score": np.where(lettered, chance[np.arange(len(best)), best], 0.0),
            }
        )

    return predict


def identify(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """One row per row of docs(doc_id, text, lang): doc_id, held_out, lang_pred, score.

    Texts that are null, empty or without a letter are `und` with score 0. A null doc_id is
    in no fold: its row may train and is not held out. Without labelled rows all is `und`.
    Repeated rows give repeated results; an empty table gives an empty one. Other columns
    are left out.
    """
    model = model or learn(docs)
    predict = predictor(docs.sparkSession, model)
    return docs.select(
        "doc_id",
        (F.coalesce(fold("doc_id", FOLDS), F.lit(-1)) == HELD_OUT).alias("held_out"),
        predict(F.col("text")).alias("found"),
    ).select("doc_id", "held_out", "found.lang_pred", "found.score")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
