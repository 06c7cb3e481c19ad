"""Quality from weak labels.

Overlapping heuristic labellers vote on every text: bad, good, or nothing. Expectation
maximisation over the counted vote patterns of all rows (each labeller votes one way or not:
at most 2 ** labellers patterns on the driver) estimates how each labeller votes on good and on bad texts, and gives each pattern
its posterior. The posteriors of a bounded sample (SAMPLE_ROWS) train a hashed linear scorer
over shape n-grams and binned statistics of a text; every whole text is scored by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeweave.llm.common import table
from tapeweave.llm.ftrl import Ftrl, probability
from tapeweave.llm.textcodes import Words, chunks, code_points, mixed

SAMPLE_ROWS = 8000
EPOCHS = 3
BITS = 14
SCALE = 20.0
ROUNDS = 200
REJECT = 0.5
LEAST_RIGHT = 0.95

GOOD, BAD, NONE = 0, 1, 2

# ---- statistics ---------------------------------------------------------------------------

STATISTICS = [
    "words", "upper_share", "symbols_a_word", "bangs_a_word", "bars_a_word",
    "distinct_share", "repeated_lines", "letter_share", "word_length", "digit_share",
]


@lru_cache(maxsize=1)
def shape_table() -> np.ndarray:
    """Shape of each code point: ASCII punctuation keeps its own, the rest fall into few kinds."""
    shape = np.full(0x110000, 1, dtype=np.uint8)  # other signs
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            shape[c] = 3 if s.isupper() else 2 if s.islower() else 4
        elif s.isdigit():
            shape[c] = 5
        elif s == "\n":
            shape[c] = 7
        elif s.isspace():
            shape[c] = 6
    for k, s in enumerate("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"):
        shape[ord(s)] = 8 + k
    return shape


def _shape_of(signs: str) -> list[int]:
    return [int(shape_table()[ord(s)]) for s in signs]


def _distinct(hashes: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes of each of n texts."""
    order = np.lexsort((hashes, text))
    h, t = hashes[order], text[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    return np.bincount(t[new], minlength=n)


def statistics(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One row of STATISTICS a text, and the texts' shapes with where each begins."""
    codes, bounds = code_points(texts)
    shapes = shape_table()[codes]
    n = len(texts)
    text_of = np.repeat(np.arange(n), np.diff(bounds))
    counts = np.bincount(text_of * 64 + shapes, minlength=64 * n).reshape(n, 64).astype(float)
    words = Words(codes, bounds, "unspaced")
    n_words = np.diff(words.first).astype(float)
    per_word = np.maximum(n_words, 1)
    letters = counts[:, 2:5].sum(axis=1)
    unspaced = np.maximum(counts.sum(axis=1) - counts[:, 6:8].sum(axis=1), 1)
    lines = [line for t in texts for line in t.split("\n") if line.strip()]
    line_text = np.repeat(np.arange(n), [sum(1 for line in t.split("\n") if line.strip()) for t in texts])
    if lines:
        _, number = np.unique(np.array(lines, dtype=object), return_inverse=True)
        n_lines, kinds = np.bincount(line_text, minlength=n), _distinct(number, line_text, n)
    else:
        n_lines = kinds = np.zeros(n)
    out = np.column_stack(
        [
            n_words,
            counts[:, 3] / np.maximum(letters, 1),
            counts[:, _shape_of("#$%&*")].sum(axis=1) / per_word,
            counts[:, _shape_of("!")].sum(axis=1) / per_word,
            counts[:, _shape_of("|")].sum(axis=1) / per_word,
            _distinct(words.hashes, words.text, n) / per_word,
            1 - kinds / np.maximum(n_lines, 1),
            letters / unspaced,
            unspaced / per_word,
            counts[:, 5] / unspaced,
        ]
    )
    return out, shapes, bounds


# Name, statistic, vote, and the range in which the labeller casts it.
LABELLERS = [
    ("capitals", "upper_share", BAD, 0.5, np.inf),
    ("symbols", "symbols_a_word", BAD, 0.3, np.inf),
    ("bangs", "bangs_a_word", BAD, 0.3, np.inf),
    ("bars", "bars_a_word", BAD, 0.1, np.inf),
    ("few words", "distinct_share", BAD, 0.0, 0.3),
    ("repeated lines", "repeated_lines", BAD, 0.5, np.inf),
    ("few letters", "letter_share", BAD, 0.0, 0.4),
    ("long words", "word_length", BAD, 25.0, np.inf),
    ("digits", "digit_share", BAD, 0.6, np.inf),
    ("sentence case", "upper_share", GOOD, 0.001, 0.15),
    ("plain words", "letter_share", GOOD, 0.85, np.inf),
    ("varied words", "distinct_share", GOOD, 0.45, np.inf),
]
#: Repetition tells nothing about texts of fewer words.
LEAST_WORDS = 40


def votes(stats: np.ndarray) -> np.ndarray:
    """GOOD, BAD or NONE of each labeller; texts without words get no vote."""
    out = np.full((len(stats), len(LABELLERS)), NONE, dtype=np.int8)
    words = stats[:, 0]
    for k, (_, statistic, vote, low, high) in enumerate(LABELLERS):
        value = stats[:, STATISTICS.index(statistic)]
        least = LEAST_WORDS if statistic == "distinct_share" else 1
        out[(value >= low) & (value <= high) & (words >= least), k] = vote
    return out


def pattern(votes_of: np.ndarray) -> np.ndarray:
    return (votes_of.astype(np.int64) * 3 ** np.arange(votes_of.shape[1])).sum(axis=1)


def unpacked(patterns: np.ndarray) -> np.ndarray:
    return (patterns[:, None] // 3 ** np.arange(len(LABELLERS))) % 3


def vote_patterns(texts: pd.Series) -> pd.Series:
    out = np.zeros(len(texts), dtype=np.int64)
    for first, part in chunks(texts.tolist()):
        stats, _, _ = statistics(part)
        out[first : first + len(part)] = pattern(votes(stats))
    return pd.Series(out.astype("int32"))


# ---- label model --------------------------------------------------------------------------


def label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> dict:
    """EM for two classes with independent labellers: share of bad, and P(vote | class, labeller).

    Starts from "bad if any labeller says so", which also names the classes. A labeller sees
    one kind of bad text, so labellers seldom agree; free estimates would take the kind that
    several of them see for the whole class. So a labeller's bad votes are taken to be right
    LEAST_RIGHT of the time at least.
    """
    cast = unpacked(patterns)
    posterior = np.where((cast == BAD).any(axis=1), 0.999, 0.001)
    total = counts.sum()
    for _ in range(rounds):
        share = np.clip((posterior * counts).sum() / total, 1e-6, 1 - 1e-6)
        table_of = np.empty((2, cast.shape[1], 3))
        for cls, weight in ((GOOD, (1 - posterior) * counts), (BAD, posterior * counts)):
            for vote in (GOOD, BAD, NONE):
                table_of[cls, :, vote] = ((cast == vote) * weight[:, None]).sum(axis=0) + 0.5
        cried = table_of[:, :, BAD].sum(axis=0)
        excess = np.maximum(table_of[GOOD, :, BAD] - (1 - LEAST_RIGHT) * cried, 0)
        table_of[GOOD, :, BAD] -= excess
        table_of[BAD, :, BAD] += excess
        table_of /= table_of.sum(axis=2, keepdims=True)
        new = _posterior(cast, share, table_of)
        moved = np.abs(new - posterior).max()
        posterior = new
        if moved < 1e-9:
            break
    return {"share": share, "votes": table_of, "posterior": dict(zip(patterns.tolist(), posterior.tolist(), strict=True))}


def _posterior(cast: np.ndarray, share: float, table_of: np.ndarray) -> np.ndarray:
    at = np.arange(cast.shape[1])
    # A labeller that says nothing is no evidence.
    voted = cast != NONE
    bad = np.log(share) + (np.log(table_of[BAD][at, cast]) * voted).sum(axis=1)
    good = np.log(1 - share) + (np.log(table_of[GOOD][at, cast]) * voted).sum(axis=1)
    return probability(bad - good)


def accuracies(model: dict) -> list[tuple[str, float]]:
    """The share of each labeller's votes that is right, as estimated."""
    p = model["votes"]
    right = (1 - model["share"]) * p[GOOD][:, GOOD] + model["share"] * p[BAD][:, BAD]
    wrong = (1 - model["share"]) * p[GOOD][:, BAD] + model["share"] * p[BAD][:, GOOD]
    return [(name, float(r / (r + w))) for (name, *_), r, w in zip(LABELLERS, right, wrong, strict=True)]


# ---- scorer -------------------------------------------------------------------------------

# Edges of the bins that statistics fall into.
EDGES = np.array([0.001, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.5, 3, 6, 12, 25, 40, 100])


def _hashed(values: np.ndarray) -> np.ndarray:
    return (mixed(values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)


def _bins(stats: np.ndarray) -> np.ndarray:
    """One hashed feature a statistic."""
    binned = np.searchsorted(EDGES, stats, side="right")
    return _hashed((1 << 20) + np.arange(stats.shape[1]) * 64 + binned)


def _shape_grams(shapes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed triples of shapes within one text, and their texts."""
    if len(shapes) < 3:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    s = shapes.astype(np.int64)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    whole = text[2:] == text[:-2]
    lookup = _hashed(np.arange(1 << 18))
    return lookup[(s[:-2] << 12 | s[1:-1] << 6 | s[2:])[whole]], text[2:][whole]


def fit(sample: DataFrame, posterior: dict[int, float]) -> np.ndarray:
    """Weights of the hashed features, the last the intercept, from sample(text, spot)."""

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        batches = list(batches)
        if not batches:
            return
        rows = pd.concat(batches, ignore_index=True).sort_values(["spot", "text"], kind="stable")
        model, examples = Ftrl(1 << BITS, alpha=0.5, l1=0.02, l2=0.01), []
        for text in rows["text"]:
            stats, shapes, bounds = statistics([text or ""])
            label = posterior.get(int(pattern(votes(stats))[0]), 0.0)
            grams, _ = _shape_grams(shapes, bounds)
            dense = np.bincount(grams, minlength=1 << BITS) * (SCALE / max(len(grams), 1))
            dense = dense + np.bincount(_bins(stats)[0], minlength=1 << BITS)
            at = np.flatnonzero(dense)
            examples.append((at, dense[at], label))
        for _ in range(EPOCHS):
            for at, values, label in examples:
                model.fit(at, values, label)
        weights = model.all_weights()[:, 0]
        at = np.flatnonzero(weights)
        yield pd.DataFrame({"feature": at.astype("int64"), "weight": weights[at]})

    weights = np.zeros((1 << BITS) + 1)
    # One task: the sample is bounded.
    for row in sample.repartition(1).mapInPandas(train, "feature long, weight double").collect():
        weights[row["feature"]] = row["weight"]
    return weights


def learn(docs: DataFrame) -> tuple[np.ndarray, dict]:
    """The scorer's weights and the label model from docs(doc_id, text); no labels are read."""
    cast = F.pandas_udf(vote_patterns, "int")
    counted = docs.select(cast("text").alias("votes")).groupBy("votes").count().collect()
    if not counted:
        return np.zeros((1 << BITS) + 1), {}
    model = label_model(np.array([r["votes"] for r in counted]), np.array([float(r["count"]) for r in counted]))
    rows = sum(r["count"] for r in counted)
    spot = F.xxhash64(F.lit("quality"), "doc_id", "text")
    chance = F.pmod(spot, F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = docs.select("text", spot.alias("spot"), chance.alias("chance")).filter(
        F.col("chance") < min(1.0, SAMPLE_ROWS / rows)
    )
    # The limit only matters if many rows are equal.
    return fit(sample.select("text", "spot").limit(2 * SAMPLE_ROWS), model["posterior"]), model


def scorer(spark: SparkSession, weights: np.ndarray):
    """A column function: text to the chance that it is bad."""
    shared = spark.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def bad(texts: pd.Series) -> pd.Series:
        weights = shared.value
        out = np.zeros(len(texts))
        for first, part in chunks(texts.tolist()):
            stats, shapes, bounds = statistics(part)
            grams, text = _shape_grams(shapes, bounds)
            n = len(part)
            mean = np.bincount(text, weights=weights[grams], minlength=n) / np.maximum(np.bincount(text, minlength=n), 1)
            out[first : first + n] = probability(SCALE * mean + weights[_bins(stats)].sum(axis=1) + weights[-1])
        return pd.Series(out)

    return bad


def scored(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, score, accepted.

    score is the chance that the text is good; accepted says it is at least 1 - REJECT. Null
    counts as empty. Repeated rows give repeated results; an empty table gives an empty one.
    Other columns are left out.
    """
    weights, _ = learn(docs)
    bad = scorer(docs.sparkSession, weights)
    return docs.select("doc_id", (1 - bad(F.col("text"))).alias("score")).withColumn(
        "accepted", F.col("score") >= 1 - REJECT
    )


def accepted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the rows whose text is accepted, with the columns of docs."""
    weights, _ = learn(docs)
    return docs.filter(1 - scorer(spark, weights)(F.col("text")) >= 1 - REJECT)


def op6_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))
