"""Estimators that pass over their rows many times, for keys of any size.

A key's rows are cut into pieces of at most PIECE_ROWS. Tasks keep their rows; a round adds up
what every piece contributes at the present coefficients (weighted Gram matrices, gradients)
and takes one step. A key in one piece takes its rounds where it lies and leaves nothing
behind. Keys in several pieces share a barrier stage: in each round the tasks exchange the
contributions of the keys that still move, add them up in the same order and so keep the same
coefficients. An exchange takes about a second, whatever it carries. A lost task repeats the
stage.
"""

from __future__ import annotations

import base64
import pickle
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a key that one task holds: beyond, the key is cut into pieces.
PIECE_ROWS = 100_000


class Huber:
    """Thirty rounds of reweighted ridge on centered y, all penalties at once."""

    rounds = 30

    def __init__(self, n: int, level: float, deviation: float, size: int, alphas: np.ndarray):
        self.n, self.level, self.alphas = n, level, alphas
        self.delta = 1.345 * max(deviation, 1e-12)
        self.coefficients = np.zeros((len(alphas), size))

    def contribution(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Per penalty the weighted Gram matrix with the weighted products with y as its last row."""
        y = y - self.level
        out = np.empty((len(self.alphas), x.shape[1] + 1, x.shape[1]))
        for k, b in enumerate(self.coefficients):
            error = np.abs(y - x @ b)
            weight = np.where(error > self.delta, self.delta / np.maximum(error, 1e-12), 1.0)
            weighted = x * weight[:, None]
            out[k, :-1], out[k, -1] = x.T @ weighted, weighted.T @ y
        return out

    def step(self, total: np.ndarray) -> bool:
        """Moves to the solution of the summed equations; False if nothing moved."""
        before = self.coefficients
        eye = np.eye(before.shape[1])
        self.coefficients = np.stack(
            [np.linalg.solve(t[:-1] / self.n + a * eye, t[-1] / self.n) for t, a in zip(total, self.alphas, strict=True)]
        )
        return bool((np.abs(self.coefficients - before) > 1e-14 * (1 + np.abs(before))).any())

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        return self.coefficients, np.full(len(self.alphas), self.level)


class Logistic:
    """Four hundred gradient steps from the log-odds intercept, all penalties at once."""

    rounds = 400

    def __init__(self, n: int, level: float, deviation: float, size: int, alphas: np.ndarray):
        self.n, self.alphas = n, alphas
        start = np.log(np.clip(level, 1e-6, 1 - 1e-6) / np.clip(1 - level, 1e-6, 1.0))
        self.coefficients = np.zeros((size, len(alphas)))
        self.intercept = np.full(len(alphas), start)

    def contribution(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Gradients of the coefficients, the intercept's as the last row."""
        p = 1.0 / (1.0 + np.exp(-np.clip(self.intercept + x @ self.coefficients, -35.0, 35.0)))
        error = p - y[:, None]
        return np.vstack([x.T @ error, error.sum(axis=0)])

    def step(self, total: np.ndarray) -> bool:
        moves = 0.2 * (total / self.n)
        moves[:-1] += 0.2 * self.alphas * self.coefficients
        self.intercept = self.intercept - moves[-1]
        self.coefficients = self.coefficients - moves[:-1]
        return bool(np.abs(moves).max(initial=0.0) > 0)

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        return self.coefficients.T, self.intercept


HEADS: dict[str, type[Huber] | type[Logistic]] = {"huber": Huber, "logistic": Logistic}


def solve(state: Huber | Logistic, x: np.ndarray, y: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients, one row per penalty, and intercepts of a key whose rows are all here, after `most` rounds."""
    for _ in range(state.rounds if most is None else most):
        if not state.step(state.contribution(x, y)):
            break
    return state.result()


def pieces(rows: DataFrame, own: list[str]) -> DataFrame:
    """rows(own.., pos, x, y) with n, level and deviation of y over the key, how many pieces the key has, and the row's piece."""
    totals = rows.groupBy(*own).agg(
        F.count(F.lit(1)).alias("n"), F.avg("y").alias("level"), F.stddev_pop("y").alias("deviation")
    )
    cut = rows.join(totals, own).withColumn("pieces", F.ceil(F.col("n") / F.lit(PIECE_ROWS)).cast("int"))
    return cut.withColumn("piece", F.pmod(F.xxhash64("pos"), F.col("pieces")).cast("int"))


def _groups(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Consecutive rows with equal values of by, over the edges of batches."""
    held: list[pd.DataFrame] = []
    held_key = None
    for batch in batches:
        keys = list(zip(*(batch[k] for k in by), strict=True))
        first = 0
        for key, same in groupby(keys):
            count = sum(1 for _ in same)
            if held and key != held_key:
                yield held_key, pd.concat(held, ignore_index=True)
                held = []
            held.append(batch.iloc[first : first + count])
            held_key, first = key, first + count
    if held:
        yield held_key, pd.concat(held, ignore_index=True)


def _exchange(context, part: dict) -> list[dict]:
    """What every task of the stage says, in the order of tasks."""
    return [pickle.loads(base64.b64decode(said)) for said in context.allGather(base64.b64encode(pickle.dumps(part)).decode())]


def together(
    context, held: dict[tuple, list[tuple[np.ndarray, np.ndarray]]], states: dict[tuple, Huber | Logistic], rounds: int
) -> Iterator[tuple]:
    """Rounds of keys that lie in several tasks; yields the keys that this task is the first to hold.

    Every task of the stage calls it, also without keys, and takes part in the same exchanges.
    """
    here = context.partitionId()
    holders = _exchange(context, dict.fromkeys(held, here))
    first = {key: task for said in reversed(holders) for key, task in said.items()}
    moving = set(held)
    for _ in range(rounds):
        part = {key: sum(states[key].contribution(x, y) for x, y in held[key]) for key in moving}
        said = _exchange(context, part)
        if not any(said):
            break
        for key in sorted(moving, key=repr):
            if not states[key].step(sum(s[key] for s in said if key in s)):
                moving.discard(key)
    yield from (key for key in held if first[key] == here)


def fit_in_rounds(
    rows: DataFrame, own: list[str], head: str, alphas: np.ndarray, schema: T.StructType, as_rows: Callable[..., pd.DataFrame]
) -> DataFrame:
    """Coefficients of a head per key of rows(own.., pos, x, y); as_rows(key, coefficients, intercepts) makes the result's rows."""
    cut = pieces(rows, own)
    spark = rows.sparkSession
    split = not cut.filter("pieces > 1").isEmpty()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if split:  # a barrier stage runs all its tasks at once
        parts = max(1, min(parts, spark.sparkContext.defaultParallelism))
    order, most = [*own, "piece"], HEADS[head].rounds

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list[tuple[np.ndarray, np.ndarray]]] = {}
        states: dict[tuple, Huber | Logistic] = {}
        for key, group in _groups(batches, order):
            x, y = np.stack(group["x"].to_numpy()), group["y"].to_numpy(dtype=np.float64)
            one = group.iloc[0]
            state = HEADS[head](int(one["n"]), float(one["level"]), float(one["deviation"]), x.shape[1], alphas)
            if one["pieces"] == 1:
                yield as_rows(dict(zip(own, key[:-1], strict=True)), *solve(state, x, y, most))
            else:
                held.setdefault(key[:-1], []).append((x, y))
                states.setdefault(key[:-1], state)
        if split:
            from pyspark import BarrierTaskContext

            for key in together(BarrierTaskContext.get(), held, states, most):
                yield as_rows(dict(zip(own, key, strict=True)), *states[key].result())

    dealt = cut.repartition(parts, *order).sortWithinPartitions(*order, "pos")
    return dealt.mapInPandas(fit, schema, barrier=split)
