"""Probe estimators fitted per key: standardization, linear heads, Huber, logistic, selection.

A design holds one row per key, fold and date with role 'fit' or 'score', a feature array
x and a value y; fold 0 is the outer split and folds 1..3 are the inner ones. Linear heads
need only a key's moments, which partitions add up before any shuffle. Huber and logistic
heads reweight rows each round (rounds.py), keys of any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeweave.functions.expr import finite
from tapeweave.functions.vectors import dot, field, moments, unpack, vector_size
from tapeweave.operators.metrics import classification_metrics
from tapeweave.operators.rounds import Huber, Logistic, fit_in_rounds, solve
from tapeweave.session import spread, written

# Search grids of the heads.
GRIDS = {
    "ridge": (0.0001, 0.001, 0.01, 0.1, 1.0, 10.0, 100.0),
    "huber": (0.0001, 0.001, 0.01, 0.1, 1.0, 10.0),
    "elastic_net": (0.0001, 0.001, 0.01, 0.1, 1.0),
    "logistic": (0.0001, 0.001, 0.01, 0.1, 1.0, 10.0),
}
L1_RATIOS = (0.1, 0.5, 0.9)
REGRESSION_HEADS = ("ridge", "huber", "elastic_net")
CANDIDATE = ["model_name", "alpha", "l1_ratio", "grid_order"]


# --- standardization -------------------------------------------------------------------


def _slot_arrays(rows: DataFrame, own: list[str], statistics: dict[str, Column]) -> DataFrame:
    """Per key one array per statistic, in slot order; v is the slot's value."""
    long = rows.select(*own, F.posexplode("x").alias("j", "v"))
    per_slot = long.groupBy(*own, "j").agg(*[c.alias(n) for n, c in statistics.items()])
    ordered = F.array_sort(F.collect_list(F.struct("j", *statistics)))
    return per_slot.groupBy(*own).agg(ordered.alias("_s")).select(
        *own, *[field("_s", n).alias(n) for n in statistics]
    )


def standardize(design: DataFrame, keys: list[str]) -> DataFrame:
    """Impute by train medians and scale by train mean and population deviation.

    Features without a finite train value leave the array; a zero deviation counts as one.
    """
    own = [*keys, "fold"]
    design = spread(design, *own)
    known = F.when(finite("v"), F.col("v"))
    medians = _slot_arrays(design.filter("role = 'fit'"), own, {"middle": F.percentile(known, 0.5)})
    pairs = F.filter(F.arrays_zip("x", "middle"), lambda s: s["middle"].isNotNull())
    imputed = design.join(medians, own).withColumn(
        "x", F.transform(pairs, lambda s: F.when(finite(s["x"]), s["x"]).otherwise(s["middle"]))
    ).drop("middle")
    deviation = F.stddev_pop("v")
    scales = _slot_arrays(
        imputed.filter("role = 'fit'"),
        own,
        {"center": F.avg("v"), "scale": F.when(deviation > 0, deviation).otherwise(F.lit(1.0))},
    )
    centered = F.zip_with("x", "center", lambda x, c: x - c)
    return imputed.join(scales, own).withColumn("x", F.zip_with(centered, F.col("scale"), lambda x, s: x / s)).drop(
        "center", "scale"
    )


# --- solving ------------------------------------------------------------------------------


def soft_threshold(value: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    return np.sign(value) * np.maximum(np.abs(value) - penalty, 0.0)


def ridge_coefficients(xx: np.ndarray, xy: np.ndarray, alpha: float) -> np.ndarray:
    return np.linalg.solve(xx + alpha * np.eye(len(xx)), xy)


def elastic_net_coefficients(xx: np.ndarray, xy: np.ndarray, alphas: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    """Coordinate descent on the moments, all candidates at once; one row of the result each.

    At most 100 sweeps; a candidate rests once no coefficient moves by 1e-8.
    """
    b = np.zeros((len(alphas), len(xy)))
    lasso, scale = alphas * ratios, alphas * (1.0 - ratios)
    moving = np.ones(len(alphas), dtype=bool)
    for _ in range(100):
        before = b.copy()
        for j in range(len(xy)):
            rho = xy[j] - b @ xx[:, j] + b[:, j] * xx[j, j]
            b[moving, j] = (soft_threshold(rho, lasso) / (xx[j, j] + scale))[moving]
        moving &= np.abs(b - before).max(axis=1) >= 1e-8
        if not moving.any():
            break
    return b


def logistic_coefficients(x: np.ndarray, y: np.ndarray, alphas: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logistic coefficients of rows that are all here, one row per penalty, and intercepts."""
    return solve(Logistic(len(y), float(y.mean()), float(y.std()), x.shape[1], alphas), x, y)


def huber_coefficients(x: np.ndarray, y: np.ndarray, alphas: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Huber coefficients of rows that are all here, one row per penalty, and intercepts."""
    return solve(Huber(len(y), float(y.mean()), float(y.std()), x.shape[1], alphas), x, y)


def _coefficient_schema(df: DataFrame, own: list[str]) -> T.StructType:
    return T.StructType(
        [
            *[df.schema[k] for k in own],
            T.StructField("model_name", T.StringType()),
            T.StructField("alpha", T.DoubleType()),
            T.StructField("l1_ratio", T.DoubleType()),
            T.StructField("grid_order", T.IntegerType()),
            T.StructField("coefficients", T.ArrayType(T.DoubleType())),
            T.StructField("intercept", T.DoubleType()),
        ]
    )


def _coefficient_rows(key: dict, head: str, candidates, coefficients, intercepts) -> pd.DataFrame:
    return pd.DataFrame(
        {
            **{k: [v] * len(candidates) for k, v in key.items()},
            "model_name": head,
            "alpha": [a for a, _ in candidates],
            "l1_ratio": pd.array([r for _, r in candidates], dtype="Float64"),
            "grid_order": np.arange(len(candidates), dtype=np.int32),
            "coefficients": list(coefficients),
            "intercept": intercepts,
        }
    )


def candidates_of(head: str) -> list[tuple[float, float | None]]:
    ratios = L1_RATIOS if head == "elastic_net" else (None,)
    return [(a, r) for a in GRIDS[head] for r in ratios]


def fit_linear(design: DataFrame, keys: list[str], heads: tuple[str, ...]) -> DataFrame:
    """Ridge and elastic net coefficients of every candidate from one set of moments per key and fold."""
    own = [*keys, "fold"]
    rows = design.filter("role = 'fit' AND size(x) > 0").select(*own, F.concat("x", F.array("y")).alias("xy"))
    packed = spread(moments(rows, own, "xy"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i, values in enumerate(batch["moments"]):
                m = unpack(values, vector_size(len(values)))
                size = m.total.size - 1
                xx = m.gram[:size, :size] / m.n
                xy = m.gram[:size, size] / m.n - m.mean[:size] * m.mean[size]
                key = {k: batch[k].iloc[i] for k in own}
                for head in heads:
                    grid = candidates_of(head)
                    if head == "ridge":
                        solved = [ridge_coefficients(xx, xy, a) for a, _ in grid]
                    else:
                        solved = elastic_net_coefficients(
                            xx, xy, np.array([a for a, _ in grid]), np.array([r for _, r in grid])
                        )
                    yield _coefficient_rows(key, head, grid, solved, m.mean[size])

    return packed.mapInPandas(solve, _coefficient_schema(design, own))


def fit_iterative(design: DataFrame, keys: list[str], head: str) -> DataFrame:
    """Huber or logistic coefficients of every penalty per key and fold."""
    own = [*keys, "fold"]
    rows = design.filter("role = 'fit' AND size(x) > 0").select(*own, "pos", "x", "y")
    grid = candidates_of(head)

    def as_rows(key: dict, coefficients: np.ndarray, intercepts: np.ndarray) -> pd.DataFrame:
        return _coefficient_rows(key, head, grid, coefficients, intercepts)

    return fit_in_rounds(rows, own, head, np.array([a for a, _ in grid]), _coefficient_schema(design, own), as_rows)


def fit(design: DataFrame, keys: list[str], heads: tuple[str, ...]) -> DataFrame:
    linear = tuple(h for h in heads if h in ("ridge", "elastic_net"))
    parts = [fit_linear(design, keys, linear)] if linear else []
    parts += [fit_iterative(design, keys, h) for h in heads if h not in linear]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def optimality(design: DataFrame, coefficients: DataFrame, keys: list[str]) -> DataFrame:
    """How far each candidate of a linear head is from its optimum, per key and fold.

    own keys, CANDIDATE, row_count and violation: the largest absolute entry of the gradient of
    the head's objective over the fit rows; for the elastic net, of the least subgradient.
    """
    own = [*keys, "fold"]
    rows = design.filter("role = 'fit' AND size(x) > 0").select(*own, "x", "y")
    scale = rows.groupBy(*own).agg(F.stddev_pop("y").alias("deviation"), F.count(F.lit(1)).alias("row_count"))
    delta = F.lit(1.345) * F.greatest(F.col("deviation"), F.lit(1e-12))
    error = F.col("y") - F.col("intercept") - dot("x", "coefficients")
    pull = F.when(F.col("model_name") == "huber", F.least(F.greatest(error, -delta), delta)).otherwise(error)
    slopes = (
        rows.join(scale, own)
        .join(coefficients, own)
        .select(*own, *CANDIDATE, "row_count", "coefficients", pull.alias("pull"), F.posexplode("x").alias("j", "v"))
        .groupBy(*own, *CANDIDATE, "row_count", "j")
        .agg(F.avg(-F.col("pull") * F.col("v")).alias("slope"), F.any_value(F.get("coefficients", F.col("j"))).alias("b"))
    )
    lasso = F.col("alpha") * F.coalesce("l1_ratio", F.lit(0.0))
    smooth = F.col("slope") + (F.col("alpha") - lasso) * F.col("b")
    least = F.when(F.col("b") != 0, F.abs(smooth + lasso * F.signum("b"))).otherwise(F.greatest(F.abs(smooth) - lasso, F.lit(0.0)))
    return slopes.groupBy(*own, *CANDIDATE, "row_count").agg(F.max(least).alias("violation"))


def predicted(rows: DataFrame) -> Column:
    """Prediction of a row joined with its coefficients; a probability for the logistic head."""
    level = F.col("intercept") + dot("x", "coefficients")
    bounded = F.least(F.greatest(level, F.lit(-35.0)), F.lit(35.0))
    return F.when(F.col("model_name") == "logistic", 1 / (1 + F.exp(-bounded))).otherwise(level)


# --- selection --------------------------------------------------------------------------------


def fold_scores(design: DataFrame, coefficients: DataFrame, keys: list[str]) -> DataFrame:
    """Score of every candidate on each inner fold: RMSE, or log loss for the logistic head."""
    own = [*keys, "fold"]
    scored = (
        design.filter("role = 'score' AND fold > 0")
        .join(coefficients.filter("fold > 0"), own)
        .select(*own, *CANDIDATE, F.col("y").alias("actual"), predicted(design).alias("prediction"))
    )
    by = [*own, *CANDIDATE]
    error = F.col("actual") - F.col("prediction")
    linear = (
        scored.filter("model_name != 'logistic'")
        .groupBy(*by)
        .agg(F.sqrt(F.avg(error * error)).alias("score"))
    )
    losses = classification_metrics(scored.filter("model_name = 'logistic'"), by).select(
        *by, F.col("log_loss").alias("score")
    )
    return linear.unionByName(losses)


def fallback(head: str) -> tuple[float, float | None]:
    """Parameters of a key without inner folds."""
    grid = GRIDS[head]
    alpha = 1.0 if 1.0 in grid else grid[len(grid) // 2]
    return alpha, L1_RATIOS[len(L1_RATIOS) // 2] if head == "elastic_net" else None


def select_parameters(scores: DataFrame, fitted_keys: DataFrame, keys: list[str], heads: tuple[str, ...]) -> DataFrame:
    """Best candidate per key and head by mean fold score, the earliest in the grid on ties."""
    means = scores.groupBy(*keys, *CANDIDATE).agg(F.avg("score").alias("inner_validation_score"))
    best = (
        means.select(
            "*",
            F.row_number()
            .over(Window.partitionBy(*keys, "model_name").orderBy("inner_validation_score", "grid_order"))
            .alias("_place"),
        )
        .filter("_place = 1")
        .select(*keys, "model_name", F.struct("alpha", "l1_ratio", "inner_validation_score").alias("_best"))
    )
    defaults = F.array(
        *[
            F.struct(
                F.lit(h).alias("model_name"),
                F.lit(fallback(h)[0]).alias("alpha"),
                F.lit(fallback(h)[1]).cast("double").alias("l1_ratio"),
                F.lit(float(GRIDS[h][0])).alias("low"),
                F.lit(float(GRIDS[h][-1])).alias("high"),
            )
            for h in heads
        ]
    )
    wanted = fitted_keys.select(*keys, F.explode(defaults).alias("_d")).select(*keys, "_d.*")
    alpha = F.coalesce("_best.alpha", "alpha")
    ratio = F.when(F.col("_best").isNotNull(), F.col("_best.l1_ratio")).otherwise(F.col("l1_ratio"))
    edge = (alpha == F.col("low")) | (alpha == F.col("high"))
    ratio_edge = F.coalesce(ratio.isin(L1_RATIOS[0], L1_RATIOS[-1]), F.lit(False)) & F.col("_best").isNotNull()
    return wanted.join(best, [*keys, "model_name"], "left").select(
        *keys,
        "model_name",
        alpha.alias("selected_alpha"),
        ratio.alias("selected_l1_ratio"),
        F.col("_best.inner_validation_score").alias("inner_validation_score"),
        (edge | ratio_edge).alias("selected_at_grid_boundary"),
        F.when(F.col("_best").isNull(), "insufficient_history_fallback").otherwise("selected").alias("selection_status"),
    )


def selected_coefficients(coefficients: DataFrame, selection: DataFrame, keys: list[str]) -> DataFrame:
    """Outer-fold coefficients of the selected candidate of each key and head."""
    chosen = selection.select(
        *keys,
        "model_name",
        F.col("selected_alpha").alias("alpha"),
        F.coalesce("selected_l1_ratio", F.lit(-1.0)).alias("_ratio"),
    )
    outer = coefficients.filter("fold = 0").withColumn("_ratio", F.coalesce("l1_ratio", F.lit(-1.0)))
    return outer.join(chosen, [*keys, "model_name", "alpha", "_ratio"]).drop("_ratio", "grid_order")


def apply_coefficients(rows: DataFrame, coefficients: DataFrame, keys: list[str]) -> DataFrame:
    """Predictions of outer-fold rows by every selected head."""
    return rows.filter("fold = 0").join(coefficients.drop("fold"), keys).select(
        *keys, "model_name", "alpha", "l1_ratio", "role", "date", "y", predicted(rows).alias("prediction")
    )


def run_heads(
    design: DataFrame, keys: list[str], heads: tuple[str, ...]
) -> tuple[DataFrame, DataFrame]:
    """Selection per key and head, and the selected heads' predictions on all outer rows.

    Standardized rows and coefficients are written once, as selection and prediction both read them.
    """
    return run_scaled(written(standardize(design, keys), "design"), keys, heads)


def run_scaled(
    scaled: DataFrame, keys: list[str], heads: tuple[str, ...], head_key: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """run_heads on written standardized rows; with head_key, each key takes only the head that this column names."""
    if head_key is None:
        found = fit(scaled, keys, heads)
    else:
        found = fit(scaled.filter(F.col(head_key) == heads[0]), keys, heads[:1])
        for head in heads[1:]:
            found = found.unionByName(fit(scaled.filter(F.col(head_key) == head), keys, (head,)))
    coefficients = written(found, "coefficients")
    scores = fold_scores(scaled, coefficients, keys)
    fitted = coefficients.filter("fold = 0").select(*keys).distinct()
    chosen = select_parameters(scores, fitted, keys, heads)
    if head_key is not None:
        chosen = chosen.filter(F.col("model_name") == F.col(head_key))
    selection = written(chosen, "selection")
    return selection, apply_coefficients(scaled, selected_coefficients(coefficients, selection, keys), keys)


# --- derived feature families -----------------------------------------------------------------------


def hand_components(scaled: DataFrame, keys: list[str], most: int = 8) -> DataFrame:
    """Leading principal axes of each key's standardized train rows, at most eight."""
    packed = moments(scaled.filter("role = 'fit' AND size(x) > 0"), keys, "x")

    def axes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for values in batch["moments"]:
                m = unpack(values, vector_size(len(values)))
                count = min(most, m.total.size, max(int(m.n) - 1, 1))
                _, vectors = np.linalg.eigh(m.gram)
                leading = vectors[:, ::-1][:, :count].T
                signs = np.sign(leading[np.arange(count), np.abs(leading).argmax(axis=1)])
                found.append([list(a) for a in leading * signs[:, None]])
            yield batch[keys].assign(axes=found)

    schema = T.StructType(
        [*[scaled.schema[k] for k in keys], T.StructField("axes", T.ArrayType(T.ArrayType(T.DoubleType())))]
    )
    return packed.mapInPandas(axes, schema)


def project(vector: str, axes: str) -> Column:
    return F.transform(axes, lambda axis: dot(axis, F.col(vector)))


def residual_maps(scaled: DataFrame, keys: list[str], alpha: float = 1.0) -> DataFrame:
    """Ridge maps from standardized hand features to each z coordinate, all sharing one Gram matrix."""
    sizes = scaled.filter("role = 'fit' AND size(x) > 0").select(
        *keys, F.concat("x", "z").alias("xz"), F.size("z").alias("z_size")
    )
    packed = moments(sizes, [*keys, "z_size"], "xz")

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            maps, means = [], []
            for values, width in zip(batch["moments"], batch["z_size"]):
                m = unpack(values, vector_size(len(values)))
                size = m.total.size - width
                xx = m.gram[:size, :size] / m.n
                xz = m.gram[:size, size:] / m.n - np.outer(m.mean[:size], m.mean[size:])
                maps.append([list(c) for c in ridge_coefficients(xx, xz, alpha).T])
                means.append(m.mean[size:])
            yield batch[keys].assign(maps=maps, z_mean=means)

    schema = T.StructType(
        [
            *[scaled.schema[k] for k in keys],
            T.StructField("maps", T.ArrayType(T.ArrayType(T.DoubleType()))),
            T.StructField("z_mean", T.ArrayType(T.DoubleType())),
        ]
    )
    return packed.mapInPandas(solve, schema)


def residual_z() -> Column:
    """z minus its linear prediction from the row's standardized hand features."""
    explained = F.zip_with(project("x", "maps"), F.col("z_mean"), lambda a, b: a + b)
    return F.zip_with(F.col("z"), explained, lambda a, b: a - b)
