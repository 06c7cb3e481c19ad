"""Regression and classification metrics per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeweave.functions.expr import finite, pearson, ratio, ratio_or_zero
from tapeweave.functions.ordered import ROWS_PER_BUCKET, running_before
from tapeweave.functions.ranks import rank_correlations

CLIP = 1e-12


def finite_pairs(rows: DataFrame) -> DataFrame:
    return rows.filter(finite("actual") & finite("prediction"))


def correlation(a: str, b: str) -> Column:
    """Pearson correlation; 0 where a side is constant."""
    return F.coalesce(pearson(a, b), F.lit(0.0))


def regression_metrics(rows: DataFrame, keys: list[str], extra: tuple[Column, ...] = ()) -> DataFrame:
    """Error, fit, level and spread figures of the finite pairs of each key, in one mergeable aggregate.

    extra aggregates run over all rows of the key in the same pass.
    """
    known = finite("actual") & finite("prediction")
    paired = rows.withColumns(
        {"_a": F.when(known, F.col("actual")), "_p": F.when(known, F.col("prediction"))}
    )
    residual = F.col("_a") - F.col("_p")

    def exact_variance(c: str) -> Column:
        """0 for a constant, whose merged variance may be rounding noise."""
        return F.when(F.max(c) > F.min(c), F.var_pop(c)).otherwise(0.0)

    # Deviations are roots of the variances: an aggregate of their own would make every row pay again.
    variance = exact_variance("_a")
    spread, predicted = F.sqrt(variance), F.sqrt(exact_variance("_p"))
    zero = F.lit(0.0)
    return (
        paired.groupBy(*keys)
        .agg(
            F.count("_a").alias("scored_count"),
            F.sqrt(F.avg(residual * residual)).alias("rmse"),
            F.avg(F.abs(residual)).alias("mae"),
            F.coalesce(1 - ratio(F.avg(residual * residual), variance), zero).alias("r2"),
            F.coalesce(ratio(F.covar_pop("_a", "_p"), spread * predicted), zero).alias("pearson_correlation"),
            F.avg("_a").alias("actual_mean"),
            spread.alias("actual_std"),
            F.avg("_p").alias("prediction_mean"),
            predicted.alias("prediction_std"),
            F.avg(-residual).alias("bias"),
            F.coalesce(ratio(predicted, spread), zero).alias("std_ratio"),
            *extra,
        )
        .filter(F.col("scored_count") > 0)
    )


def spearman(rows: DataFrame, keys: list[str], rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Correlation of average ranks per key."""
    pairs = finite_pairs(rows).select(*keys, "actual", F.array(F.col("prediction").cast("double")).alias("_listed"))
    ranked = rank_correlations(pairs, keys, "actual", "_listed", 1, rows_per_bucket)
    return ranked.select(*keys, F.col("rank_correlation").alias("spearman_correlation"))


def listed_spearman(
    rows: DataFrame, keys: list[str], predictions: str, names: list[str], rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """spearman() of rows that hold the predictions of all names in one array column, per key and predictor_name.

    The outcome is ranked once for all predictors.
    """
    ranked = rank_correlations(rows.select(*keys, "actual", predictions), keys, "actual", predictions, len(names), rows_per_bucket)
    name = F.get(F.array(*[F.lit(n) for n in names]), F.col("place"))
    return ranked.select(*keys, name.alias("predictor_name"), F.col("rank_correlation").alias("spearman_correlation"))


def full_regression_metrics(
    rows: DataFrame, keys: list[str], extra: tuple[Column, ...] = (), ranks: DataFrame | None = None
) -> DataFrame:
    """All regression metrics: one pass for the moments, one for the ranks.

    ranks: the rank correlations of the same rows and keys, where they were made from listed predictions.
    """
    return regression_metrics(rows, keys, extra).join(spearman(rows, keys) if ranks is None else ranks, keys)


def clipped_probability(column: str = "prediction") -> Column:
    return F.least(F.greatest(F.col(column), F.lit(CLIP)), F.lit(1.0 - CLIP))


def _probability_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Positives and negatives per key and distinct probability."""
    p = finite_pairs(rows).select(*keys, "actual", clipped_probability().alias("probability"))
    return p.groupBy(*keys, "probability").agg(
        F.count_if(F.col("actual") == 1).alias("pos"), F.count_if(F.col("actual") == 0).alias("neg")
    )


def roc_auc(rows: DataFrame, keys: list[str], rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Area under the ROC curve from average ranks; 0.5 where a class is missing."""
    counts = _probability_counts(rows, keys)
    ranked = running_before(counts, keys, "probability", ["pos", "neg"], rows_per_bucket)
    wins = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2))
    product = F.sum("pos").cast("double") * F.sum("neg")
    return ranked.groupBy(*keys).agg(F.coalesce(ratio(wins, product), F.lit(0.5)).alias("roc_auc"))


def average_precision(
    rows: DataFrame, keys: list[str], tie_break: str, rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Mean precision at each positive by falling probability, ties in tie_break order."""
    p = finite_pairs(rows).select(
        *keys,
        (-clipped_probability()).alias("order"),
        F.col(tie_break).alias("tie"),
        F.col("actual"),
    )
    # Rows of one probability are ordered among themselves; probabilities are ranked in buckets.
    level = p.groupBy(*keys, "order").agg(F.count(F.lit(1)).alias("rows"), F.sum("actual").alias("hits"))
    before = running_before(level, keys, "order", ["rows", "hits"], rows_per_bucket).select(
        *keys, "order", "rows_before", "hits_before"
    )
    within = running_before(
        p.select(*keys, "order", "tie", F.col("actual").alias("hit"), F.lit(1).alias("one")),
        [*keys, "order"],
        "tie",
        ["one", "hit"],
        rows_per_bucket,
    )
    placed = within.join(before, [*keys, "order"])
    hits = F.col("hits_before") + F.col("hit_before") + F.col("hit")
    depth = F.col("rows_before") + F.col("one_before") + 1
    positives = F.sum("hit")
    return placed.groupBy(*keys).agg(
        F.coalesce(ratio(F.sum(F.col("hit") * hits / depth), positives), F.lit(0.0)).alias("pr_auc")
    )


def classification_metrics(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Accuracy, balanced accuracy, Brier score, log loss and prevalence per key."""
    p = finite_pairs(rows).select(*keys, F.col("actual").cast("int").alias("y"), clipped_probability().alias("p"))
    hit = (F.col("p") >= 0.5).cast("int") == F.col("y")

    def share(label: int) -> Column:
        own = F.count_if(F.col("y") == label)
        return F.coalesce(ratio(F.count_if(hit & (F.col("y") == label)), own), F.lit(0.0))

    loss = F.when(F.col("y") == 1, F.ln("p")).otherwise(F.ln(1 - F.col("p")))
    return p.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("scored_count"),
        F.avg(hit.cast("double")).alias("accuracy"),
        ((share(1) + share(0)) / 2).alias("balanced_accuracy"),
        F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("brier_score"),
        (-F.avg(loss)).alias("log_loss"),
        F.avg(F.col("y").cast("double")).alias("class_prevalence"),
    )


# --- legal ranges -------------------------------------------------------------------------------


def legal_range(target: Column, space: Column) -> tuple[Column, Column, Column]:
    """Lower bound, upper bound and reason of a target's legal predictions.

    Bounds hold only in original units and for probabilities. The first matching name decides.
    """
    none = F.lit(None).cast("double")
    kind = (
        F.when(space == "probability", "probability")
        .when(space != "original", "free")
        .when(target.contains("log_realized_vol"), "free")
        .when(target.contains("log_drawdown_magnitude"), "log_magnitude")
        .when(target.contains("drawdown_magnitude"), "magnitude")
        .when(target.contains("max_drawdown"), "drawdown")
        .when(target.contains("realized_vol"), "vol")
        .when(target.contains("probability") | target.endswith("_prob"), "probability")
        .otherwise("free")
    )
    lower = F.when(kind.isin("log_magnitude", "magnitude", "vol", "probability"), F.lit(0.0)).otherwise(none)
    upper = F.when(kind == "drawdown", F.lit(0.0)).when(kind == "probability", F.lit(1.0)).otherwise(none)
    reason = (
        F.when(kind == "log_magnitude", "log_drawdown_magnitude_below_zero")
        .when(kind == "magnitude", "drawdown_magnitude_below_zero")
        .when(kind == "drawdown", "max_drawdown_above_zero")
        .when(kind == "vol", "realized_volatility_below_zero")
        .when(kind == "probability", "probability_outside_zero_one")
    )
    return lower, upper, reason


def with_validity(
    rows: DataFrame,
    target: str = "score_target_name",
    space: str = "score_space",
    bounds: tuple[str, str, str] | None = None,
) -> DataFrame:
    """Adds invalid_prediction and its reason ('' for a valid prediction).

    bounds: columns of the legal range, where it was found once per target; they are left out.
    """
    lower, upper, reason = map(F.col, bounds) if bounds else legal_range(F.col(target), F.col(space))
    p = F.col("prediction")
    outside = F.coalesce(p < lower, F.lit(False)) | F.coalesce(p > upper, F.lit(False))
    known = finite(p)
    return rows.select(
        *[c for c in rows.columns if c not in (bounds or ())],
        (~known | outside).alias("invalid_prediction"),
        F.when(~known, "non_finite_prediction").when(outside, reason).otherwise("").alias("invalid_prediction_reason"),
    )


# --- comparisons ------------------------------------------------------------------------------------


def incremental_comparison(results: DataFrame, keys: list[str], hand: str, both: str) -> DataFrame:
    """Hand-only against hand-plus-vector metrics of the same key and head.

    hand and both are feature families of the results table.
    """
    measures = ("rmse", "mae", "r2")

    def side(family: str, prefix: str) -> DataFrame:
        return results.filter(F.col("feature_family") == family).select(
            *keys, *[F.col(m).alias(f"{prefix}_{m}") for m in measures]
        )

    joined = side(hand, "hand_only").join(side(both, "hand_plus_z"), keys)
    return joined.select(
        *keys,
        *[f"hand_only_{m}" for m in measures],
        *[f"hand_plus_z_{m}" for m in measures],
        (F.col("hand_plus_z_rmse") - F.col("hand_only_rmse")).alias("delta_rmse"),
        (F.col("hand_plus_z_mae") - F.col("hand_only_mae")).alias("delta_mae"),
        ratio_or_zero("hand_plus_z_rmse", "hand_only_rmse").alias("rmse_ratio_vs_hand"),
    )
