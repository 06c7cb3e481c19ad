"""Moving-block bootstrap of paired predictions.

Draws are keyed hashes, so every task computes the same block starts. A block is a run of
positions, so its sums are differences of prefix sums: a draw costs its number of blocks,
not its number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeweave.functions.expr import finite, ratio
from tapeweave.functions.vectors import field
from tapeweave.operators.metrics import correlation, roc_auc
from tapeweave.session import spread

SAMPLES = 500
SEED = 1729


def hash_below(key: Column, bound: Column) -> Column:
    """Integer in [0, bound) from a key's SHA-256."""
    word = F.conv(F.substring(F.sha2(key, 256), 1, 13), 16, 10).cast("bigint")
    return F.pmod(word, bound)


def block_starts(
    segments: DataFrame, keys: list[str], samples: int = SAMPLES, seed: int = SEED
) -> DataFrame:
    """Block starts and lengths of every draw of every segment.

    segments: keys, segment (its number among the pooled ones), n rows and block_length.
    The last block is cut so that a draw has exactly n positions.
    """
    block = F.least("block_length", "n")
    drawn = segments.select(
        *keys,
        "segment",
        "n",
        block.cast("int").alias("size"),
        F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("draw"),
    ).select(
        "*",
        F.explode(F.sequence(F.lit(0), (F.ceil(F.col("n") / F.col("size")) - 1).cast("int"))).alias("block"),
    )
    key = F.concat_ws(
        "|",
        (F.lit(seed) + F.col("segment")).cast("string"),
        F.col("n").cast("string"),
        F.col("size").cast("string"),
        F.col("draw").cast("string"),
        F.col("block").cast("string"),
    )
    start = hash_below(key, F.col("n") - F.col("size") + 1)
    length = F.least(F.col("size"), F.col("n") - F.col("block") * F.col("size"))
    return drawn.select(
        *keys, "segment", "draw", "block", start.cast("int").alias("start"), length.cast("int").alias("length")
    )


def resampled_positions(starts: DataFrame, keys: list[str]) -> DataFrame:
    """Positions of every draw, in draw order."""
    return starts.select(
        *keys,
        "segment",
        "draw",
        "block",
        F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("position"),
    )


def align(predictions: DataFrame, keys: list[str], comparator: str = "hand_market_features") -> DataFrame:
    """Candidate and hand predictions of the same head, window, target, space and date.

    Raises if the two sides disagree about the actual value.
    """
    shared = [k for k in keys if k not in ("feature_family", "predictor_name")]
    models = predictions.filter(F.col("predictor_kind") == "model")
    candidates = models.filter(~F.col("feature_family").isin(comparator, "hand_market_pca"))
    hand = models.filter(F.col("feature_family") == comparator).select(
        *shared, "date", F.col("actual").alias("hand_actual"), F.col("prediction").alias("hand_prediction")
    )
    joined = candidates.select(*keys, "date", "horizon_days", "actual", "prediction").join(hand, [*shared, "date"])
    apart = F.abs(F.col("actual") - F.col("hand_actual")) > 1e-8 + 1e-5 * F.abs("hand_actual")
    if not joined.filter(apart).isEmpty():
        raise ValueError("candidate and hand predictions are not target-aligned")
    return joined.filter(finite("actual") & finite("prediction") & finite("hand_prediction")).drop("hand_actual")


def regression_draws(aligned: DataFrame, keys: list[str], segment: Column, samples: int, seed: int) -> DataFrame:
    """RMSE difference to hand and Pearson correlation of every draw.

    aligned carries one row per key, window and date; a window is one segment of its key and
    holds at most one row per calendar date.
    """
    a, p = F.col("actual"), F.col("prediction")
    measures = {
        "candidate_square": (a - p) * (a - p),
        "hand_square": (a - F.col("hand_prediction")) * (a - F.col("hand_prediction")),
        "a": a - F.col("a_mean"),
        "p": p - F.col("p_mean"),
        "aa": (a - F.col("a_mean")) * (a - F.col("a_mean")),
        "pp": (p - F.col("p_mean")) * (p - F.col("p_mean")),
        "ap": (a - F.col("a_mean")) * (p - F.col("p_mean")),
    }
    # Dealt before the windows: a repartition after windows on the same keys is dropped as redundant,
    # and what is left may be put together to a single task.
    aligned = spread(aligned, *keys)
    # Centering on the key's own means leaves every correlation as it is and keeps sums small.
    own = Window.partitionBy(*keys)
    centered = aligned.select("*", F.avg("actual").over(own).alias("a_mean"), F.avg("prediction").over(own).alias("p_mean"))
    run = Window.partitionBy(*keys, "segment").orderBy("date")
    summed = centered.withColumn("segment", segment).select(
        *keys, "segment", "horizon_days", "date", *[F.sum(c).over(run).alias(m) for m, c in measures.items()]
    )
    ordered = F.array_sort(F.collect_list(F.struct("date", *measures)))
    runs = (
        summed.groupBy(*keys, "segment", "horizon_days")
        .agg(ordered.alias("_rows"), F.count(F.lit(1)).cast("int").alias("n"))
        .select(
            *keys,
            "segment",
            "n",
            F.col("horizon_days").alias("block_length"),
            *[field("_rows", m).alias(m) for m in measures],
        )
    )
    shapes = runs.select("segment", "n", "block_length").distinct()
    starts = block_starts_by_shape(shapes, samples, seed)

    def taken(m: str) -> Column:
        before = F.when(F.col("start") > 0, F.get(m, F.col("start") - 1)).otherwise(F.lit(0.0))
        return F.sum(F.get(m, F.col("start") + F.col("length") - 1) - before).alias(m)

    sums = (
        runs.join(starts, ["segment", "n", "block_length"])
        .groupBy(*keys, "draw")
        .agg(F.sum("length").alias("rows"), *[taken(m) for m in measures])
    )
    rows = F.col("rows")
    av = F.col("aa") - F.col("a") * F.col("a") / rows
    pv = F.col("pp") - F.col("p") * F.col("p") / rows
    cov = F.col("ap") - F.col("a") * F.col("p") / rows
    varied = (av > 1e-24) & (pv > 1e-24)
    return sums.select(
        *keys,
        "draw",
        (F.sqrt(F.greatest("candidate_square", F.lit(0.0)) / rows) - F.sqrt(F.greatest("hand_square", F.lit(0.0)) / rows)).alias(
            "rmse_difference_vs_hand"
        ),
        F.when(varied, ratio(cov, F.sqrt(F.greatest(av * pv, F.lit(0.0))))).otherwise(F.lit(0.0)).alias(
            "pearson_correlation"
        ),
    )


def block_starts_by_shape(shapes: DataFrame, samples: int, seed: int) -> DataFrame:
    """Starts once per distinct (segment, n, block length); keys of equal shape share their draws."""
    named = shapes.select("segment", "n", "block_length", F.col("n").alias("shape_n"), F.col("block_length").alias("shape_b"))
    return block_starts(named, ["shape_n", "shape_b"], samples, seed).select(
        "segment", F.col("shape_n").alias("n"), F.col("shape_b").alias("block_length"), "draw", "block", "start", "length"
    )


def classification_draws(aligned: DataFrame, keys: list[str], segment: Column, samples: int, seed: int) -> DataFrame:
    """ROC-AUC and Brier difference to hand of every draw.

    A draw keeps one weight per position; ranks come from weights per probability.
    """
    def clip(c: str) -> Column:
        return F.least(F.greatest(F.col(c), F.lit(1e-12)), F.lit(1.0 - 1e-12))

    numbered = spread(aligned, *keys).withColumn("segment", segment).select(
        *keys,
        "segment",
        F.col("horizon_days").alias("block_length"),
        F.col("actual").alias("y"),
        clip("prediction").alias("p"),
        clip("hand_prediction").alias("h"),
        (F.row_number().over(Window.partitionBy(*keys, "segment").orderBy("date")) - 1).alias("position"),
        F.count(F.lit(1)).over(Window.partitionBy(*keys, "segment")).cast("int").alias("n"),
    )
    shapes = numbered.select("segment", "n", "block_length").distinct()
    positions = resampled_positions(block_starts_by_shape(shapes, samples, seed), ["n", "block_length"])
    spot = ["segment", "n", "block_length", "position"]
    weights = positions.groupBy(*spot, "draw").agg(F.count(F.lit(1)).alias("w"))
    drawn_at = weights.groupBy(*spot).agg(F.collect_list(F.struct("draw", "w")).alias("_draws"))
    # Rows meet their positions' draws as one list, move to their key's task and unfold there: no
    # unfolded row is shuffled, and neither side is collected.
    placed = spread(numbered, *spot).join(spread(drawn_at, *spot).hint("merge"), spot)
    drawn = spread(placed, *keys).select(*keys, "y", "p", "h", F.inline("_draws"))
    y, w = F.col("y"), F.col("w")
    levels = drawn.groupBy(*keys, "draw", "p").agg(
        F.sum(F.when(y == 1, w).otherwise(0)).alias("pos"),
        F.sum(F.when(y == 0, w).otherwise(0)).alias("neg"),
        F.sum(w * ((F.col("p") - y) * (F.col("p") - y) - (F.col("h") - y) * (F.col("h") - y))).alias("brier"),
        F.sum(w).alias("rows"),
    )
    below = Window.partitionBy(*keys, "draw").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    ranked = levels.select("*", F.coalesce(F.sum("neg").over(below), F.lit(0)).alias("neg_before"))
    product = F.sum("pos").cast("double") * F.sum("neg")
    wins = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2))
    return ranked.groupBy(*keys, "draw").agg(
        F.coalesce(ratio(wins, product), F.lit(0.5)).alias("roc_auc"),
        (F.sum("brier") / F.sum("rows")).alias("brier_score_difference_vs_hand"),
    )


def intervals(draws: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """2.5th and 97.5th percentile of each metric over the draws of a key."""
    long = draws.unpivot([*keys, "draw"], metrics, "metric", "value")
    bounds = F.percentile("value", F.array(F.lit(0.025), F.lit(0.975)))
    return long.groupBy(*keys, "metric").agg(
        F.count(F.lit(1)).alias("sample_count"), bounds[0].alias("ci_lower"), bounds[1].alias("ci_upper")
    )


REGRESSION_METRICS = ["rmse_difference_vs_hand", "pearson_correlation"]
CLASSIFICATION_METRICS = ["roc_auc", "brier_score_difference_vs_hand"]


def point_estimates(aligned: DataFrame, keys: list[str]) -> DataFrame:
    """RMSE difference and correlation on the rows as they are."""
    a = F.col("actual")

    def rmse(c: str) -> Column:
        return F.sqrt(F.avg((a - F.col(c)) * (a - F.col(c))))

    return aligned.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("aligned_row_count"),
        (rmse("prediction") - rmse("hand_prediction")).alias("rmse_difference_vs_hand"),
        correlation("actual", "prediction").alias("pearson_correlation"),
    )


def classification_estimates(aligned: DataFrame, keys: list[str]) -> DataFrame:
    """Area under the curve and Brier score difference on the rows as they are."""
    a = F.col("actual")

    def brier(c: str) -> Column:
        return F.avg((a - F.col(c)) * (a - F.col(c)))

    scores = aligned.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("aligned_row_count"),
        (brier("prediction") - brier("hand_prediction")).alias("brier_score_difference_vs_hand"),
    )
    return scores.join(roc_auc(aligned, keys), keys)


def window_segment() -> Column:
    return F.lit(0)


def pooled_segment(combination: list[str]) -> Column:
    """Number of a row's window among its combination's windows, by name."""
    return F.dense_rank().over(Window.partitionBy(*combination).orderBy("validation_window_name")) - 1


def stability(estimates: DataFrame, combination: list[str], metric: str) -> DataFrame:
    """Cross-window view of a metric: windows beating hand, worst, median and correlation signs."""
    sign = (
        F.when(F.col("pearson_correlation") > 0, "positive")
        .when(F.col("pearson_correlation") < 0, "negative")
        .otherwise("zero")
    )
    signs = F.array_sort(F.collect_list(F.struct("validation_window_name", sign.alias("sign"))))
    has_sign = "pearson_correlation" in estimates.columns
    return estimates.groupBy(*combination).agg(
        F.count(F.lit(1)).alias("window_count"),
        F.count_if(F.col(metric) < 0).alias("windows_beating_hand"),
        F.max(metric).alias("worst_window_metric"),
        F.percentile(metric, 0.5).alias("median_metric"),
        (
            F.array_join(F.transform(signs, lambda s: F.concat_ws(":", s["validation_window_name"], s["sign"])), ",")
            if has_sign
            else F.lit("")
        ).alias("correlation_signs"),
    )
