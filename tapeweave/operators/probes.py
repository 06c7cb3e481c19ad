"""Walk-forward probes: from probe rows to one long prediction table.

The evaluation grid (window, target variant, feature family, head, candidate, fold) is a
table crossed with rows; Spark fits and scores all of it in a few jobs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeweave.functions.expr import finite, ratio_or_zero
from tapeweave.operators import estimators as est
from tapeweave.operators.metrics import (
    average_precision,
    classification_metrics,
    full_regression_metrics,
    roc_auc,
    with_validity,
)
from tapeweave.operators.probe_data import (
    inverse_value,
    label_thresholds,
    label_value,
    target_rows,
    transform_value,
)
from tapeweave.operators.splits import expanding_folds, outer_train
from tapeweave.session import written

WINDOW = "validation_window_name"
CELL = [WINDOW, "target"]
KEYS = [*CELL, "family"]
IDENTITY = [
    WINDOW, "raw_target", "target", "target_transform", "task_type", "score_space", "score_target_name",
    "horizon_days", "predictor_name", "predictor_kind", "model_name", "feature_family",
]


def outer_rows(rows: DataFrame, targets: list[str], z: list[str], hand: list[str], windows: DataFrame) -> DataFrame:
    """Train and validation rows of every window and target variant, purged by the target's horizon."""
    vectors = rows.select(
        "date", "pos", "split", WINDOW, *targets, *[c for c in rows.columns if c.startswith("baseline__")],
        F.array(*z).cast("array<double>").alias("z"),
        F.array(*hand).cast("array<double>").alias("hand"),
    )
    long = target_rows(vectors, targets, ["date", "pos", "split", WINDOW, "z", "hand"])
    columns = [
        WINDOW, "raw_target", "target", "target_transform", "horizon", "date", "pos", "raw_value", "value",
        "raw_proxy", "z", "hand",
    ]
    train = outer_train(long, windows, F.col("horizon")).select(*columns, F.lit("fit").alias("role"))
    held = long.filter((F.col("split") == "validation") & (F.col(WINDOW) != ""))
    return train.unionByName(held.select(*columns, F.lit("score").alias("role")))


def folds_of(outer: DataFrame, cell: list[str]) -> DataFrame:
    """Outer fold 0 and the inner folds of each cell: fold, role and date."""
    train = outer.filter("role = 'fit'").select(*cell, "horizon", "date", "pos")
    inner = expanding_folds(train, cell).select(*cell, "date", "fold", F.col("role").alias("fold_role"))
    return outer.select(*cell, "date", F.lit(0).alias("fold"), F.col("role").alias("fold_role")).unionByName(inner)


def derived_families(outer: DataFrame, cell: list[str]) -> DataFrame:
    """Per cell and date: hand features on their leading axes, and z less its linear hand part.

    Both maps are fitted on the cell's outer train rows.
    """
    rows = outer.select(*cell, "date", "pos", "role", "z", F.lit(0).alias("fold"), F.col("hand").alias("x"))
    scaled = written(est.standardize(rows, cell), "hand-design")
    return (
        scaled.join(est.hand_components(scaled, cell), cell, "left")
        .join(est.residual_maps(scaled, cell), cell, "left")
        .select(*cell, "date", est.project("x", "axes").alias("hand_pca"), est.residual_z().alias("residual_z"))
    )


def design_rows(outer: DataFrame, derived: DataFrame, folds: DataFrame, cell: list[str], families: dict[str, Column]) -> DataFrame:
    """One row per cell, feature family, fold and date."""
    sets = F.array(*[F.struct(F.lit(name).alias("family"), x.alias("x")) for name, x in families.items()])
    wide = outer.join(derived, [*cell, "date"]).select(
        *cell, "date", "pos", F.col("value").alias("y"), F.explode(sets).alias("_f")
    )
    return (
        wide.select(*cell, "date", "pos", "y", "_f.family", "_f.x")
        .filter("x IS NOT NULL AND size(x) > 0")
        .join(folds, [*cell, "date"])
        .select(*cell, "family", "fold", F.col("fold_role").alias("role"), "date", "pos", "y", "x")
    )


def family_columns(residual: bool) -> dict[str, Column]:
    """Feature families as array expressions over a row's z, hand and derived arrays."""
    sets = {
        "z_only": F.col("z"),
        "hand_market_features": F.col("hand"),
        "hand_market_pca": F.col("hand_pca"),
        "hand_market_features_plus_z": F.concat("hand", "z"),
    }
    if residual:
        sets["feature_residualized_z_only"] = F.col("residual_z")
    return sets


# --- prediction rows --------------------------------------------------------------------------


def spaced(predictions: DataFrame) -> DataFrame:
    """Rows per score space: raw variants in original units, others in both spaces.

    predictions carry the cell's transform, raw and transformed actuals, and a prediction
    in the model's own space.
    """
    raw, clipped = inverse_value(F.col("prediction"), F.col("target_transform"))
    no = F.lit(False)

    def side(space: str, name: str, actual: str, prediction: Column, clip: Column) -> Column:
        return F.struct(
            F.lit(space).alias("score_space"),
            F.col(name).alias("score_target_name"),
            F.col(actual).alias("actual"),
            prediction.alias("prediction"),
            clip.alias("inverse_prediction_clipped"),
        )

    own = side("transformed", "target", "value", F.col("prediction"), no)
    original = side("original", "raw_target", "raw_value", raw, clipped)
    plain = F.col("target_transform") == "raw"
    others = [c for c in predictions.columns if c not in ("prediction", "raw_value", "value")]
    return predictions.select(
        *others, F.explode(F.when(plain, F.array(original)).otherwise(F.array(own, original))).alias("_s")
    ).select(*others, "_s.*")


def baseline_predictions(outer: DataFrame) -> DataFrame:
    """Train mean and trailing proxy of every cell; a missing proxy falls back to the mean."""
    means = outer.filter("role = 'fit'").groupBy(*CELL).agg(F.avg("value").alias("prediction"))
    held = outer.filter("role = 'score'").select(
        *CELL, "raw_target", "target_transform", F.col("horizon").alias("horizon_days"), "date", "raw_value", "value", "raw_proxy"
    )
    mean = spaced(held.join(means, CELL))
    proxy = F.when(F.col("score_space") == "original", F.col("raw_proxy")).otherwise(
        transform_value(F.col("raw_proxy"), F.col("target_transform"))
    )
    fallen = F.when(finite(proxy), proxy).otherwise(F.col("prediction"))
    trailing = mean.select(
        *[c for c in mean.columns if c not in ("prediction", "inverse_prediction_clipped")],
        fallen.alias("prediction"),
        F.lit(False).alias("inverse_prediction_clipped"),
    )

    def named(df: DataFrame, name: str, family: str) -> DataFrame:
        return df.drop("raw_proxy").select(
            "*",
            F.lit("regression").alias("task_type"),
            F.lit(name).alias("predictor_name"),
            F.lit("baseline").alias("predictor_kind"),
            F.lit(name).alias("model_name"),
            F.lit(family).alias("feature_family"),
            F.lit(None).cast("double").alias("selected_alpha"),
        )

    return prediction_table(
        named(mean, "train_mean", "constant").unionByName(
            named(trailing, "trailing_target_proxy", "trailing_proxy")
        )
    )


def prediction_table(rows: DataFrame) -> DataFrame:
    """The long prediction table with validity flags."""
    base = rows.select(
        "date", *IDENTITY, "selected_alpha", "actual", "prediction", "inverse_prediction_clipped"
    )
    return with_validity(base)


def _named_models(df: DataFrame, family: str = "family") -> DataFrame:
    return df.select(
        *[c for c in df.columns if c not in ("family", "alpha", "l1_ratio", "role", "y")],
        F.col("alpha").alias("selected_alpha"),
        F.col(family).alias("feature_family"),
        F.concat_ws("__", "model_name", family).alias("predictor_name"),
        F.lit("model").alias("predictor_kind"),
    )


def cell_facts(outer: DataFrame) -> DataFrame:
    return outer.filter("role = 'score'").select(
        *CELL, "raw_target", "target_transform", F.col("horizon").alias("horizon_days"), "date", "raw_value", "value"
    )


def regression_probes(outer: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Selections and predictions of every family and regression head, and of the incremental models."""
    derived = written(derived_families(outer, CELL), "derived")
    folds = written(folds_of(outer, CELL), "folds")
    design = written(design_rows(outer, derived, folds, CELL, family_columns(residual=True)), "regression-design")
    scaled = written(est.standardize(design, KEYS), "design")
    selection, fitted = est.run_scaled(scaled, KEYS, est.REGRESSION_HEADS)
    fitted = written(fitted, "fitted")
    facts = cell_facts(outer)
    models = spaced(
        _named_models(fitted.filter("role = 'score'")).join(facts, [*CELL, "date"])
    ).withColumn("task_type", F.lit("regression"))

    incremental_selection, incremental = incremental_probes(scaled, fitted)
    joined = incremental.join(facts, [*CELL, "date"])
    raw, clipped = inverse_value(F.col("prediction"), F.col("target_transform"))
    combined = joined.select(
        *[c for c in joined.columns if c not in ("prediction", "raw_value", "value")],
        F.lit("original").alias("score_space"),
        F.col("raw_target").alias("score_target_name"),
        F.col("raw_value").alias("actual"),
        raw.alias("prediction"),
        clipped.alias("inverse_prediction_clipped"),
        F.lit("regression").alias("task_type"),
    )
    return selection.unionByName(incremental_selection), prediction_table(models).unionByName(prediction_table(combined))


INCREMENTAL = "hand_market_features_plus_residual_z"


def incremental_probes(scaled: DataFrame, fitted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hand model plus a z model of its train residual, per head.

    The hand prediction of each row is subtracted from its value, a z model is selected and
    fitted on what is left, and both predictions are added up again. The z rows are standardized
    already, the same for every head; all heads run in the same jobs.
    """
    hand = fitted.filter("family = 'hand_market_features'").select(
        *CELL, "date", F.col("model_name").alias("family"), F.col("prediction").alias("hand_prediction")
    )
    rows = scaled.filter("family = 'z_only'").drop("family").join(hand, [*CELL, "date"])
    residual = rows.select(
        *KEYS, "fold", "role", "date", "pos", (F.col("y") - F.col("hand_prediction")).alias("y"), "x"
    )
    selections, predictions = est.run_scaled(written(residual, "residual-design"), KEYS, est.REGRESSION_HEADS, "family")
    held = predictions.filter("role = 'score'").join(hand, [*KEYS, "date"])
    added = held.withColumn("prediction", F.col("prediction") + F.col("hand_prediction")).drop("hand_prediction")
    named = _named_models(added.withColumn("family", F.lit(INCREMENTAL)))
    return selections.withColumn("family", F.lit(INCREMENTAL)), named


def label_rows(outer: DataFrame) -> DataFrame:
    """Outer rows of every regime label; labels constant over their train rows are left out."""
    raw = outer.filter("target_transform = 'raw'")
    thresholds = label_thresholds(raw.filter("role = 'fit'"), [WINDOW])
    labelled = raw.join(thresholds, [WINDOW, "raw_target"]).select(
        WINDOW,
        "raw_target",
        F.col("classification_label").alias("target"),
        "threshold",
        "horizon",
        "date",
        "pos",
        "role",
        "z",
        "hand",
        label_value(F.col("raw_value"), F.col("label_kind"), F.col("threshold")).alias("value"),
    )
    varied = (
        labelled.filter("role = 'fit'").groupBy(*CELL).agg(F.min("value").alias("low"), F.max("value").alias("high"))
        .filter("low < high").select(*CELL)
    )
    return labelled.join(varied, CELL, "left_semi")


def classification_probes(labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Class prior and logistic heads of every feature family."""
    derived = written(derived_families(labels, CELL), "derived")
    folds = written(folds_of(labels, CELL), "folds")
    design = design_rows(labels, derived, folds, CELL, family_columns(residual=False))
    selection, fitted = est.run_heads(design, KEYS, ("logistic",))
    facts = labels.filter("role = 'score'").select(
        *CELL, "raw_target", F.col("horizon").alias("horizon_days"), "date", F.col("value").alias("actual")
    )
    models = _named_models(fitted.filter("role = 'score'")).join(facts, [*CELL, "date"])
    prior = labels.filter("role = 'fit'").groupBy(*CELL).agg(F.avg("value").alias("prediction"))
    priors = facts.join(prior, CELL).select(
        "*",
        F.lit("class_prior").alias("model_name"),
        F.lit("constant").alias("feature_family"),
        F.lit("class_prior").alias("predictor_name"),
        F.lit("baseline").alias("predictor_kind"),
        F.lit(None).cast("double").alias("selected_alpha"),
    )
    both = models.unionByName(priors, allowMissingColumns=True).select(
        "*",
        F.lit("binary_label").alias("target_transform"),
        F.lit("classification").alias("task_type"),
        F.lit("probability").alias("score_space"),
        F.col("target").alias("score_target_name"),
        F.lit(False).alias("inverse_prediction_clipped"),
    )
    return selection, prediction_table(both)


# --- scored results ----------------------------------------------------------------------------------


CORE = [*CELL, "score_space", "predictor_name"]


def _counted(rows: DataFrame) -> DataFrame:
    """Row counts per window, target, space and predictor, and the rest of its identity.

    The identity is grouped by first: least strings of all rows, as aggregates, would sort them.
    """
    own = rows.groupBy(*IDENTITY).agg(
        F.count(F.lit(1)).alias("validation_count"),
        F.count_if("invalid_prediction").alias("invalid_prediction_count"),
        F.count_if("inverse_prediction_clipped").alias("inverse_prediction_clip_count"),
    )
    counts = [c for c in own.columns if c not in IDENTITY]
    return own.groupBy(*CORE).agg(
        *[F.min(c).alias(c) for c in IDENTITY if c not in CORE], *[F.sum(c).alias(c) for c in counts]
    )


def _with_base(results: DataFrame, base: DataFrame, on: list[str], metrics: dict[str, str]) -> DataFrame:
    side = base.select(*on, *[F.col(m).alias(f"_{m}") for m in metrics])
    return results.join(side, on, "left").select(
        *results.columns, *[ratio_or_zero(m, f"_{m}").alias(name) for m, name in metrics.items()]
    )


def regression_results(predictions: DataFrame, ranks: DataFrame | None = None) -> DataFrame:
    """Metrics per window, target, space and predictor with ratios to the right baseline.

    Models are compared with the train mean; incremental models with the same head on hand features.
    ranks: rank correlations by CORE, where they were made before.
    """
    rows = predictions.filter("task_type = 'regression'")
    counted = full_regression_metrics(rows, CORE, ranks=ranks).join(_counted(rows), CORE)
    names = [c for c in counted.columns if c != "spearman_correlation"]
    scored = written(counted.select(*names, "spearman_correlation"), "regression-scores")
    names = {"rmse": "rmse_ratio_vs_baseline", "mae": "mae_ratio_vs_baseline"}
    cell = [*CELL, "score_space"]
    plain = scored.filter(F.col("feature_family") != INCREMENTAL)
    mean = scored.filter("predictor_name = 'train_mean'")
    hand = scored.filter("feature_family = 'hand_market_features'")
    added = scored.filter(F.col("feature_family") == INCREMENTAL)
    return _with_base(plain, mean, cell, names).unionByName(
        _with_base(added, hand, [*cell, "model_name"], names)
    )


def classification_results(predictions: DataFrame) -> DataFrame:
    """Metrics per window, label and predictor with ratios to the class prior."""
    rows = predictions.filter("task_type = 'classification'")
    scored = (
        classification_metrics(rows, CORE)
        .join(roc_auc(rows, CORE), CORE)
        .join(average_precision(rows, CORE, "date"), CORE)
        .join(_counted(rows), CORE)
        .withColumn("classification_label", F.col("target"))
    )
    scored = written(scored, "classification-scores")
    names = {"brier_score": "brier_ratio_vs_baseline", "log_loss": "log_loss_ratio_vs_baseline"}
    return _with_base(scored, scored.filter("predictor_name = 'class_prior'"), CELL, names)
