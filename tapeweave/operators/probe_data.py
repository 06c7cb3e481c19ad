"""Probe targets, hand-made baseline features and the probe dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeweave.functions.expr import EPSILON, finite
from tapeweave.operators.quality import duplicate_keys

PREFIX = "baseline__"
# How trailing feature names read as baselines.
TRAILING_NAMES = {"return_": "trailing_return_", "realized_vol_": "trailing_realized_vol_", "drawdown_": "trailing_max_drawdown_"}


def baseline_name(feature: str) -> str:
    for start, renamed in TRAILING_NAMES.items():
        if feature.startswith(start):
            return PREFIX + renamed + feature.removeprefix(start)
    return PREFIX + feature


def baseline_features(
    target_dates: DataFrame,
    features: DataFrame,
    panel: DataFrame,
    market_symbol: str,
    feature_columns: list[str],
    ticker_columns: list[str],
    trend_horizons: tuple[int, ...],
) -> DataFrame:
    """Past-only features of each target date: market state and the market symbol's own trail.

    The symbol and validity conditions belong to the join, so they are applied to the
    panel before it and a date without a valid row keeps NULLs.
    """
    market = panel.filter((F.col("symbol") == market_symbol) & F.col("valid_observation")).select(
        "date", *[F.col(c).alias(baseline_name(c)) for c in ticker_columns]
    )
    state = features.select("date", *[F.col(c).alias(baseline_name(c)) for c in feature_columns])
    joined = target_dates.select("date").distinct().join(state, "date", "left").join(market, "date", "left")
    trends = [
        (F.col(f"{PREFIX}trailing_return_{h}d") / (F.col(f"{PREFIX}trailing_realized_vol_{h}d") + EPSILON)).alias(
            f"{PREFIX}current_trend_score_{h}d"
        )
        for h in trend_horizons
        if f"return_{h}d" in ticker_columns and f"realized_vol_{h}d" in ticker_columns
    ]
    return joined.select("*", *trends)


def target_columns(targets: DataFrame) -> list[str]:
    names = sorted(c for c in targets.columns if c.startswith("future_"))
    if not names:
        raise ValueError("the target table has no future_ columns")
    return names


def exported_targets(targets: DataFrame) -> DataFrame:
    """Targets ready to publish: date and sorted future columns, at least one row."""
    names = target_columns(targets)
    if targets.isEmpty():
        raise ValueError("the target table is empty")
    return targets.select("date", *names)


def require_one_row_per_date(df: DataFrame, what: str) -> DataFrame:
    if not duplicate_keys(df, ["date"]).isEmpty():
        raise ValueError(f"{what} must hold one row per date")
    return df


def forbidden_columns(columns: list[str], starts: tuple[str, ...]) -> list[str]:
    return [c for c in columns if c.startswith(starts)]


def assemble(embeddings: DataFrame, targets: DataFrame, baselines: DataFrame, dimension: int | None = None) -> DataFrame:
    """Embeddings with their date's targets and baselines and a mask per target."""
    bad = forbidden_columns(embeddings.columns, ("future_",)) + forbidden_columns(baselines.columns, ("future_", "z_"))
    if bad:
        raise ValueError(f"forbidden input columns: {bad}")
    coordinates = [c for c in embeddings.columns if c.startswith("z_")]
    if not coordinates or (dimension is not None and len(coordinates) != dimension):
        raise ValueError(f"expected {dimension or 'some'} z columns, found {len(coordinates)}")
    for df, what in ((embeddings, "embeddings"), (targets, "targets"), (baselines, "baselines")):
        require_one_row_per_date(df, what)
    names = target_columns(targets)
    joined = embeddings.join(targets.select("date", *names), "date", "left").join(baselines, "date", "left")
    return joined.select("*", *[finite(n).alias(f"target_available__{n}") for n in names])


def window_table(rows: DataFrame) -> DataFrame:
    """Bounds, row count and exclusive train cutoff of each named validation window."""
    named = rows.filter((F.col("split") == "validation") & (F.coalesce("validation_window_name", F.lit("")) != ""))
    return named.groupBy("validation_window_name").agg(
        F.min("date").alias("validation_start"),
        F.max("date").alias("validation_end"),
        F.min("date").alias("train_cutoff_exclusive"),
        F.count(F.lit(1)).alias("validation_row_count"),
    )


def reloaded(rows: DataFrame, declared: list[str]) -> DataFrame:
    """A stored probe dataset, if it still keeps its contract."""
    undeclared = sorted(set(forbidden_columns(rows.columns, ("future_",))) - set(declared))
    if undeclared:
        raise ValueError(f"undeclared future columns: {undeclared}")
    return require_one_row_per_date(rows, "the probe dataset")


# --- target transforms and labels -----------------------------------------------------------

# Transforms per target family.
FAMILY_TRANSFORMS = {
    "future_realized_vol": ["log_realized_vol"],
    "future_max_drawdown": ["drawdown_magnitude", "log_drawdown_magnitude"],
}


def transform_specs(targets: list[str]) -> list[tuple[str, str, str]]:
    """(raw target, target, transform) of every variant; the raw one always comes first."""
    specs = []
    for raw in targets:
        specs.append((raw, raw, "raw"))
        for family, transforms in FAMILY_TRANSFORMS.items():
            if family in raw:
                specs += [(raw, f"{raw}__{name}", name) for name in transforms]
    return specs


def transform_value(value: Column, transform: Column | str) -> Column:
    kind = F.lit(transform) if isinstance(transform, str) else transform
    magnitude = F.when(value.isNotNull(), F.greatest(-value, F.lit(0.0)))
    floored = F.when(value.isNotNull(), F.greatest(value, F.lit(EPSILON)))
    return (
        F.when(kind == "raw", value)
        .when(kind == "log_realized_vol", F.ln(floored))
        .when(kind == "drawdown_magnitude", magnitude)
        .when(kind == "log_drawdown_magnitude", F.log1p(magnitude))
    )


def inverse_value(predicted: Column, transform: Column | str) -> tuple[Column, Column]:
    """Prediction in raw units and whether it was clipped to the target's support."""
    kind = F.lit(transform) if isinstance(transform, str) else transform
    floored = F.when(predicted.isNotNull(), F.greatest(predicted, F.lit(0.0)))
    raw = (
        F.when(kind == "raw", predicted)
        .when(kind == "log_realized_vol", F.exp(predicted))
        .when(kind == "drawdown_magnitude", -floored)
        .when(kind == "log_drawdown_magnitude", -F.expm1(floored))
    )
    clipped = kind.isin("drawdown_magnitude", "log_drawdown_magnitude") & finite(predicted) & (predicted < 0)
    return raw, F.coalesce(clipped, F.lit(False))


def horizon_of(target: Column) -> Column:
    """Horizon in the target's name, NULL if it has none."""
    digits = F.regexp_extract(target, r"_(\d+)d(?:__.*)?$", 1)
    return F.when(digits != "", digits.cast("int"))


def family_of(target: Column) -> Column:
    return (
        F.when(target.contains("future_realized_vol"), "future_realized_vol")
        .when(target.contains("future_max_drawdown"), "future_max_drawdown")
        .when(target.contains("future_return"), "future_return")
        .when(target.contains("future_trend_score"), "future_trend_score")
        .otherwise("unknown")
    )


# The trailing baseline that stands in for each target family.
PROXIES = {
    "future_return": "trailing_return",
    "future_realized_vol": "trailing_realized_vol",
    "future_max_drawdown": "trailing_max_drawdown",
    "future_trend_score": "current_trend_score",
}


def proxy_column(target: Column) -> Column:
    """Name of the trailing column that stands in for a target."""
    stem = None
    for family, proxy in PROXIES.items():
        hit = family_of(target) == family
        stem = F.when(hit, proxy) if stem is None else stem.when(hit, proxy)
    return F.concat(F.lit(PREFIX), stem, F.lit("_"), horizon_of(target).cast("string"), F.lit("d"))


def target_rows(rows: DataFrame, targets: list[str], keep: list[str]) -> DataFrame:
    """One row per date and target variant with raw and transformed value and trailing proxy."""
    specs = F.array(
        *[
            F.struct(
                F.lit(raw).alias("raw_target"),
                F.lit(target).alias("target"),
                F.lit(transform).alias("target_transform"),
                F.col(raw).alias("raw_value"),
                _proxy_value(rows, raw).alias("raw_proxy"),
            )
            for raw, target, transform in transform_specs(targets)
        ]
    )
    long = rows.select(*keep, F.explode(specs).alias("_t")).select(*keep, "_t.*")
    value = transform_value(F.col("raw_value"), F.col("target_transform"))
    return long.select(
        "*", horizon_of(F.col("raw_target")).alias("horizon"), value.alias("value")
    ).filter(finite("raw_value") & finite("value"))


def _proxy_value(rows: DataFrame, raw: str) -> Column:
    for family, proxy in PROXIES.items():
        if family in raw:
            name = f"{PREFIX}{proxy}_{raw.rsplit('_', 1)[1]}"
            return F.col(name) if name in rows.columns else F.lit(None).cast("double")
    return F.lit(None).cast("double")


LABEL_SHARE = 0.8


def label_thresholds(train: DataFrame, keys: list[str]) -> DataFrame:
    """Regime thresholds per key and raw target from train rows only; needs three of them.

    A key's train rows are one per date, so the exact percentile fits one buffer.
    """
    value = F.col("raw_value")
    family = family_of(F.col("raw_target"))
    stats = train.filter(finite("raw_value")).groupBy(*keys, "raw_target").agg(
        F.count(F.lit(1)).alias("_n"),
        F.percentile(value, LABEL_SHARE).alias("_high"),
        F.percentile(F.greatest(-value, F.lit(0.0)), LABEL_SHARE).alias("_fall"),
        F.percentile(F.abs(value), 1.0 - LABEL_SHARE).alias("_weak"),
    ).filter("_n >= 3")

    def label(name: str, threshold: Column) -> Column:
        return F.struct(F.lit(name).alias("name"), threshold.alias("threshold"))

    zero = F.lit(0.0)
    labels = (
        F.when(family == "future_realized_vol", F.array(label("high_vol", F.col("_high"))))
        .when(family == "future_max_drawdown", F.array(label("severe_drawdown", F.col("_fall"))))
        .when(family == "future_return", F.array(label("positive_return", zero)))
        .when(
            family == "future_trend_score",
            F.array(label("strong_trend", F.col("_high")), label("weak_or_chop", F.col("_weak"))),
        )
    )
    suffix = F.coalesce(F.concat(F.lit("_"), horizon_of(F.col("raw_target")).cast("string"), F.lit("d")), F.lit(""))
    return stats.select(*keys, "raw_target", suffix.alias("_suffix"), F.explode(labels).alias("_l")).select(
        *keys,
        "raw_target",
        F.col("_l.name").alias("label_kind"),
        F.concat("_l.name", "_suffix").alias("classification_label"),
        F.col("_l.threshold").alias("threshold"),
    )


def label_value(value: Column, kind: Column, threshold: Column) -> Column:
    """Binary label of a raw target value."""
    hit = (
        F.when(kind.isin("high_vol", "strong_trend"), value >= threshold)
        .when(kind == "severe_drawdown", F.greatest(-value, F.lit(0.0)) >= threshold)
        .when(kind == "positive_return", value > threshold)
        .when(kind == "weak_or_chop", F.abs(value) <= threshold)
    )
    return hit.cast("int").cast("double")
