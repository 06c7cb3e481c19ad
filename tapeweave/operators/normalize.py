"""Train-only robust normalization and sparse masked facts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeweave.functions.expr import any_of, finite
from tapeweave.functions.ordered import ROWS_PER_BUCKET, exact_percentiles


@dataclass(frozen=True)
class Feature:
    name: str
    transform: str = "none"


@dataclass(frozen=True)
class RobustScale:
    lower: float
    center: float
    scale: float
    upper: float


def is_valid(feature: Feature) -> Column:
    """Known, finite and inside the domain of its transform."""
    c = F.col(feature.name).cast("double")
    if feature.transform == "log":
        return finite(c) & F.coalesce(c > 0, F.lit(False))
    if feature.transform == "log1p":
        return finite(c) & F.coalesce(c > -1, F.lit(False))
    return finite(c)


def transformed(feature: Feature) -> Column:
    """Transformed value, NULL where the input is not valid."""
    c = F.col(feature.name).cast("double")
    value = {"none": c, "log": F.ln(c), "log1p": F.log1p(c)}[feature.transform]
    return F.when(is_valid(feature), value)


def long_values(rows: DataFrame, features: list[Feature]) -> DataFrame:
    """One row per feature and valid value."""
    pairs = F.array(
        *[F.struct(F.lit(f.name).alias("feature_name"), transformed(f).alias("value")) for f in features]
    )
    return rows.select(F.explode(pairs).alias("pair")).select("pair.*").filter("value IS NOT NULL")


def fit(
    rows: DataFrame,
    features: list[Feature],
    winsorize: tuple[float, float],
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Count, winsor bounds, median and interquartile scale of every feature from one scan."""
    shares = [winsorize[0], 0.25, 0.5, 0.75, winsorize[1]]
    stats = exact_percentiles(long_values(rows, features), ["feature_name"], "value", shares, rows_per_bucket)
    q = [F.element_at("percentiles", i + 1) for i in range(5)]
    spread = q[3] - q[1]
    return stats.select(
        "feature_name",
        F.col("value_count").alias("fit_count"),
        q[0].alias("lower_bound"),
        q[2].alias("center"),
        F.when(finite(spread) & (spread > 0), spread).otherwise(F.lit(1.0)).alias("scale"),
        q[4].alias("upper_bound"),
    )


def collect_scales(stats: DataFrame, features: list[Feature]) -> dict[str, RobustScale]:
    """The fitted statistics on the driver: one row per configured feature."""
    scales = {
        r.feature_name: RobustScale(r.lower_bound, r.center, r.scale, r.upper_bound) for r in stats.collect()
    }
    missing = [f.name for f in features if f.name not in scales]
    if missing:
        raise ValueError(f"no finite train facts for: {', '.join(missing)}")
    return scales


def normalized(feature: Feature, scale: RobustScale) -> Column:
    """Clipped, centered and scaled value as float; 0 where the input is not valid."""
    clipped = F.least(F.greatest(transformed(feature), F.lit(scale.lower)), F.lit(scale.upper))
    scaled = (clipped - F.lit(scale.center)) / F.lit(scale.scale)
    # greatest and least skip NULL, so validity is tested on its own.
    return F.when(is_valid(feature), scaled).otherwise(F.lit(0.0)).cast("float")


def value_mask_pairs(features: list[Feature], scales: dict[str, RobustScale]) -> list[Column]:
    columns: list[Column] = []
    for f in features:
        columns += [normalized(f, scales[f.name]).alias(f.name), is_valid(f).alias(f"{f.name}__valid")]
    return columns


def split_of_date() -> Column:
    return F.when(F.col("train_fact_allowed"), "train").otherwise("validation")


def asset_train_rows(panel: DataFrame, dates: DataFrame, assets: DataFrame) -> DataFrame:
    """Valid rows of trainable assets on train-allowed dates."""
    return (
        panel.filter("valid_observation")
        .join(dates.filter("train_fact_allowed").select("date"), "date", "left_semi")
        .join(assets.filter("trainable").select("symbol"), "symbol", "left_semi")
    )


def date_train_rows(features: DataFrame, dates: DataFrame) -> DataFrame:
    return features.join(dates.filter("train_fact_allowed").select("date"), "date", "left_semi")


def asset_facts(
    panel: DataFrame, dates: DataFrame, assets: DataFrame, features: list[Feature], scales: dict[str, RobustScale]
) -> DataFrame:
    """Valid rows of trainable assets with value and mask per feature, marked by split."""
    wanted = ["date", "symbol", *[f.name for f in features]]
    return (
        panel.filter("valid_observation")
        .select(*wanted)
        .join(dates.select("date", "date_idx", "train_fact_allowed"), "date")
        .join(assets.filter("trainable").select("symbol", "asset_id"), "symbol")
        .select(
            split_of_date().alias("split"),
            "date",
            "date_idx",
            "asset_id",
            F.lit(True).alias("valid_asset"),
            *value_mask_pairs(features, scales),
        )
    )


def date_facts(
    features_table: DataFrame, dates: DataFrame, features: list[Feature], scales: dict[str, RobustScale]
) -> DataFrame:
    """Date rows with value and mask per feature; a date is valid when any of its masks is."""
    return (
        features_table.select("date", *[f.name for f in features])
        .join(dates.select("date", "date_idx", "train_fact_allowed"), "date")
        .select(
            split_of_date().alias("split"),
            "date",
            "date_idx",
            any_of([is_valid(f) for f in features]).alias("valid_date"),
            *value_mask_pairs(features, scales),
        )
    )


def write_facts(facts: DataFrame, path: str) -> None:
    """One write per group, split by folder, sorted by date inside files."""
    keys = [c for c in ("date_idx", "asset_id") if c in facts.columns]
    (
        facts.repartitionByRange("split", *keys)
        .sortWithinPartitions("split", *keys)
        .write.option("compression", "zstd")
        .partitionBy("split")
        .parquet(path)
    )


# --- post-write contract ---------------------------------------------------------------


def manifest_contract(dates: DataFrame) -> DataFrame:
    """Whether permissions are disjoint and complete and protections exclusive."""
    flags = ["validation_sample", "protected_input_lookback", "protected_forward_target"]
    protections = sum((F.col(f).cast("int") for f in flags[1:]), F.col(flags[0]).cast("int"))
    return dates.agg(
        F.bool_and(~(F.col("train_fact_allowed") & F.col("validation_fact_allowed"))).alias("permissions_disjoint"),
        F.bool_and(protections <= 1).alias("protections_exclusive"),
        F.bool_and(F.col("protected_holdout") == (protections > 0)).alias("holdout_is_union"),
        F.bool_and(F.col("protected_holdout") == ~F.col("train_fact_allowed")).alias("holdout_is_not_train"),
    )


def shared_split_dates(facts: DataFrame) -> DataFrame:
    """Dates present in both splits."""
    train = facts.filter("split = 'train'").select("date").distinct()
    validation = facts.filter("split = 'validation'").select("date").distinct()
    return train.intersect(validation)


def quality_report(dates: DataFrame, assets: DataFrame, facts: dict[str, DataFrame]) -> DataFrame:
    """Row counts of every fact group and split next to date and asset class counts."""

    def rows(kind: str, df: DataFrame, name) -> DataFrame:
        return df.groupBy(name.alias("item")).agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(kind).alias("section"), "item", "row_count"
        )

    report = rows("asset_type", assets.filter("trainable"), F.col("asset_type"))
    report = report.unionByName(rows("trainable", assets, F.col("trainable").cast("string")))
    for flag in ("validation_sample", "protected_input_lookback", "protected_forward_target", "train_fact_allowed"):
        one = dates.agg(F.count_if(F.col(flag)).alias("row_count"))
        report = report.unionByName(one.select(F.lit("date_flag").alias("section"), F.lit(flag).alias("item"), "row_count"))
    for group, df in facts.items():
        report = report.unionByName(rows("facts", df, F.concat(F.lit(f"{group}."), F.col("split"))))
    return report
