"""Data-quality and leakage checks; each returns the offending rows or their counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names that may not occur among model inputs, and columns that are
# keys, flags or source dates rather than measures.
FORBIDDEN_NAME = r"(^future_|target|label)"
NOT_MEASURES = ("date", "symbol", "uses_future_data", "valid_observation", "max_source_date_used", "available_asof")
NUMERIC_TYPE = r"^(tinyint|smallint|int|bigint|float|double|decimal.*)$"


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count")).filter(F.col("row_count") > 1)


def bad_ohlc(prices: DataFrame) -> DataFrame:
    """Rows whose high or low does not bound the bar, or with a close that is not positive."""
    return prices.filter(
        (F.col("high") < F.greatest("open", "close", "low"))
        | (F.col("low") > F.least("open", "close", "high"))
        | (F.col("close") <= 0)
    )


def leaking_rows(features: DataFrame) -> DataFrame:
    """Rows flagged as using the future, or whose source is later than their date."""
    return features.filter(
        F.coalesce(F.col("uses_future_data"), F.lit(False))
        | F.coalesce(F.col("max_source_date_used") > F.col("date"), F.lit(False))
        | F.coalesce(F.col("available_asof") > F.col("date"), F.lit(False))
    )


def schema_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """Column inventory of several tables as rows; driver-sized by construction."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(t, i, c, kind) for t, df in tables.items() for i, (c, kind) in enumerate(df.dtypes)]
    return spark.createDataFrame(rows, "table_name string, position int, column_name string, column_type string")


def forbidden_columns(schema: DataFrame) -> DataFrame:
    return schema.filter(F.col("column_name").rlike(FORBIDDEN_NAME))


def missing_columns(schema: DataFrame, required: DataFrame) -> DataFrame:
    return required.join(schema, ["table_name", "column_name"], "left_anti")


def undeclared_future_columns(schema: DataFrame, declared: list[str]) -> DataFrame:
    name = F.col("column_name")
    return schema.filter(name.startswith("future_") & ~name.isin(*declared))


def measure_catalog(schema: DataFrame) -> DataFrame:
    """Numeric measures that may be analysed; a name found in two tables is qualified."""
    measures = schema.filter(
        F.col("column_type").rlike(NUMERIC_TYPE) & ~F.col("column_name").isin(*NOT_MEASURES)
    )
    repeated = measures.groupBy("column_name").agg(F.count(F.lit(1)).alias("table_count"))
    return measures.join(repeated, "column_name").select(
        "table_name",
        "column_name",
        F.when(F.col("table_count") > 1, F.concat_ws(".", "table_name", "column_name"))
        .otherwise(F.col("column_name"))
        .alias("feature_name"),
    )


def key_contiguity(df: DataFrame, key: str) -> DataFrame:
    """Whether a dense id runs 0..n-1 without repeats."""
    return df.agg(
        F.min(key).cast("bigint").alias("first_id"),
        F.max(key).cast("bigint").alias("last_id"),
        F.count(F.lit(1)).alias("row_count"),
        F.countDistinct(key).alias("distinct_ids"),
    ).select(
        "*",
        (
            (F.col("first_id") == 0)
            & (F.col("last_id") == F.col("row_count") - 1)
            & (F.col("distinct_ids") == F.col("row_count"))
        ).alias("is_dense"),
    )


def out_of_range(facts: DataFrame, key: str, manifest: DataFrame) -> DataFrame:
    """Facts whose key is not in the manifest."""
    return facts.join(manifest.select(key), key, "left_anti")


def check_counts(checks: dict[str, DataFrame]) -> DataFrame:
    """One row per named check with its number of offending rows."""
    counts = None
    for name, rows in checks.items():
        one = rows.agg(F.count(F.lit(1)).alias("offending_rows")).select(
            F.lit(name).alias("check_name"), "offending_rows"
        )
        counts = one if counts is None else counts.unionByName(one)
    return counts


def require_clean(counts: DataFrame) -> None:
    failures = counts.filter("offending_rows > 0").collect()
    if failures:
        raise ValueError(f"checks failed: {[(r.check_name, r.offending_rows) for r in failures]}")
