"""Cross-sectional market state per date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stock_rows(panel: DataFrame) -> DataFrame:
    return panel.filter((F.col("asset_type") == "stock") & F.col("valid_observation"))


def share_above_zero(column: str):
    """Share of rows above zero; rows without a value stay in the denominator."""
    return F.sum(F.when(F.col(column) > 0, 1).otherwise(0)) / F.count(F.lit(1))


def cross_section(rows: DataFrame) -> DataFrame:
    """Dispersion, breadth and coverage per date in a single aggregate.

    A date holds at most one row per symbol, so the exact quartiles fit one buffer.
    """
    quartiles = F.percentile("return_1d", F.array(F.lit(0.25), F.lit(0.75)))
    measures = [
        F.stddev_samp("return_1d").alias("xs_dispersion_1d"),
        (quartiles[1] - quartiles[0]).alias("xs_iqr_1d"),
        share_above_zero("return_1d").alias("breadth_1d"),
        F.countDistinct("symbol").alias("n_assets"),
    ]
    if "ma_distance_63d" in rows.columns:
        measures.append(share_above_zero("ma_distance_63d").alias("pct_above_ma_63d"))
    return rows.groupBy("date").agg(*measures).select(
        "*",
        F.col("date").alias("max_source_date_used"),
        F.col("date").alias("available_asof"),
        F.lit(False).alias("uses_future_data"),
    )


PROVENANCE = ("max_source_date_used", "available_asof", "uses_future_data")


def date_features(market: DataFrame, macro: DataFrame) -> DataFrame:
    """Market and macro state of the same day with their provenance combined."""
    m = market.alias("m")
    x = macro.alias("x")
    return m.join(x, "date").select(
        "date",
        *[F.col(f"m.{c}") for c in market.columns if c not in ("date", *PROVENANCE)],
        *[F.col(f"x.{c}") for c in macro.columns if c not in ("date", *PROVENANCE)],
        F.greatest("m.max_source_date_used", "x.max_source_date_used").alias("max_source_date_used"),
        F.greatest("m.available_asof", "x.available_asof").alias("available_asof"),
        (F.col("m.uses_future_data") | F.col("x.uses_future_data")).alias("uses_future_data"),
    )
