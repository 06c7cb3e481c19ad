"""Macro series as of the day they became available."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeweave.functions.expr import add_business_days, finite_or_null

# Change windows in spine rows and the derived spreads.
CHANGE_WINDOWS = (1, 5, 21, 63)
SPREADS = {
    "yield_curve_10y_2y": ("treasury_10y", "treasury_2y"),
    "yield_curve_10y_3m": ("treasury_10y", "treasury_3m"),
    "yield_curve_30y_10y": ("treasury_30y", "treasury_10y"),
    "hy_minus_corporate_oas": ("high_yield_oas", "corporate_oas"),
}


def with_availability(observations: DataFrame, definitions: DataFrame) -> DataFrame:
    """Attach names, availability dates and revision flags of the configured series.

    The definitions are driver-side configuration, one row per series.
    """
    pit = F.coalesce(F.col("point_in_time_available"), F.lit(False))
    defined = definitions if "point_in_time_available" in definitions.columns else definitions.withColumn(
        "point_in_time_available", F.lit(False)
    )
    return observations.join(F.broadcast(defined), "series_id").select(
        *observations.columns,
        "series_name",
        add_business_days("date", "lag_business_days").alias("asof_date"),
        pit.alias("point_in_time_available"),
        F.coalesce(F.col("revised_data_flag"), ~pit).alias("revised_data_flag"),
    )


def select_series(definitions: DataFrame, enabled_groups: tuple[str, ...]) -> DataFrame:
    return definitions.filter(F.col("series_group").isin(*enabled_groups))


def latest_per_availability(observations: DataFrame, series: str = "series_name") -> DataFrame:
    """One row per series and availability date: the latest observation date wins."""
    known = observations.select(
        series, "date", "asof_date", finite_or_null("value").alias("value")
    ).filter(F.col("value").isNotNull() & F.col("asof_date").isNotNull())
    return known.groupBy(series, "asof_date").agg(
        F.max("date").alias("observation_date"),
        F.max_by("value", "date").alias("value"),
    )


def warmup_spine(calendar: DataFrame, rows: int) -> DataFrame:
    """Calendar days plus the given number of business days before the first of them."""
    first = calendar.agg(F.min("date").alias("first_day"))
    # Nine calendar days hold at least five business days, whatever the weekday.
    earlier = (
        first.select(
            "first_day",
            F.explode(
                F.sequence(F.date_sub("first_day", rows // 5 * 7 + 9), F.date_sub("first_day", 1))
            ).alias("date"),
        )
        .filter(F.weekday("date") < 5)
        .select("date", F.row_number().over(Window.orderBy(F.desc("date"))).alias("back"))
        .filter(F.col("back") <= rows)
    )
    return calendar.select("date", F.lit(True).alias("requested")).unionByName(
        earlier.select("date", F.lit(False).alias("requested"))
    )


def asof_join(
    spine: DataFrame,
    observations: DataFrame,
    key: str,
    spine_date: str,
    available: str,
    values: list[str],
) -> DataFrame:
    """For each spine row the latest observation of its key available on or before that day.

    Both sides go through one exchange on the key: observations sort before spine rows
    of the same day and the last one seen is carried forward. A key's rows are bounded
    by days (one per availability date and one per spine date).
    """
    extra = [c for c in spine.columns if c not in (key, spine_date)]
    carried = F.struct(*[F.col(v) for v in values], F.col(available)).alias("_seen")
    left = spine.select(
        key, F.col(spine_date).alias("_at"), F.lit(1).alias("_side"), *extra
    )
    right = observations.select(
        key, F.col(available).alias("_at"), F.lit(0).alias("_side"), carried
    )
    order = Window.partitionBy(key).orderBy("_at", "_side").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return (
        left.unionByName(right, allowMissingColumns=True)
        .select("*", F.last("_seen", ignorenulls=True).over(order).alias("_last"))
        .filter(F.col("_side") == 1)
        .select(
            key,
            F.col("_at").alias(spine_date),
            *extra,
            *[F.col(f"_last.{v}").alias(v) for v in values],
            F.col(f"_last.{available}").alias(available),
        )
    )


def macro_levels(
    observations: DataFrame, calendar: DataFrame, series_names: list[str], windows=CHANGE_WINDOWS
) -> DataFrame:
    """Long form: level, source dates and changes per series and spine day."""
    spine = warmup_spine(calendar, max(windows, default=0))
    names = F.array(*[F.lit(n) for n in series_names])
    per_series = spine.select(F.explode(names).alias("series_name"), "date", "requested")
    joined = asof_join(
        per_series,
        latest_per_availability(observations),
        "series_name",
        "date",
        "asof_date",
        ["value", "observation_date"],
    )
    own = Window.partitionBy("series_name").orderBy("date")
    return joined.select(
        "series_name",
        "date",
        "requested",
        F.col("value").alias("level"),
        "observation_date",
        "asof_date",
        *[(F.col("value") - F.lag("value", k).over(own)).alias(f"change_{k}d") for k in windows],
    )


def macro_features(
    observations: DataFrame, calendar: DataFrame, series_names: list[str], windows=CHANGE_WINDOWS
) -> DataFrame:
    """One row per calendar day with levels, changes and spreads of every series."""
    long = macro_levels(observations, calendar, series_names, windows).filter("requested")
    measures = [("level", "level"), *[(f"change_{k}d", f"change_{k}d") for k in windows]]
    wide = long.groupBy("date").agg(
        *[
            F.max(F.when(F.col("series_name") == name, F.col(source))).alias(f"{name}_{suffix}")
            for name in series_names
            for source, suffix in measures
        ],
        F.max("observation_date").alias("max_source_date_used"),
        F.max("asof_date").alias("available_asof"),
    )
    spreads = [
        (F.col(f"{a}_level") - F.col(f"{b}_level")).alias(name)
        for name, (a, b) in SPREADS.items()
        if a in series_names and b in series_names
    ]
    provenance = ("max_source_date_used", "available_asof")
    return wide.select(
        *[c for c in wide.columns if c not in provenance],
        *spreads,
        *provenance,
        F.lit(False).alias("uses_future_data"),
    )
