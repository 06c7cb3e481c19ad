"""Correlation of latent coordinates with panel features and outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeweave.functions.expr import finite, pearson, ratio
from tapeweave.session import spread

PAIR = ["segment", "transform", "coordinate", "feature"]
TOLERANCE = 1e-10
# Correlations equal to this many digits count as tied.
TIE_DIGITS = 9


def market_rows(features: DataFrame, panel: DataFrame, targets: DataFrame, market_symbol: str,
                feature_columns: list[str], panel_columns: list[str], target_columns: list[str]) -> DataFrame:
    """Date features beside the market symbol's valid row and its outcomes."""
    market = panel.filter((F.col("symbol") == market_symbol) & F.col("valid_observation")).select("date", *panel_columns)
    outcomes = targets.filter(F.col("symbol") == market_symbol).select("date", *target_columns)
    return features.select("date", *feature_columns).join(market, "date", "left").join(outcomes, "date", "left")


def with_time_controls(rows: DataFrame) -> DataFrame:
    """Calendar days since the first date and row number; one row per date."""
    ordered = Window.orderBy("date")
    first = rows.agg(F.min("date")).scalar()
    return rows.select(
        "*",
        F.datediff("date", first).cast("double").alias("elapsed_calendar_days"),
        (F.row_number().over(ordered) - 1).cast("double").alias("elapsed_trading_rows"),
    )


def segment_names() -> Column:
    """Segments a row belongs to: all, its split and its named window."""
    window = F.coalesce(F.col("validation_window_name"), F.lit(""))
    return F.array_compact(
        F.array(
            F.lit("all"),
            F.when(F.col("split") == "train", "train"),
            F.when(F.col("split") == "validation", "validation"),
            F.when(window != "", F.concat(F.lit("validation_window:"), window)),
        )
    )


def with_first_differences(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row set per transform: levels and row-to-row differences over all rows."""
    ordered = Window.orderBy("date")
    others = [c for c in rows.columns if c not in columns]
    levels = rows.select(F.lit("level").alias("transform"), *others, *columns)
    differences = rows.select(
        F.lit("first_difference").alias("transform"),
        *others,
        *[(F.col(c) - F.lag(c).over(ordered)).alias(c) for c in columns],
    )
    return levels.unionByName(differences)


def long_pairs(rows: DataFrame, coordinates: list[str], features: list[str]) -> DataFrame:
    """One row per segment, transform, coordinate, feature and date with a finite value pair."""
    prepared = with_first_differences(rows, [*coordinates, *features])

    def cells(names: list[str], name: str, value: str):
        return F.explode(F.array(*[F.struct(F.lit(c).alias(name), F.col(c).alias(value)) for c in names]))

    side = prepared.select(
        "transform",
        "date",
        segment_names().alias("segments"),
        *features,
        cells(coordinates, "coordinate", "x").alias("_c"),
    )
    both = side.select("transform", "date", "segments", "_c.*", cells(features, "feature", "y").alias("_f"))
    finite_rows = both.select("transform", "date", "segments", "coordinate", "x", "_f.*").filter(finite("x") & finite("y"))
    return finite_rows.select(
        F.explode("segments").alias("segment"), "transform", "coordinate", "feature", "date", "x", "y"
    )


def detrended(pairs: DataFrame) -> DataFrame:
    """Level pairs less their linear trend over evenly spaced time; needs three pairs, else unchanged.

    A pair group holds one row per date.
    """
    # Dealt by what varies: the transform is one constant, which the windows leave out of their keys.
    dealt = spread(pairs.filter("transform = 'level'"), *[k for k in PAIR if k != "transform"])
    levels = dealt.withColumn("transform", F.lit("linear_time_detrended"))
    group = Window.partitionBy(*PAIR)
    timed = levels.select(
        "*", F.row_number().over(group.orderBy("date")).cast("double").alias("t"), F.count(F.lit(1)).over(group).alias("n")
    )

    def residual(c: str):
        slope = ratio(F.covar_pop(c, "t").over(group), F.var_pop("t").over(group))
        return F.col(c) - F.avg(c).over(group) - slope * (F.col("t") - F.avg("t").over(group))

    fitted = timed.select(*PAIR, "date", "n", "x", "y", residual("x").alias("rx"), residual("y").alias("ry"))

    def kept(c: str):
        still = F.stddev_pop(f"r{c}").over(group) <= F.stddev_pop(c).over(group) * TOLERANCE
        return F.when(F.col("n") < 3, F.col(c)).when(still, F.lit(0.0)).otherwise(F.col(f"r{c}")).alias(c)

    return fitted.select(*PAIR, "date", kept("x"), kept("y"))


def correlations(pairs: DataFrame) -> DataFrame:
    """Count, Pearson, Spearman and r² of each pair group; NULL below three pairs or for a constant side.

    A pair group has one row per calendar day at most, so its ranks come from one window.
    Values that differ by rounding noise alone (below TIE_DIGITS digits) share a rank.
    """

    def rank(c: str):
        level = F.round(c, TIE_DIGITS)
        ties = F.count(F.lit(1)).over(Window.partitionBy(*PAIR, level))
        return F.rank().over(Window.partitionBy(*PAIR).orderBy(level)) + (ties - 1) / 2

    ranked = spread(pairs, *PAIR).select("*", rank("x").alias("rx"), rank("y").alias("ry"))
    usable = (F.count(F.lit(1)) >= 3) & (F.stddev_samp("x") > 0) & (F.stddev_samp("y") > 0)
    level = F.when(usable, pearson("x", "y"))
    return ranked.groupBy(*PAIR).agg(
        F.count(F.lit(1)).alias("observation_count"),
        level.alias("pearson_correlation"),
        F.when(usable, pearson("rx", "ry")).alias("spearman_correlation"),
        (level * level).alias("pearson_r_squared"),
    )


def strongest(table: DataFrame, count: int = 8) -> DataFrame:
    """The strongest features of each coordinate and transform over all rows, by absolute Pearson."""
    known = table.filter((F.col("segment") == "all") & finite("pearson_correlation"))
    order = Window.partitionBy("coordinate", "transform").orderBy(
        F.desc(F.round(F.abs("pearson_correlation"), TIE_DIGITS)), "feature"
    )
    return known.select("*", F.row_number().over(order).alias("place")).filter(F.col("place") <= count)
