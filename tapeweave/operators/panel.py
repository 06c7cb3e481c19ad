"""Complete date-by-symbol panel and past-only features of each instrument."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeweave.functions.expr import (
    EPSILON,
    TRADING_DAYS_PER_YEAR,
    by_symbol,
    ratio,
    rolling,
    trailing,
)
from tapeweave.session import spread

# Feature horizons in grid rows.
HORIZONS = (5, 21, 63, 126)
DESCRIPTIVE = ("source", "source_symbol", "asset_type", "exchange", "currency")


def minimum_periods(horizon: int) -> int:
    return max(5, horizon // 2)


def complete_grid(calendar: DataFrame, symbols: DataFrame) -> DataFrame:
    """Every trading day for every symbol.

    The calendar has one row per day at most, so it travels as one array; each symbol
    explodes it where it stands, which needs no product join. The symbols are few bytes
    before they unfold, so they are spread over all partitions first; the windows by symbol
    that follow find their rows in place.
    """
    days = calendar.agg(F.array_sort(F.collect_set("date")).alias("days"))
    return spread(symbols.select("symbol"), "symbol").distinct().select(
        "symbol", F.explode(days.scalar()).alias("date")
    )


def align(prices: DataFrame, calendar: DataFrame, manifest: DataFrame) -> DataFrame:
    """Prices on the complete grid with coverage bounds, status and backfilled descriptions."""
    grid = complete_grid(calendar, manifest)
    bounds = manifest.select(
        "symbol",
        "first_available_date",
        "last_available_date",
        "survivorship_status",
        *[F.col(c).alias(f"manifest_{c}") for c in DESCRIPTIVE if c in manifest.columns],
    )
    joined = grid.join(prices, ["date", "symbol"], "left").join(bounds, "symbol", "left")
    after_last = F.col("date") > F.col("last_available_date")
    status = (
        F.when(after_last & (F.col("survivorship_status") == "confirmed_delisted"), "confirmed_delisted")
        .when(after_last, "after_last_observed")
        .when(F.col("date") < F.col("first_available_date"), "not_listed_yet")
        .when(F.col("close").isNull(), "missing_expected")
        .otherwise("ok")
    )
    kept = [c for c in prices.columns if c not in ("date", "symbol")]
    return joined.select(
        "date",
        "symbol",
        *[
            F.coalesce(F.col(c), F.col(f"manifest_{c}")).alias(c)
            if f"manifest_{c}" in joined.columns
            else F.col(c)
            for c in kept
        ],
        "first_available_date",
        "last_available_date",
        "survivorship_status",
        status.alias("observation_status"),
        (status == "ok").alias("valid_observation"),
    )


def status_counts(panel: DataFrame) -> DataFrame:
    return panel.groupBy("observation_status").agg(F.count(F.lit(1)).alias("row_count"))


def asset_features(panel: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """Returns, volatility, drawdown, trend and path features over each symbol's own past.

    All frames share one partitioning and one order, so the block costs one exchange. Long
    frames cost far more than the bytes they read, hence the spread over all partitions.
    """
    own = by_symbol()
    log_close = F.ln("close")
    base = spread(panel, "symbol").select(
        "*",
        log_close.alias("_log_close"),
        (log_close - F.lag(log_close, 1).over(own)).alias("return_1d"),
        (F.col("close") * F.col("volume")).alias("dollar_volume"),
        *[
            (log_close - F.lag(log_close, h).over(own)).alias(f"return_{h}d")
            for h in horizons
        ],
    ).drop("_log_close")

    one_day = F.col("return_1d")
    close = F.col("close")
    columns = []
    for h in horizons:
        frame, least = trailing(h), minimum_periods(h)
        path = rolling(F.abs(one_day), frame, F.sum, least)
        columns += [
            (rolling(one_day, frame, F.stddev_samp, least) * TRADING_DAYS_PER_YEAR**0.5).alias(
                f"realized_vol_{h}d"
            ),
            (ratio(close, rolling(close, frame, F.max, least)) - 1).alias(f"drawdown_{h}d"),
            (ratio(close, rolling(close, frame, F.avg, least)) - 1).alias(f"ma_distance_{h}d"),
            (F.abs(F.col(f"return_{h}d")) / (path + EPSILON)).alias(f"path_efficiency_{h}d"),
        ]
    return base.select(
        "*",
        *columns,
        F.col("date").alias("max_source_date_used"),
        F.col("date").alias("available_asof"),
        F.lit(False).alias("uses_future_data"),
    )
