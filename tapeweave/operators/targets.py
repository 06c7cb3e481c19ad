"""Future outcomes, target transforms and regime labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeweave.functions.expr import (
    EPSILON,
    TRADING_DAYS_PER_YEAR,
    by_symbol,
    forward,
    ratio,
    rolling,
)

# Outcome horizons in valid rows.
TARGET_HORIZONS = (21, 63, 126)


def future_drawdown(horizon: int) -> Column:
    """Worst fall from the running peak over the next rows, NULL without a full window."""
    window = by_symbol().rowsBetween(0, horizon)
    path = F.collect_list("close").over(window)

    def step(state, price):
        peak = F.greatest(state["peak"], price)
        return F.struct(peak.alias("peak"), F.least(state["worst"], price / peak).alias("worst"))

    later = F.struct(F.element_at(path, 1).alias("peak"), F.lit(float("inf")).alias("worst"))
    worst = F.aggregate(F.slice(path, 2, horizon), later, step, lambda s: s["worst"] - 1)
    return F.when(F.size(path) == horizon + 1, worst)


def future_targets(
    features: DataFrame,
    market_symbol: str | None = None,
    horizons: tuple[int, ...] = TARGET_HORIZONS,
) -> DataFrame:
    """Outcomes over the next valid rows of each symbol, or of the market symbol alone.

    The one-day return comes from the full grid, so a window that touches a gap is NULL.
    """
    rows = features.filter("valid_observation")
    if market_symbol is not None:
        rows = rows.filter(F.col("symbol") == market_symbol)
    rows = rows.select("date", "symbol", "close", "return_1d")
    own = by_symbol()
    columns = []
    for h in horizons:
        ahead = F.ln(ratio(F.lead("close", h).over(own), "close"))
        vol = rolling(F.col("return_1d"), forward(h), F.stddev_samp, h) * TRADING_DAYS_PER_YEAR**0.5
        columns += [
            ahead.alias(f"future_return_{h}d"),
            vol.alias(f"future_realized_vol_{h}d"),
            future_drawdown(h).alias(f"future_max_drawdown_{h}d"),
            (ahead / (vol + EPSILON)).alias(f"future_trend_score_{h}d"),
        ]
    return rows.select("date", "symbol", *columns, F.lit(True).alias("uses_future_data"))
