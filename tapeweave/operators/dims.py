"""Identity and dimension tables: tickers, symbol manifest, trading calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeweave.functions.expr import col


def feed_symbol(ticker: Column | str) -> Column:
    """Ticker as the price feed spells it: trimmed, lower case, dots as dashes, '.us' suffix."""
    return F.concat(F.regexp_replace(F.lower(F.trim(col(ticker))), r"\.", "-"), F.lit(".us"))


def canonical_stock_id(ticker: Column | str) -> Column:
    return F.concat(F.lit("STOCK_US_"), F.regexp_replace(F.trim(col(ticker)), r"\.", "_"))


def stock_symbols(universe: DataFrame, ticker: str = "symbol", name: str = "name") -> DataFrame:
    """Requested stock instruments from a universe membership list."""
    return universe.select(
        canonical_stock_id(ticker).alias("symbol"),
        feed_symbol(ticker).alias("source_symbol"),
        F.col(name).alias("name"),
        F.lit("stock").alias("asset_type"),
        F.lit("USD").alias("currency"),
    )


def stack_metadata(*frames: DataFrame) -> DataFrame:
    """Union of metadata frames; a column one side lacks is NULL there."""
    stacked = frames[0]
    for frame in frames[1:]:
        stacked = stacked.unionByName(frame, allowMissingColumns=True)
    return stacked


def symbol_manifest(prices: DataFrame, metadata: DataFrame) -> DataFrame:
    """Coverage per instrument as observed in the prices, with cautious defaults.

    An unknown survivorship or membership status is never promoted to a verified one.
    """
    keys = ["symbol", "source", "source_symbol"]
    coverage = prices.groupBy(*keys).agg(
        F.min("date").alias("first_available_date"),
        F.max("date").alias("last_available_date"),
        F.count(F.lit(1)).alias("n_rows"),
    )
    described = coverage.join(metadata, keys, "left")
    defaults = {"survivorship_status": F.lit("unknown"), "point_in_time_valid": F.lit(False)}
    plain = [c for c in described.columns if c not in defaults]
    return described.select(
        *plain,
        instrument_id("source", "source_symbol", "first_available_date").alias("instrument_id"),
        *[
            (F.coalesce(F.col(name), value) if name in described.columns else value).alias(name)
            for name, value in defaults.items()
        ],
    )


def instrument_id(source: Column | str, source_symbol: Column | str, first_date: Column | str) -> Column:
    """Stable id: the first 16 hex digits of SHA-1 over source|symbol|first date."""
    day = F.coalesce(col(first_date).cast("string"), F.lit("unknown"))
    text = F.concat_ws("|", col(source), col(source_symbol), day)
    return F.substring(F.sha1(text), 1, 16)


def trading_days(prices: DataFrame, reference_symbol: str | None = None) -> DataFrame:
    """Days with a known close, for one reference symbol or for all of them."""
    known = prices.filter(F.col("close").isNotNull())
    if reference_symbol is not None:
        known = known.filter(F.col("symbol") == reference_symbol)
    return known.select("date").distinct()


def require_rows(df: DataFrame, message: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(message)
    return df


def calendar_attributes(days: DataFrame, reference_symbol: str | None = None) -> DataFrame:
    """Calendar columns; the week is the ISO week."""
    name = f"inferred_from_{reference_symbol or 'all_symbols'}"
    return days.select(
        "date",
        F.lit(True).alias("is_trading_day"),
        F.year("date").alias("year"),
        F.month("date").alias("month"),
        F.weekofyear("date").alias("week"),
        F.quarter("date").alias("quarter"),
        F.lit(name).alias("calendar_name"),
    )
