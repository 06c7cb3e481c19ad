"""Panel inputs read from the driver's Parquet tables (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeweave.operators.dims import feed_symbol
from tapeweave.session import written

# Which order group plays which macro series, its release lag in
# business days and its configuration group.
SERIES = [
    # priority, status, series name, lag, group
    ("1-URGENT", "F", "vix", 0, "macro_daily"),
    ("1-URGENT", "O", "treasury_3m", 0, "macro_daily"),
    ("1-URGENT", "P", "treasury_2y", 0, "macro_daily"),
    ("2-HIGH", "F", "treasury_10y", 0, "macro_daily"),
    ("2-HIGH", "O", "treasury_30y", 0, "macro_daily"),
    ("2-HIGH", "P", "high_yield_oas", 0, "macro_daily"),
    ("3-MEDIUM", "F", "corporate_oas", 0, "macro_daily"),
    ("3-MEDIUM", "O", "fed_funds", 0, "macro_daily"),
    ("3-MEDIUM", "P", "unemployment", 5, "macro_slow"),
    ("4-NOT SPECIFIED", "F", "cpi", 15, "macro_slow"),
    ("4-NOT SPECIFIED", "O", "industrial_production", 15, "macro_slow"),
    ("4-NOT SPECIFIED", "P", "chicago_fed_nfci", 7, "macro_slow"),
    ("5-LOW", "F", "credit_growth", 1, "macro_slow"),
    ("5-LOW", "O", "freight_index", 1, "macro_slow"),
    ("5-LOW", "P", "housing_starts", 2, "macro_slow"),
]

# Unit of the macro values; an odd unit keeps six-digit roundings clear of exact ties.
MACRO_UNIT = 99_991
MARKET_SYMBOL = "Brand#1"
INDEX_SYMBOLS = ("Brand#2", "Brand#3")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def asset_type(symbol: str | Column = "symbol") -> Column:
    s = F.col(symbol) if isinstance(symbol, str) else symbol
    return (
        F.when(s == MARKET_SYMBOL, "etf").when(s.isin(*INDEX_SYMBOLS), "index").otherwise("stock")
    )


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate"
    )


def trades(spark: SparkSession, sf_dir: str, items: DataFrame | None = None) -> DataFrame:
    """One row per line item with its symbol, day, price and a total order inside the day."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    if items is None:
        items = line_items(spark, sf_dir)
    else:  # a few of all: the parts need not go through the driver for them
        parts = parts.hint("merge")
    return items.join(parts, items.l_partkey == parts.p_partkey).select(
        F.col("p_brand").alias("symbol"),
        F.to_date("l_shipdate").alias("date"),
        F.try_divide("l_extendedprice", "l_quantity").alias("price"),
        F.col("l_quantity").alias("quantity"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("seq"),
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars: day totals of all line items, then open and close from the orders that begin or end a day."""
    totals = written(day_totals(trades(spark, sf_dir)), "day-totals")
    ends = totals.select(F.explode(F.array("first_key", "last_key")).alias("end_key")).distinct()
    items = line_items(spark, sf_dir).join(ends, F.col("l_orderkey").eqNullSafe(F.col("end_key")), "left_semi")
    return daily_bars(totals, trades(spark, sf_dir, items))


def _leading(ticks: DataFrame) -> Column:
    """The field that seq is ordered by first."""
    return F.col("seq")[ticks.schema["seq"].dataType.names[0]]


def day_totals(ticks: DataFrame) -> DataFrame:
    """What fixed-size sums give of a symbol's day, with the least and greatest leading key of its order.

    A task holds one small row per symbol and day; ordering by whole structs would sort all its rows.
    """
    key = _leading(ticks)
    return ticks.groupBy("symbol", "date").agg(
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.sum("quantity").alias("volume"),
        # A null key comes before all others.
        F.when(F.count_if(key.isNull()) == 0, F.min(key)).alias("first_key"),
        F.max(key).alias("last_key"),
    )


def daily_bars(totals: DataFrame, ticks: DataFrame) -> DataFrame:
    """Bars from day totals and ticks that hold at least the rows of every day's first and last key."""
    key = _leading(ticks)
    t, d = totals.withColumnsRenamed({"symbol": "_symbol", "date": "_date"}), ticks
    same_day = d["symbol"].eqNullSafe(t["_symbol"]) & d["date"].eqNullSafe(t["_date"])
    at_end = key.eqNullSafe(F.col("first_key")) | key.eqNullSafe(F.col("last_key"))
    return (
        d.join(t, same_day & at_end)
        .groupBy("symbol", "date")
        .agg(
            F.min_by("price", "seq").alias("open"),
            F.any_value("high").alias("high"),
            F.any_value("low").alias("low"),
            F.max_by("price", "seq").alias("close"),
            F.any_value("volume").alias("volume"),
        )
        .select("date", "symbol", "open", "high", "low", "close", "volume")
    )


def tick_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars per event type, the second bar source."""
    ticks = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"),
        F.to_date("ts").alias("date"),
        F.col("value").alias("price"),
        F.lit(1.0).alias("quantity"),
        F.struct("ts", "event_id").alias("seq"),
    )
    return daily_bars(written(day_totals(ticks), "day-totals"), ticks)


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars as normalized price rows with their provenance columns."""
    return normalized_prices(bars(spark, sf_dir), "lineitem")


def normalized_prices(daily: DataFrame, source: str) -> DataFrame:
    return daily.select(
        "date",
        "symbol",
        feed_symbol("symbol").alias("source_symbol"),
        "open",
        "high",
        "low",
        "close",
        "volume",
        F.lit(source).alias("source"),
        F.lit(False).alias("adjusted_flag"),
        F.lit("USD").alias("currency"),
        exchange().alias("exchange"),
        asset_type().alias("asset_type"),
        F.lit("ok").alias("quality_flag"),
    )


def brand_number(symbol: str = "symbol") -> Column:
    return F.regexp_extract(symbol, r"(\d+)$", 1).cast("int")


def exchange(symbol: str = "symbol") -> Column:
    return F.concat(F.lit("EX"), (brand_number(symbol) % 3).cast("string"))


def symbol_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptive columns per brand; every fifth one is known to be delisted."""
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("symbol")).distinct()
    return brands.select(
        "symbol",
        F.lit("lineitem").alias("source"),
        feed_symbol("symbol").alias("source_symbol"),
        asset_type().alias("asset_type"),
        exchange().alias("exchange"),
        F.lit("USD").alias("currency"),
        F.when(brand_number() % 5 == 0, "confirmed_delisted").alias("survivorship_status"),
        F.when(brand_number() % 2 == 0, F.lit(True)).alias("point_in_time_valid"),
    )


def series_definitions(spark: SparkSession) -> DataFrame:
    """Fixed driver-side configuration: one row per macro series."""
    rows = [(f"{p}|{s}", name, lag, group, lag > 0) for p, s, name, lag, group in SERIES]
    return spark.createDataFrame(
        rows,
        "series_id string, series_name string, lag_business_days int, series_group string, revised_data_flag boolean",
    )


def macro_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observation value per series and day: the mean order total of that group, in macro units."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderpriority", "o_orderstatus", "o_orderdate", "o_totalprice"
    )
    return (
        orders.groupBy(
            F.concat_ws("|", "o_orderpriority", "o_orderstatus").alias("series_id"),
            F.to_date("o_orderdate").alias("date"),
        )
        .agg((F.avg("o_totalprice") / MACRO_UNIT).alias("value"))
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label and the embedding as doubles."""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", F.col("embedding").cast("array<double>").alias("vector")
    )
