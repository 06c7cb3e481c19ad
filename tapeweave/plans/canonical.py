"""Queries over the canonical tables: ingest, dimensions, panel, features, targets, checks."""

from __future__ import annotations

from zipfile import ZIP_DEFLATED, ZipFile

from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeweave.functions.expr import rounded
from tapeweave.operators import crosssec, dims, macro, panel, quality, targets
from tapeweave.plans import tables
from tapeweave.plans.registry import query
from tapeweave.plans.sqlbase import MACRO_COLUMNS, r6, with_tables
from tapeweave.session import scratch_path, shared_folder
from tapeweave.sources import driver_tables as src
from tapeweave.sources import publish, text

PRICE_FIELDS = ("open", "high", "low", "close", "volume")
PRICES = ", ".join(PRICE_FIELDS)
BARS_SQL = f"SELECT date, symbol, {PRICES} FROM bars"

# --- A: ingest and publishing -------------------------------------------------


def requested_symbols(spark: SparkSession, sf: str) -> DataFrame:
    return src.symbol_metadata(spark, sf).select(
        "symbol", "source_symbol", "currency", "exchange", "asset_type"
    )


def bulk_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Bars spelled as bulk daily text."""
    return tables.prices(spark, sf).select(
        F.upper("source_symbol").alias("<TICKER>"),
        F.lit("D").alias("<PER>"),
        F.date_format("date", "yyyyMMdd").alias("<DATE>"),
        F.lit("000000").alias("<TIME>"),
        *[F.col(c).alias(f"<{c.upper()}>") for c in ("open", "high", "low", "close")],
        F.col("volume").alias("<VOL>"),
        F.lit("0").alias("<OPENINT>"),
    )


INGESTED = ["date", "symbol", "source_symbol", *PRICE_FIELDS, "currency", "exchange", "asset_type", "quality_flag"]
INGESTED_SQL = with_tables(
    f"SELECT date, symbol, source_symbol, {PRICES}, currency, exchange, asset_type, quality_flag FROM prices",
    "prices",
)


@query("a1_bulk_text_ingest", INGESTED_SQL)
def a1_bulk_text_ingest(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "bulk-text")
    bulk_rows(spark, sf).write.option("header", True).csv(path)
    loaded = text.read_bulk_text(spark, path, requested_symbols(spark, sf))
    return loaded.select(*INGESTED)


def write_archives(spark: SparkSession, sf: str) -> str:
    """One archive per symbol, each with its bulk text member; a symbol is bounded by its days."""
    path = scratch_path(spark, "archives")

    def pack(pdf):
        ticker = pdf["<TICKER>"].iloc[0].lower()
        member = f"data/daily/us/panel stocks/1/{ticker}.txt"
        if "://" in path and not path.startswith("file:"):
            filesystem, folder = FileSystem.from_uri(path)
        else:
            filesystem, folder = LocalFileSystem(), text.local_file(path)
        filesystem.create_dir(folder, recursive=True)
        with filesystem.open_output_stream(f"{folder}/{ticker}.zip") as out, ZipFile(out, "w", ZIP_DEFLATED) as archive:
            archive.writestr(member, pdf.sort_values("<DATE>").to_csv(index=False))
        return pdf.iloc[:1][["<TICKER>"]].rename(columns={"<TICKER>": "ticker"})

    bulk_rows(spark, sf).groupBy("<TICKER>").applyInPandas(pack, "ticker string").write.format("noop").mode(
        "overwrite"
    ).save()
    return path


@query("a1_zipped_archive_ingest", INGESTED_SQL)
def a1_zipped_archive_ingest(spark: SparkSession, sf: str) -> DataFrame:
    loaded = text.read_archives(spark, write_archives(spark, sf), requested_symbols(spark, sf))
    return loaded.select(*INGESTED)


@query("a2_symbol_csv_ingest", INGESTED_SQL)
def a2_symbol_csv_ingest(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "symbol-csv")
    tables.prices(spark, sf).select(
        "source_symbol",
        F.col("date").alias(" Date"),
        *[F.col(c).alias(f" {c.title()} ") for c in PRICE_FIELDS],
    ).write.partitionBy("source_symbol").option("header", True).csv(path)
    loaded = text.read_symbol_csv(spark, path, requested_symbols(spark, sf))
    return loaded.select(*INGESTED)


@query(
    "a3_archive_inventory",
    with_tables(
        "SELECT source_symbol || '.zip' AS archive, "
        "'data/daily/us/panel stocks/1/' || source_symbol || '.txt' AS member_path, source_symbol, "
        "'us' AS market, 'panel stocks' AS category FROM man",
        "man",
    ),
)
def a3_archive_inventory(spark: SparkSession, sf: str) -> DataFrame:
    inventory = text.archive_inventory(spark, write_archives(spark, sf))
    return inventory.filter("compressed_size > 0 AND uncompressed_size >= compressed_size").select(
        F.url_decode(F.regexp_replace("archive", r"\+", "%2B")).alias("archive"),
        "member_path",
        "source_symbol",
        "market",
        "category",
    )


REQUEST_SQL = (
    "SELECT source_symbol FROM man UNION SELECT lower(r_name) || '.us' FROM region"
)


@query(
    "a4_resolve_member",
    with_tables(
        f"""SELECT r.source_symbol, count(m.source_symbol) AS member_count,
        CASE WHEN count(m.source_symbol) = 0 THEN 'unavailable' ELSE 'found' END AS status
        FROM ({REQUEST_SQL}) r LEFT JOIN man m ON r.source_symbol = m.source_symbol GROUP BY 1""",
        "man",
    ),
)
def a4_resolve_member(spark: SparkSession, sf: str) -> DataFrame:
    inventory = text.archive_inventory(spark, write_archives(spark, sf))
    regions = src.table(spark, sf, "region").select(F.concat(F.lower("r_name"), F.lit(".us")).alias("source_symbol"))
    return text.resolve_members(
        inventory, requested_symbols(spark, sf).select("source_symbol").union(regions)
    )


def write_macro_json(spark: SparkSession, sf: str) -> str:
    """Macro documents per series with text values; a value under one is published as missing."""
    path = scratch_path(spark, "macro-json")
    value = F.when(F.col("value") < 1, ".").otherwise(F.col("value").cast("string"))
    src.macro_observations(spark, sf).groupBy("series_id").agg(
        F.collect_list(F.struct(F.col("date").cast("string").alias("date"), value.alias("value"))).alias(
            "observations"
        )
    ).write.json(path)
    return path


@query(
    "a5_macro_json_ingest",
    with_tables(
        "SELECT series_id, date, round(CASE WHEN value >= 1 THEN value END, 6) AS value FROM macro_obs",
        "macro_obs",
    ),
)
def a5_macro_json_ingest(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(text.read_macro_json(spark, write_macro_json(spark, sf), multi_line=False))


@query(
    "a6_configured_series",
    with_tables(
        "SELECT series_id, series_name, date, round(value, 6) AS value, asof_date, revised_data_flag "
        "FROM macro_avail JOIN defs USING (series_id, series_name, revised_data_flag) "
        "WHERE series_group = 'macro_daily'",
        "macro_avail",
        "defs",
    ),
)
def a6_configured_series(spark: SparkSession, sf: str) -> DataFrame:
    enabled = macro.select_series(src.series_definitions(spark), ("macro_daily",))
    loaded = macro.with_availability(src.macro_observations(spark, sf), enabled)
    return rounded(
        loaded.select("series_id", "series_name", "date", "value", "asof_date", "revised_data_flag")
    )


@query(
    "a7_current_universes",
    "SELECT 'P.' || p_partkey AS symbol, p_name AS name, lower(p_type) AS universe_name, "
    "'p-' || p_partkey || '.us' AS source_symbol, 'current_constituents_backfilled' AS universe_type, "
    "'high' AS survivorship_bias, false AS point_in_time_membership FROM part",
)
def a7_current_universes(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch_path(spark, "universes")
    parts = src.table(spark, sf, "part").select(
        F.concat(F.lit("P."), F.col("p_partkey")).alias("symbol"),
        F.col("p_name").alias("name"),
        F.lower("p_type").alias("universe_name"),
    )
    text.write_universes(parts, root, "current")
    return text.read_current_universes(spark, root).drop("source_file")


@query(
    "a7_universe_changes",
    "SELECT CAST(o_orderdate AS DATE) AS effective_date, 'C' || o_custkey AS added_symbol, "
    "CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderpriority END AS added_name, "
    "'O' || o_orderkey AS removed_symbol, '' AS removed_name, 'orders' AS universe_name FROM orders",
)
def a7_universe_changes(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch_path(spark, "universes")
    src.table(spark, sf, "orders").select(
        F.date_format("o_orderdate", "MMMM d, yyyy").alias("effective_date"),
        F.concat(F.lit("C"), F.col("o_custkey")).alias("added_symbol"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("added_name"),
        F.concat(F.lit("O"), F.col("o_orderkey")).alias("removed_symbol"),
        F.lit(None).cast("string").alias("removed_name"),
    ).write.option("header", True).csv(f"{root}/orders_changes.csv")
    return text.read_universe_changes(spark, root).drop("source_file")


FEATURE_CHECKS = {
    "feature_leakage": "SELECT 1 FROM market_state WHERE coalesce(uses_future_data, false) "
    "OR max_source_date_used > date OR available_asof > date",
    "duplicate_feature_dates": "SELECT date FROM market_state GROUP BY date HAVING count(*) > 1",
    "duplicate_price_rows": "SELECT date, symbol FROM prices GROUP BY date, symbol HAVING count(*) > 1",
}


def published(spark: SparkSession, sf: str) -> tuple[str, str]:
    """A snapshot with prices, targets and a derived per-day table."""
    root = scratch_path(spark, "market")
    location = publish.publish(
        spark,
        root,
        "market_data",
        tables={
            "prices": tables.prices(spark, sf),
            "panel_days": tables.ticker_features(spark, sf).select(
                "date", "symbol", "return_1d", "valid_observation", "max_source_date_used", "available_asof",
                "uses_future_data",
            ),
        },
        derived={
            "market_state": "SELECT date, count_if(valid_observation) AS valid_rows, avg(return_1d) AS mean_return, "
            "max(max_source_date_used) AS max_source_date_used, max(available_asof) AS available_asof, "
            "max(uses_future_data) AS uses_future_data FROM panel_days GROUP BY date"
        },
        views={"valid_days": "SELECT date FROM market_state WHERE valid_rows > 0"},
        drop=("panel_days",),
        validations=FEATURE_CHECKS,
    )
    return root, location


@query("a8_read_published_table", with_tables(BARS_SQL, "bars"))
def a8_read_published_table(spark: SparkSession, sf: str) -> DataFrame:
    root, _ = published(spark, sf)
    return publish.read_table(spark, root, "market_data", "prices").select("date", "symbol", *PRICE_FIELDS)


@query(
    "a9_publish_snapshot",
    with_tables(
        "SELECT date, count(*) FILTER (valid_observation) AS valid_rows, round(avg(return_1d), 6) AS mean_return "
        "FROM feats GROUP BY date",
        "feats",
    ),
)
def a9_publish_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    root, _ = published(spark, sf)
    return rounded(
        publish.read_table(spark, root, "market_data", "market_state").select("date", "valid_rows", "mean_return")
    )


@query("a10_parquet_sink", with_tables(BARS_SQL, "bars"))
def a10_parquet_sink(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "bars")
    publish.write_parquet(tables.bars(spark, sf), path)
    return spark.read.parquet(path)


@query(
    "a11_build_metadata",
    with_tables(
        """SELECT (SELECT count(*) FROM bars) AS price_row_count,
        (SELECT count(DISTINCT symbol) FROM bars) AS symbol_count,
        (SELECT min(date) FROM bars) AS raw_price_first_date, (SELECT max(date) FROM bars) AS raw_price_last_date,
        (SELECT count(*) FROM xs) AS feature_row_count,
        (SELECT count(*) FROM bars WHERE symbol = 'Brand#1') AS target_row_count,
        (SELECT count(*) FROM macro_obs) AS macro_observation_row_count,
        (SELECT '[' || string_agg('"' || lower(r_name) || '.us"', ',' ORDER BY r_name) || ']' FROM region)
          AS unavailable_source_symbols""",
        "bars",
        "xs",
        "macro_obs",
    ),
)
def a11_build_metadata(spark: SparkSession, sf: str) -> DataFrame:
    regions = src.table(spark, sf, "region").select(F.concat(F.lower("r_name"), F.lit(".us")).alias("source_symbol"))
    missing = regions.join(requested_symbols(spark, sf), "source_symbol", "left_anti")
    return publish.build_metadata(
        tables.prices(spark, sf),
        tables.market_features(spark, sf),
        tables.market_targets(spark, sf),
        src.macro_observations(spark, sf),
        missing,
    )


@query("a12_table_fingerprint")
def a12_table_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprints of the source tables; equal content gives equal rows in any order."""
    rows = None
    for name in ("lineitem", "orders", "part", "events", "embeddings"):
        one = publish.fingerprint(src.table(spark, sf, name)).select(F.lit(name).alias("table_name"), "*")
        rows = one if rows is None else rows.unionByName(one)
    return rows


FINGERPRINTED = {
    "orders": ["o_custkey", "o_orderdate", "o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice"],
    "part": ["p_brand", "p_name", "p_partkey", "p_retailprice", "p_size", "p_type"],
}


def fingerprint_sql(name: str, columns: list[str]) -> str:
    texts = [f"CAST({c} AS VARCHAR)" for c in columns]
    row = " || ".join(f"coalesce(length({x}) || ':' || {x}, '-')" for x in texts)
    pieces = ", ".join(
        f"CAST(sum(CAST('0x' || substr(digest, {start}, 15) AS BIGINT)) AS VARCHAR) AS {h}"
        for start, h in zip((1, 16), publish.HASHES, strict=True)
    )
    return f"SELECT '{name}' AS table_name, count(*) AS row_count, {pieces} FROM (SELECT sha256({row}) AS digest FROM {name})"


@query("a12_file_fingerprints", " UNION ALL ".join(fingerprint_sql(n, c) for n, c in FINGERPRINTED.items()))
def a12_file_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprints added up from those of the files; unchanged files are not read a second time."""
    rows = None
    for name in FINGERPRINTED:
        record = f"{shared_folder(spark)}/tapeweave/fingerprints"
        files = publish.file_fingerprints(spark, f"{sf}/{name}.parquet", record)
        hashes = [F.col(h).cast("string").alias(h) for h in publish.HASHES]
        one = publish.combined(files).select(F.lit(name).alias("table_name"), "row_count", *hashes)
        rows = one if rows is None else rows.unionByName(one)
    return rows


@query(
    "a15_report_sinks",
    with_tables(
        "SELECT 'csv' AS form, observation_status, count(*) AS row_count FROM panel GROUP BY 2 UNION ALL "
        "SELECT 'json', observation_status, count(*) FROM panel GROUP BY 2",
        "panel",
    ),
)
def a15_report_sinks(spark: SparkSession, sf: str) -> DataFrame:
    counts = panel.status_counts(tables.aligned(spark, sf))
    schema = "observation_status string, row_count bigint"
    path = scratch_path(spark, "report")
    forms = []
    for form in ("csv", "json"):
        publish.write_report(counts, f"{path}/{form}", form)
        loaded = spark.read.schema(schema).option("header", True).format(form).load(f"{path}/{form}")
        forms.append(loaded.select(F.lit(form).alias("form"), "*"))
    return forms[0].unionByName(forms[1])


# --- B: dimensions -------------------------------------------------------------


@query(
    "b1_ticker_normalization",
    f"""SELECT ticker, replace(lower(trim(ticker)), '.', '-') || '.us' AS source_symbol,
    'STOCK_US_' || replace(trim(ticker), '.', '_') AS symbol FROM (
    SELECT ' ' || upper(p_name) || '.' || p_brand || ' ' AS ticker FROM part)""",
)
def b1_ticker_normalization(spark: SparkSession, sf: str) -> DataFrame:
    names = src.table(spark, sf, "part").select(
        F.concat(F.lit(" "), F.upper("p_name"), F.lit("."), F.col("p_brand"), F.lit(" ")).alias("ticker")
    )
    return names.select(
        "ticker", dims.feed_symbol("ticker").alias("source_symbol"), dims.canonical_stock_id("ticker").alias("symbol")
    )


@query(
    "b2_stack_metadata",
    "SELECT c_name AS name, c_mktsegment AS segment, c_nationkey AS nation, NULL AS account FROM customer "
    "UNION ALL SELECT s_name, NULL, s_nationkey, round(s_acctbal, 6) FROM supplier",
)
def b2_stack_metadata(spark: SparkSession, sf: str) -> DataFrame:
    customers = src.table(spark, sf, "customer").select(
        F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation")
    )
    suppliers = src.table(spark, sf, "supplier").select(
        F.col("s_name").alias("name"),
        F.col("s_nationkey").alias("nation"),
        F.round("s_acctbal", 6).alias("account"),
    )
    return dims.stack_metadata(customers, suppliers)


MANIFEST = (
    "symbol, source, source_symbol, first_available_date, last_available_date, n_rows, asset_type, exchange, "
    "currency, survivorship_status, point_in_time_valid"
)


@query("b3_symbol_manifest", with_tables(f"SELECT {MANIFEST} FROM man", "man"))
def b3_symbol_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return tables.manifest(spark, sf).select(*MANIFEST.split(", "))


@query(
    "b4_instrument_id",
    with_tables(
        "SELECT symbol, substr(sha1(source || '|' || source_symbol || '|' || CAST(first_available_date AS VARCHAR)), 1, 16) "
        "AS instrument_id FROM man",
        "man",
    ),
)
def b4_instrument_id(spark: SparkSession, sf: str) -> DataFrame:
    return tables.manifest(spark, sf).select("symbol", "instrument_id")


@query(
    "b5_trading_calendar",
    with_tables(
        "SELECT 'all_symbols' AS scope, date FROM cal UNION ALL "
        "SELECT 'Brand#1', date FROM bars WHERE symbol = 'Brand#1'",
        "cal",
    ),
)
def b5_trading_calendar(spark: SparkSession, sf: str) -> DataFrame:
    daily = tables.bars(spark, sf)
    every = dims.trading_days(daily).select(F.lit("all_symbols").alias("scope"), "date")
    one = dims.trading_days(daily, src.MARKET_SYMBOL).select(F.lit(src.MARKET_SYMBOL).alias("scope"), "date")
    return every.unionByName(one)


@query(
    "b6_calendar_attributes",
    with_tables(
        """SELECT date, true AS is_trading_day, CAST(year(date) AS INTEGER) AS year,
        CAST(month(date) AS INTEGER) AS month, CAST(week(date) AS INTEGER) AS week,
        CAST(quarter(date) AS INTEGER) AS quarter, 'inferred_from_all_symbols' AS calendar_name FROM cal""",
        "cal",
    ),
)
def b6_calendar_attributes(spark: SparkSession, sf: str) -> DataFrame:
    return dims.calendar_attributes(tables.calendar(spark, sf))


# --- C: alignment ----------------------------------------------------------------


@query(
    "c1_complete_grid",
    with_tables("SELECT date, symbol, " + PRICES + " FROM panel", "panel"),
)
def c1_complete_grid(spark: SparkSession, sf: str) -> DataFrame:
    return tables.aligned(spark, sf).select("date", "symbol", *PRICE_FIELDS)


@query(
    "c2_backfilled_descriptions",
    with_tables(
        "SELECT date, symbol, source, source_symbol, asset_type, exchange, currency, first_available_date, "
        "last_available_date, survivorship_status FROM panel",
        "panel",
    ),
)
def c2_backfilled_descriptions(spark: SparkSession, sf: str) -> DataFrame:
    return tables.aligned(spark, sf).select(
        "date", "symbol", *panel.DESCRIPTIVE, "first_available_date", "last_available_date", "survivorship_status"
    )


@query(
    "c3_observation_status",
    with_tables(
        "SELECT date, symbol, observation_status, observation_status = 'ok' AS valid_observation FROM panel", "panel"
    ),
)
def c3_observation_status(spark: SparkSession, sf: str) -> DataFrame:
    return tables.aligned(spark, sf).select("date", "symbol", "observation_status", "valid_observation")


@query(
    "c4_status_counts",
    with_tables("SELECT observation_status, count(*) AS row_count FROM panel GROUP BY 1", "panel"),
)
def c4_status_counts(spark: SparkSession, sf: str) -> DataFrame:
    return panel.status_counts(tables.aligned(spark, sf))


# --- D: rolling features of each instrument ----------------------------------------

PER_HORIZON = {
    "d3_horizon_return": "return_{h}d",
    "d4_realized_vol": "realized_vol_{h}d",
    "d5_drawdown": "drawdown_{h}d",
    "d6_ma_distance": "ma_distance_{h}d",
    "d7_path_efficiency": "path_efficiency_{h}d",
}
FEATURE_COLUMNS = {
    "d1_return_1d": ["return_1d"],
    **{name: [form.format(h=h) for h in panel.HORIZONS] for name, form in PER_HORIZON.items()},
}


def _feature_query(name: str, columns: list[str]) -> None:
    @query(
        name,
        with_tables(f"SELECT date, symbol, {', '.join(r6(c, c) for c in columns)} FROM feats", "feats"),
    )
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return rounded(tables.ticker_features(spark, sf).select("date", "symbol", *columns))


for _name, _columns in FEATURE_COLUMNS.items():
    _feature_query(_name, _columns)


@query("d2_dollar_volume", with_tables("SELECT date, symbol, dollar_volume FROM feats", "feats"))
def d2_dollar_volume(spark: SparkSession, sf: str) -> DataFrame:
    return tables.ticker_features(spark, sf).select("date", "symbol", "dollar_volume")


@query(
    "d8_feature_provenance",
    with_tables("SELECT date, symbol, max_source_date_used, available_asof, uses_future_data FROM feats", "feats"),
)
def d8_feature_provenance(spark: SparkSession, sf: str) -> DataFrame:
    return tables.ticker_features(spark, sf).select("date", "symbol", *crosssec.PROVENANCE)


TICK_SQL = """WITH bars AS (SELECT event_type AS symbol, CAST(ts AS DATE) AS date,
  first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
  last(value ORDER BY ts, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2),
r AS (SELECT *, ln(close) - lag(ln(close), 1) OVER w AS return_1d, ln(close) - lag(ln(close), 5) OVER w AS return_5d
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date))
SELECT date, symbol, round(return_1d, 6) AS return_1d, round(return_5d, 6) AS return_5d,
  round(CASE WHEN count(return_1d) OVER w >= 5 THEN stddev_samp(return_1d) OVER w * sqrt(252) END, 6) AS realized_vol_5d,
  round(CASE WHEN count(close) OVER w >= 5 THEN close / max(close) OVER w - 1 END, 6) AS drawdown_5d
FROM r WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"""


@query("d4_event_bar_features", TICK_SQL)
def d4_event_bar_features(spark: SparkSession, sf: str) -> DataFrame:
    daily = src.tick_bars(spark, sf)
    wanted = ["return_1d", "return_5d", "realized_vol_5d", "drawdown_5d"]
    return rounded(panel.asset_features(daily, (5,)).select("date", "symbol", *wanted))


# --- E: macro as of availability ------------------------------------------------------


@query(
    "e1_availability_date",
    with_tables("SELECT series_id, date, asof_date FROM macro_avail", "macro_avail"),
)
def e1_availability_date(spark: SparkSession, sf: str) -> DataFrame:
    return tables.available_macro(spark, sf).select("series_id", "date", "asof_date")


@query(
    "e2_revision_flag",
    with_tables(
        "SELECT series_id, count(*) AS row_count, bool_and(NOT point_in_time) AS revised_data_flag FROM "
        "(SELECT series_id, lag_business_days % 2 = 1 AS point_in_time FROM macro_obs JOIN defs USING (series_id)) GROUP BY 1",
        "macro_obs",
        "defs",
    ),
)
def e2_revision_flag(spark: SparkSession, sf: str) -> DataFrame:
    undeclared = src.series_definitions(spark).select(
        "series_id",
        "series_name",
        "lag_business_days",
        (F.col("lag_business_days") % 2 == 1).alias("point_in_time_available"),
        F.lit(None).cast("boolean").alias("revised_data_flag"),
    )
    loaded = macro.with_availability(src.macro_observations(spark, sf), undeclared)
    return loaded.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("row_count"), F.bool_and("revised_data_flag").alias("revised_data_flag")
    )


@query(
    "e3_latest_per_availability",
    with_tables(
        "SELECT series_name, asof_date, observation_date, round(value, 6) AS value FROM macro_latest", "macro_latest"
    ),
)
def e3_latest_per_availability(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(macro.latest_per_availability(tables.available_macro(spark, sf)))


@query("e4_warmup_spine", with_tables("SELECT date, requested FROM spine", "spine"))
def e4_warmup_spine(spark: SparkSession, sf: str) -> DataFrame:
    return macro.warmup_spine(tables.calendar(spark, sf), max(macro.CHANGE_WINDOWS))


@query(
    "e5_asof_join",
    with_tables(
        "SELECT series_name, date, round(level, 6) AS level, observation_date, asof_date FROM macro_levels",
        "macro_levels",
    ),
)
def e5_asof_join(spark: SparkSession, sf: str) -> DataFrame:
    levels = macro.macro_levels(
        tables.available_macro(spark, sf), tables.calendar(spark, sf), tables.SERIES_NAMES
    )
    return rounded(levels.select("series_name", "date", "level", "observation_date", "asof_date"))


@query(
    "e6_macro_changes",
    with_tables(
        f"SELECT date, {', '.join(r6(c, c) for c in MACRO_COLUMNS)} FROM macro_wide", "macro_wide"
    ),
)
def e6_macro_changes(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(tables.macro_features(spark, sf).select("date", *MACRO_COLUMNS))


@query(
    "e7_derived_spreads",
    with_tables(f"SELECT date, {', '.join(r6(c, c) for c in macro.SPREADS)} FROM macro_wide", "macro_wide"),
)
def e7_derived_spreads(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(tables.macro_features(spark, sf).select("date", *macro.SPREADS))


@query(
    "e8_latest_source_dates",
    with_tables("SELECT date, max_source_date_used, available_asof FROM macro_wide", "macro_wide"),
)
def e8_latest_source_dates(spark: SparkSession, sf: str) -> DataFrame:
    return tables.macro_features(spark, sf).select("date", "max_source_date_used", "available_asof")


# --- F: cross-section ---------------------------------------------------------------------

CROSS_SECTION = {
    "f1_xs_dispersion": "xs_dispersion_1d",
    "f2_xs_iqr": "xs_iqr_1d",
    "f3_breadth": "breadth_1d",
    "f4_n_assets": "n_assets",
    "f5_pct_above_ma": "pct_above_ma_63d",
}


def _cross_query(name: str, column: str) -> None:
    value = column if column == "n_assets" else f"round({column}, 6)"

    @query(name, with_tables(f"SELECT date, {value} AS {column} FROM xs", "xs"))
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return rounded(tables.market_features(spark, sf).select("date", column))


for _name, _column in CROSS_SECTION.items():
    _cross_query(_name, _column)

STATE = ["xs_dispersion_1d", "xs_iqr_1d", "breadth_1d", "pct_above_ma_63d"]


def market_state(spark: SparkSession, sf: str) -> DataFrame:
    """Dispersion, breadth and coverage of the stock panel per day."""
    return rounded(tables.market_features(spark, sf).select("date", *STATE, "n_assets"))


query(
    "f_market_state",
    with_tables(f"SELECT date, {', '.join(r6(c, c) for c in STATE)}, n_assets FROM xs", "xs"),
)(market_state)

FEATURES = [*STATE, *MACRO_COLUMNS, *macro.SPREADS]


@query(
    "f6_date_features",
    with_tables(
        f"SELECT date, {', '.join(r6(c, c) for c in FEATURES)}, n_assets, max_source_date_used, available_asof, "
        "uses_future_data FROM features",
        "features",
    ),
)
def f6_date_features(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(
        tables.features(spark, sf).select("date", *FEATURES, "n_assets", *crosssec.PROVENANCE)
    )


# --- G: forward outcomes -------------------------------------------------------------------


def targets_sql(horizons: tuple[int, ...], symbol: str | None, source: str = "feats") -> str:
    scope = "valid_observation" + (f" AND symbol = '{symbol}'" if symbol else "")
    frames = ", ".join(
        f"f{h} AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)" for h in horizons
    )
    columns = ", ".join(
        f"""ln(lead(close, {h}) OVER w / close) AS future_return_{h}d,
        CASE WHEN count(return_1d) OVER f{h} = {h} THEN stddev_samp(return_1d) OVER f{h} * sqrt(252) END
        AS future_realized_vol_{h}d"""
        for h in horizons
    )
    falls = ", ".join(
        f"CASE WHEN max(step) >= {h} THEN min(fall) FILTER (step BETWEEN 1 AND {h}) END AS future_max_drawdown_{h}d"
        for h in horizons
    )
    return f"""SELECT m.date, m.symbol, {', '.join(
        f"m.future_return_{h}d, m.future_realized_vol_{h}d, p.future_max_drawdown_{h}d, "
        f"m.future_return_{h}d / (m.future_realized_vol_{h}d + 1e-12) AS future_trend_score_{h}d" for h in horizons
    )}, true AS uses_future_data FROM (
      SELECT date, symbol, row_number() OVER w AS pos, {columns} FROM {source} WHERE {scope}
      WINDOW w AS (PARTITION BY symbol ORDER BY date), {frames}) m JOIN (
      SELECT symbol, pos, {falls} FROM (
        SELECT a.symbol, a.pos, b.pos - a.pos AS step,
        b.close / max(b.close) OVER (PARTITION BY a.symbol, a.pos ORDER BY b.pos) - 1 AS fall
        FROM (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY date) AS pos FROM {source} WHERE {scope}) a
        JOIN (SELECT symbol, close, row_number() OVER (PARTITION BY symbol ORDER BY date) AS pos FROM {source} WHERE {scope}) b
        ON a.symbol = b.symbol AND b.pos BETWEEN a.pos AND a.pos + {max(horizons)}) GROUP BY symbol, pos) p
      ON m.symbol = p.symbol AND m.pos = p.pos"""


FORWARD = {
    "g1_future_return": "future_return_{h}d",
    "g2_future_realized_vol": "future_realized_vol_{h}d",
    "g3_future_max_drawdown": "future_max_drawdown_{h}d",
    "g4_future_trend_score": "future_trend_score_{h}d",
}
ALL_TARGETS = [form.format(h=h) for h in targets.TARGET_HORIZONS for form in FORWARD.values()]


def _forward_query(name: str, form: str) -> None:
    columns = [form.format(h=h) for h in targets.TARGET_HORIZONS]

    @query(
        name,
        with_tables(
            f"SELECT date, symbol, {', '.join(r6(c, c) for c in columns)} "
            f"FROM ({targets_sql(targets.TARGET_HORIZONS, src.MARKET_SYMBOL)})",
            "feats",
        ),
    )
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return rounded(tables.market_targets(spark, sf).select("date", "symbol", *columns))


for _name, _form in FORWARD.items():
    _forward_query(_name, _form)


@query(
    "g5_all_symbol_targets",
    with_tables(
        f"SELECT date, symbol, {', '.join(r6(c, c) for c in ALL_TARGETS)}, uses_future_data "
        f"FROM ({targets_sql(targets.TARGET_HORIZONS, None)})",
        "feats",
    ),
)
def g5_all_symbol_targets(spark: SparkSession, sf: str) -> DataFrame:
    outcomes = targets.future_targets(tables.ticker_features(spark, sf), None)
    return rounded(outcomes.select("date", "symbol", *ALL_TARGETS, "uses_future_data"))


# --- H: checks ---------------------------------------------------------------------------------


@query(
    "h1_duplicate_keys",
    "SELECT l_orderkey, l_linenumber, count(*) AS row_count FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
def h1_duplicate_keys(spark: SparkSession, sf: str) -> DataFrame:
    return quality.duplicate_keys(src.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "h2_ohlc_sanity",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, open, high, low, close FROM (SELECT *, "
    "l_extendedprice / l_quantity AS open, l_extendedprice * (1 + l_tax) / l_quantity AS high, "
    "l_extendedprice * (1 - l_discount) / l_quantity AS low, "
    "l_extendedprice * (1 - l_discount) * (1 + l_tax) / l_quantity - 1000 AS close FROM lineitem) "
    "WHERE high < greatest(open, close, low) OR low > least(open, close, high) OR close <= 0",
)
def h2_ohlc_sanity(spark: SparkSession, sf: str) -> DataFrame:
    price, discount, tax, quantity = (
        F.col(c) for c in ("l_extendedprice", "l_discount", "l_tax", "l_quantity")
    )
    quotes = src.table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        (price / quantity).alias("open"),
        (price * (1 + tax) / quantity).alias("high"),
        (price * (1 - discount) / quantity).alias("low"),
        (price * (1 - discount) * (1 + tax) / quantity - 1000).alias("close"),
    )
    return quality.bad_ohlc(quotes)


@query(
    "h3_feature_leakage",
    with_tables(
        "SELECT series_name, date, asof_date FROM macro_avail WHERE asof_date > date OR revised_data_flag",
        "macro_avail",
    ),
)
def h3_feature_leakage(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.available_macro(spark, sf).select(
        "series_name",
        "date",
        "asof_date",
        F.col("asof_date").alias("available_asof"),
        F.col("date").alias("max_source_date_used"),
        F.col("revised_data_flag").alias("uses_future_data"),
    )
    return quality.leaking_rows(rows).select("series_name", "date", "asof_date")


AUDITED = {
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"],
    "orders": ["o_orderkey", "o_custkey", "o_totalprice"],
    "customer": ["c_custkey", "c_nationkey", "c_acctbal"],
    "supplier": ["s_suppkey", "s_nationkey", "s_acctbal"],
    "labels": ["doc_id", "quality", "toxic"],
    "embeddings": ["vec_id", "label"],
    "events": ["event_id", "user_id", "value"],
}


#: Future columns that probes declare; every other one of the target table is a finding.
DECLARED = [form.format(h=h) for h in (5, 21) for form in FORWARD.values()]
UNDECLARED = [c for c in ALL_TARGETS if c not in DECLARED]


@query(
    "h4_schema_audit",
    with_tables(
        "SELECT 'forbidden' AS finding, 'embeddings' AS table_name, 'label' AS column_name, "
        "(SELECT count(label) FROM embeddings) AS known_values "
        "UNION ALL SELECT 'missing', 'events', 'available_asof', NULL "
        + " ".join(
            f"UNION ALL SELECT 'measure', '{table}', '{column}', (SELECT count({column}) FROM {table})"
            for table, columns in AUDITED.items()
            for column in columns
        )
        + f" UNION ALL SELECT 'undeclared_future', 'market_targets', column_name, known_values FROM (SELECT "
        + ", ".join(f"count({c}) AS {c}" for c in UNDECLARED)
        + f" FROM ({targets_sql(targets.TARGET_HORIZONS, src.MARKET_SYMBOL)})) UNPIVOT (known_values FOR column_name IN ({', '.join(UNDECLARED)}))",
        "feats",
    ),
)
def h4_schema_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Schema findings with the number of known values of each column that exists."""
    frames = {n: src.table(spark, sf, n) for n in AUDITED}
    schema = quality.schema_rows(frames)
    required = spark.createDataFrame(
        [("events", "ts"), ("events", "value"), ("events", "available_asof")], "table_name string, column_name string"
    )

    def finding(kind: str, rows: DataFrame) -> DataFrame:
        return rows.select(F.lit(kind).alias("finding"), "table_name", "column_name")

    found = (
        finding("forbidden", quality.forbidden_columns(schema))
        .unionByName(finding("missing", quality.missing_columns(schema, required)))
        .unionByName(finding("measure", quality.measure_catalog(schema)))
    )
    outcomes = {"market_targets": tables.market_targets(spark, sf)}
    found = found.unionByName(
        finding("undeclared_future", quality.undeclared_future_columns(quality.schema_rows(outcomes), DECLARED))
    )
    counts = None
    for name, df in {**frames, **outcomes}.items():
        one = (
            df.agg(*[F.count(c).alias(c) for c in df.columns])
            .unpivot([], df.columns, "column_name", "known_values")
            .withColumn("table_name", F.lit(name))
        )
        counts = one if counts is None else counts.unionByName(one)
    return found.join(counts, ["table_name", "column_name"], "left").select(
        "finding", "table_name", "column_name", "known_values"
    )


@query(
    "h6_key_contiguity",
    """SELECT 'embeddings.vec_id' AS key_name, min(vec_id) AS first_id, max(vec_id) AS last_id, count(*) AS row_count,
    count(DISTINCT vec_id) AS distinct_ids, min(vec_id) = 0 AND max(vec_id) = count(*) - 1
    AND count(DISTINCT vec_id) = count(*) AS is_dense FROM embeddings
    UNION ALL SELECT 'lineitem.l_partkey', min(l_partkey), max(l_partkey), count(*), count(DISTINCT l_partkey),
    min(l_partkey) = 0 AND max(l_partkey) = count(*) - 1 AND count(DISTINCT l_partkey) = count(*) FROM lineitem""",
)
def h6_key_contiguity(spark: SparkSession, sf: str) -> DataFrame:
    checks = (("embeddings", "vec_id"), ("lineitem", "l_partkey"))
    rows = [
        quality.key_contiguity(src.table(spark, sf, t), k).select(F.lit(f"{t}.{k}").alias("key_name"), "*")
        for t, k in checks
    ]
    return rows[0].unionByName(rows[1])


@query(
    "h6_out_of_range_keys",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT s_suppkey FROM supplier)",
)
def h6_out_of_range_keys(spark: SparkSession, sf: str) -> DataFrame:
    suppliers = src.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("o_custkey"))
    return quality.out_of_range(src.table(spark, sf, "orders"), "o_custkey", suppliers).select(
        "o_orderkey", "o_custkey"
    )


@query(
    "h7_validation_suite",
    with_tables(
        """SELECT 'bad_ohlc' AS check_name, count(*) AS offending_rows FROM bars
        WHERE high < greatest(open, close, low) OR low > least(open, close, high) OR close <= 0 UNION ALL
        SELECT 'duplicate_line_keys', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
        UNION ALL SELECT 'duplicate_price_rows', count(*) FROM (SELECT 1 FROM bars GROUP BY date, symbol HAVING count(*) > 1)
        UNION ALL SELECT 'late_macro_rows', count(*) FROM macro_avail WHERE asof_date > date OR revised_data_flag""",
        "bars",
        "macro_avail",
    ),
)
def h7_validation_suite(spark: SparkSession, sf: str) -> DataFrame:
    daily = tables.bars(spark, sf)
    late = tables.available_macro(spark, sf).select(
        "date",
        F.col("asof_date").alias("available_asof"),
        F.col("date").alias("max_source_date_used"),
        F.col("revised_data_flag").alias("uses_future_data"),
    )
    return quality.check_counts(
        {
            "bad_ohlc": quality.bad_ohlc(daily),
            "duplicate_line_keys": quality.duplicate_keys(
                src.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"]
            ),
            "duplicate_price_rows": quality.duplicate_keys(daily, ["date", "symbol"]),
            "late_macro_rows": quality.leaking_rows(late),
        }
    )
