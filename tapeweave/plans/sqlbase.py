"""SQL building blocks: the panel tables stated as common table expressions."""

from __future__ import annotations

from tapeweave.operators.macro import CHANGE_WINDOWS, SPREADS
from tapeweave.operators.panel import HORIZONS, minimum_periods
from tapeweave.sources.driver_tables import SERIES

FRAGMENTS: dict[str, tuple[str, tuple[str, ...]]] = {}


#: Fragments that are worked out once.
ONCE: set[str] = set()


def fragment(name: str, sql: str, *needs: str) -> None:
    FRAGMENTS[name] = (sql, needs)


def once(name: str, sql: str, *needs: str) -> None:
    """A fragment that is worked out once and read as often as it is named: sums of doubles, which a second pass adds up in another order."""
    fragment(name, sql, *needs)
    ONCE.add(name)


def with_tables(body: str, *needs: str) -> str:
    """Prefix body with the fragments it needs, each after those it builds on."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for below in FRAGMENTS[name][1]:
            visit(below)
        ordered.append(name)

    for name in needs:
        visit(name)
    if not ordered:
        return body
    tables = ",\n".join(f"{name} AS {'MATERIALIZED ' * (name in ONCE)}({FRAGMENTS[name][0]})" for name in ordered)
    return f"WITH {tables}\n{body}"


def r6(expression: str, name: str) -> str:
    return f"round({expression}, 6) AS {name}"


SYMBOL_TYPE = (
    "CASE WHEN symbol = 'Brand#1' THEN 'etf' WHEN symbol IN ('Brand#2', 'Brand#3') "
    "THEN 'index' ELSE 'stock' END"
)
BRAND_NUMBER = "CAST(regexp_extract(symbol, '([0-9]+)$', 1) AS INTEGER)"
FEED_SYMBOL = "replace(lower(trim(symbol)), '.', '-') || '.us'"

fragment(
    "trades",
    """SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS date,
       l_extendedprice / l_quantity AS price, l_quantity AS quantity,
       l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice
       FROM lineitem JOIN part ON l_partkey = p_partkey""",
)
fragment(
    "bars",
    """SELECT date, symbol,
       first(price ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS open,
       max(price) AS high, min(price) AS low,
       last(price ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS close,
       sum(quantity) AS volume FROM trades GROUP BY date, symbol""",
    "trades",
)
fragment(
    "prices",
    f"""SELECT date, symbol, {FEED_SYMBOL} AS source_symbol, open, high, low, close, volume,
       'lineitem' AS source, false AS adjusted_flag, 'USD' AS currency,
       'EX' || ({BRAND_NUMBER} % 3) AS exchange, {SYMBOL_TYPE} AS asset_type, 'ok' AS quality_flag
       FROM bars""",
    "bars",
)
fragment(
    "cal",
    "SELECT date, row_number() OVER (ORDER BY date) - 1 AS date_idx "
    "FROM (SELECT DISTINCT date FROM bars WHERE close IS NOT NULL)",
    "bars",
)
fragment(
    "man",
    f"""SELECT symbol, source, source_symbol, min(date) AS first_available_date,
       max(date) AS last_available_date, count(*) AS n_rows, any_value(asset_type) AS asset_type,
       any_value(exchange) AS exchange, any_value(currency) AS currency,
       CASE WHEN {BRAND_NUMBER} % 5 = 0 THEN 'confirmed_delisted' ELSE 'unknown' END AS survivorship_status,
       {BRAND_NUMBER} % 2 = 0 AS point_in_time_valid
       FROM prices GROUP BY symbol, source, source_symbol""",
    "prices",
)
fragment(
    "panel",
    """SELECT c.date, m.symbol, p.open, p.high, p.low, p.close, p.volume,
       coalesce(p.source, m.source) AS source, coalesce(p.source_symbol, m.source_symbol) AS source_symbol,
       coalesce(p.asset_type, m.asset_type) AS asset_type, coalesce(p.exchange, m.exchange) AS exchange,
       coalesce(p.currency, m.currency) AS currency,
       m.first_available_date, m.last_available_date, m.survivorship_status,
       CASE WHEN c.date > m.last_available_date AND m.survivorship_status = 'confirmed_delisted'
              THEN 'confirmed_delisted'
            WHEN c.date > m.last_available_date THEN 'after_last_observed'
            WHEN c.date < m.first_available_date THEN 'not_listed_yet'
            WHEN p.close IS NULL THEN 'missing_expected' ELSE 'ok' END AS observation_status
       FROM cal c CROSS JOIN man m LEFT JOIN prices p ON p.date = c.date AND p.symbol = m.symbol""",
    "cal",
    "man",
    "prices",
)
fragment(
    "rets",
    """SELECT *, observation_status = 'ok' AS valid_observation,
       ln(close) - lag(ln(close), 1) OVER w AS return_1d, close * volume AS dollar_volume, """
    + ", ".join(f"ln(close) - lag(ln(close), {h}) OVER w AS return_{h}d" for h in HORIZONS)
    + " FROM panel WINDOW w AS (PARTITION BY symbol ORDER BY date)",
    "panel",
)


def _feature_columns() -> str:
    parts = []
    for h in HORIZONS:
        least, w = minimum_periods(h), f"w{h}"
        parts += [
            f"CASE WHEN count(return_1d) OVER {w} >= {least} THEN stddev_samp(return_1d) OVER {w} * sqrt(252) END AS realized_vol_{h}d",
            f"CASE WHEN count(close) OVER {w} >= {least} THEN close / max(close) OVER {w} - 1 END AS drawdown_{h}d",
            f"CASE WHEN count(close) OVER {w} >= {least} THEN close / avg(close) OVER {w} - 1 END AS ma_distance_{h}d",
            f"CASE WHEN count(return_1d) OVER {w} >= {least} THEN abs(return_{h}d) / (sum(abs(return_1d)) OVER {w} + 1e-12) END AS path_efficiency_{h}d",
        ]
    return ", ".join(parts)


fragment(
    "feats",
    f"SELECT *, {_feature_columns()}, date AS max_source_date_used, date AS available_asof, "
    "false AS uses_future_data FROM rets WINDOW "
    + ", ".join(
        f"w{h} AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN {h - 1} PRECEDING AND CURRENT ROW)"
        for h in HORIZONS
    ),
    "rets",
)
fragment(
    "xs",
    """SELECT date, stddev_samp(return_1d) AS xs_dispersion_1d,
       quantile_cont(return_1d, 0.75) - quantile_cont(return_1d, 0.25) AS xs_iqr_1d,
       sum(CASE WHEN return_1d > 0 THEN 1 ELSE 0 END) / count(*) AS breadth_1d,
       count(DISTINCT symbol) AS n_assets,
       sum(CASE WHEN ma_distance_63d > 0 THEN 1 ELSE 0 END) / count(*) AS pct_above_ma_63d
       FROM feats WHERE asset_type = 'stock' AND valid_observation GROUP BY date""",
    "feats",
)
fragment(
    "defs",
    "SELECT * FROM (VALUES "
    + ", ".join(
        f"('{p}|{s}', '{name}', {lag}, '{group}', {str(lag > 0).lower()})"
        for p, s, name, lag, group in SERIES
    )
    + ") t(series_id, series_name, lag_business_days, series_group, revised_data_flag)",
)
fragment(
    "macro_obs",
    """SELECT o_orderpriority || '|' || o_orderstatus AS series_id, CAST(o_orderdate AS DATE) AS date,
       avg(o_totalprice) / 99991 AS value FROM orders GROUP BY 1, 2""",
)
WEEKDAY = "(isodow(date) - 1)"
ASOF = """CASE WHEN n = 0 THEN CASE WHEN isodow(date) >= 6 THEN date + CAST(8 - isodow(date) AS INTEGER) ELSE date END
       ELSE b + CAST(n + 2 * floor((isodow(b) - 1 + n) / 5) AS INTEGER) END"""
fragment(
    "macro_avail",
    f"""SELECT series_id, date, value, series_name, {ASOF} AS asof_date, revised_data_flag FROM (
       SELECT o.series_id, o.date, o.value, d.series_name, d.lag_business_days AS n, d.revised_data_flag,
       CASE WHEN isodow(o.date) >= 6 THEN o.date - CAST(isodow(o.date) - 5 AS INTEGER) ELSE o.date END AS b
       FROM macro_obs o JOIN defs d USING (series_id))""",
    "macro_obs",
    "defs",
)
fragment(
    "macro_latest",
    """SELECT series_name, asof_date, max(date) AS observation_date, arg_max(value, date) AS value
       FROM macro_avail WHERE value IS NOT NULL GROUP BY 1, 2""",
    "macro_avail",
)
fragment(
    "spine",
    f"""SELECT date, true AS requested FROM cal UNION ALL
       SELECT date, false FROM (SELECT date, row_number() OVER (ORDER BY date DESC) AS back FROM (
         SELECT CAST(unnest(generate_series((SELECT min(date) FROM cal) - INTERVAL 200 DAY,
           (SELECT min(date) FROM cal) - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS date)
         WHERE isodow(date) <= 5) WHERE back <= {max(CHANGE_WINDOWS)}""",
    "cal",
)
fragment(
    "macro_levels",
    "SELECT series_name, date, requested, value AS level, observation_date, asof_date, "
    + ", ".join(
        f"value - lag(value, {k}) OVER w AS change_{k}d" for k in CHANGE_WINDOWS
    )
    + """ FROM (SELECT s.series_name, s.date, s.requested, o.value, o.observation_date, o.asof_date
       FROM (SELECT d.series_name, p.date, p.requested FROM defs d CROSS JOIN spine p) s
       ASOF LEFT JOIN macro_latest o ON s.series_name = o.series_name AND s.date >= o.asof_date)
       WINDOW w AS (PARTITION BY series_name ORDER BY date)""",
    "defs",
    "spine",
    "macro_latest",
)
MACRO_COLUMNS = [
    f"{name}_{suffix}"
    for _, _, name, _, _ in SERIES
    for suffix in ["level", *[f"change_{k}d" for k in CHANGE_WINDOWS]]
]
fragment(
    "macro_wide",
    "SELECT *, "
    + ", ".join(f"{a}_level - {b}_level AS {n}" for n, (a, b) in SPREADS.items())
    + " FROM (SELECT date, "
    + ", ".join(
        f"max(CASE WHEN series_name = '{name}' THEN {suffix} END) AS {name}_{suffix}"
        for _, _, name, _, _ in SERIES
        for suffix in ["level", *[f"change_{k}d" for k in CHANGE_WINDOWS]]
    )
    + ", max(observation_date) AS max_source_date_used, max(asof_date) AS available_asof "
    "FROM macro_levels WHERE requested GROUP BY date)",
    "macro_levels",
)
fragment(
    "features",
    """SELECT xs.*, m.* EXCLUDE (date, max_source_date_used, available_asof),
       greatest(xs.date, m.max_source_date_used) AS max_source_date_used,
       greatest(xs.date, m.available_asof) AS available_asof, false AS uses_future_data
       FROM xs JOIN macro_wide m ON xs.date = m.date""",
    "xs",
    "macro_wide",
)
