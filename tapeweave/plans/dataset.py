"""Queries over the model dataset: manifests, normalization, facts and windowed samples."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeweave.functions.expr import rounded
from tapeweave.operators import blocks, normalize, quality, samples, splits
from tapeweave.plans import tables as t
from tapeweave.plans.registry import query
from tapeweave.plans.sqlbase import fragment, r6, with_tables
from tapeweave.session import scratch_path
from tapeweave.sources import driver_tables as src

W, L, H, P = t.LOOKBACK, t.SAMPLES.patch_len, t.HORIZON, t.SAMPLES.patches

# --- SQL building blocks ---------------------------------------------------------

fragment(
    "elig",
    f"""SELECT s.date, s.date_idx, s.date >= DATE '{t.SAMPLE_START}' AND r.date IS NOT NULL AS sample_eligible
    FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS date_idx FROM cal
      WHERE date >= DATE '{t.CONTEXT_START}') s
    LEFT JOIN (SELECT date FROM bars WHERE symbol = '{src.MARKET_SYMBOL}') r ON s.date = r.date""",
    "cal",
    "bars",
)
WINDOW_VALUES = ", ".join(f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in t.WINDOWS)
fragment("wins", f"SELECT * FROM (VALUES {WINDOW_VALUES}) w(window_name, w_start, w_end)")
fragment(
    "bounds",
    """SELECT window_name, any_value(w_start) AS w_start, any_value(w_end) AS w_end, min(date_idx) AS first_idx,
    max(date_idx) AS last_idx FROM wins JOIN elig ON date BETWEEN w_start AND w_end AND sample_eligible
    GROUP BY window_name""",
    "wins",
    "elig",
)
fragment(
    "dman",
    """SELECT *, validation_sample OR protected_input_lookback OR protected_forward_target AS protected_holdout,
    NOT (validation_sample OR protected_input_lookback OR protected_forward_target) AS train_fact_allowed,
    validation_sample OR protected_input_lookback OR protected_forward_target AS validation_fact_allowed FROM (
    SELECT date_idx, date, sample_eligible, vs AS validation_sample, lb AND NOT vs AS protected_input_lookback,
    fw AND NOT vs AND NOT lb AS protected_forward_target, validation_window_name FROM (
    SELECT e.date_idx, e.date, e.sample_eligible,
    bool_or(e.sample_eligible AND e.date BETWEEN b.w_start AND b.w_end) AS vs,
    bool_or(e.date_idx >= b.first_idx - %(back)d AND e.date_idx < b.first_idx) AS lb,
    bool_or(e.date_idx > b.last_idx AND e.date_idx <= b.last_idx + %(ahead)d) AS fw,
    string_agg(b.window_name, '|' ORDER BY b.window_name)
      FILTER (e.date_idx BETWEEN b.first_idx - %(back)d AND b.last_idx + %(ahead)d) AS validation_window_name
    FROM elig e CROSS JOIN bounds b GROUP BY 1, 2, 3))"""
    % {"back": W - 1, "ahead": H},
    "elig",
    "bounds",
)
fragment(
    "aman",
    f"""SELECT row_number() OVER (ORDER BY m.symbol) - 1 AS asset_id, m.symbol, m.asset_type,
    m.first_available_date, m.last_available_date, coalesce(n, 0) AS valid_train_observations,
    coalesce(n, 0) >= {t.MINIMUM_TRAIN_ROWS} AS trainable,
    CASE WHEN coalesce(n, 0) < {t.MINIMUM_TRAIN_ROWS}
      THEN 'fewer_than_{t.MINIMUM_TRAIN_ROWS}_valid_train_observations' END AS exclusion_reason
    FROM man m LEFT JOIN (SELECT f.symbol, count(*) AS n FROM feats f JOIN dman d ON f.date = d.date
      WHERE d.train_fact_allowed AND f.valid_observation GROUP BY 1) c ON m.symbol = c.symbol""",
    "man",
    "feats",
    "dman",
)


def _value(feature: normalize.Feature) -> str:
    n = f"CAST({feature.name} AS DOUBLE)"
    if feature.transform == "log":
        return f"CASE WHEN {n} > 0 THEN ln({n}) END"
    if feature.transform == "log1p":
        return f"CASE WHEN {n} > -1 THEN ln(1 + {n}) END"
    return n


def _stats_sql(group: str, source: str) -> str:
    low, high = t.WINSORIZE
    return " UNION ALL ".join(
        f"SELECT '{group}' AS input_group, '{f.name}' AS feature_name, count({_value(f)}) AS fit_count, "
        f"quantile_cont({_value(f)}, {low}) AS lower_bound, quantile_cont({_value(f)}, 0.25) AS q25, "
        f"quantile_cont({_value(f)}, 0.5) AS center, quantile_cont({_value(f)}, 0.75) AS q75, "
        f"quantile_cont({_value(f)}, {high}) AS upper_bound FROM {source}"
        for f in t.feature_list(group)
    )


fragment(
    "asset_train",
    """SELECT f.* FROM feats f JOIN dman d ON f.date = d.date JOIN aman a ON f.symbol = a.symbol
    WHERE d.train_fact_allowed AND f.valid_observation AND a.trainable""",
    "feats",
    "dman",
    "aman",
)
fragment(
    "date_train",
    "SELECT f.* FROM features f JOIN dman d ON f.date = d.date WHERE d.train_fact_allowed",
    "features",
    "dman",
)
SCALE = "CASE WHEN q75 - q25 > 0 THEN q75 - q25 ELSE 1.0 END"
for _group, _source in (("asset", "asset_train"), ("market", "date_train"), ("macro", "date_train")):
    fragment(f"{_group}_stats", f"SELECT *, {SCALE} AS scale FROM ({_stats_sql(_group, _source)})", _source)


def _facts_columns(group: str) -> str:
    columns = []
    for f in t.feature_list(group):
        pick = f"(SELECT {{}} FROM {group}_stats WHERE feature_name = '{f.name}')"
        clipped = f"least(greatest({_value(f)}, {pick.format('lower_bound')}), {pick.format('upper_bound')})"
        columns.append(
            f"CAST(coalesce(CASE WHEN ({_value(f)}) IS NOT NULL THEN ({clipped} - {pick.format('center')}) / {pick.format('scale')} END, 0) AS FLOAT) AS {f.name}"
        )
        columns.append(f"({_value(f)}) IS NOT NULL AS {f.name}__valid")
    return ", ".join(columns)


SPLIT = "CASE WHEN d.train_fact_allowed THEN 'train' ELSE 'validation' END AS split"
fragment(
    "asset_facts",
    f"""SELECT {SPLIT}, s.date, d.date_idx, a.asset_id, true AS valid_asset, {_facts_columns('asset')}
    FROM feats s JOIN dman d ON s.date = d.date JOIN aman a ON s.symbol = a.symbol
    WHERE a.trainable AND s.valid_observation""",
    "feats",
    "dman",
    "aman",
    "asset_stats",
)
for _group in ("market", "macro"):
    _valid = " OR ".join(f"({_value(f)}) IS NOT NULL" for f in t.feature_list(_group))
    fragment(
        f"{_group}_facts",
        f"SELECT {SPLIT}, s.date, d.date_idx, {_valid} AS valid_date, {_facts_columns(_group)} "
        "FROM features s JOIN dman d ON s.date = d.date",
        "features",
        "dman",
        f"{_group}_stats",
    )
fragment(
    "reqs",
    """SELECT r.split, r.date_idx AS sample_date_idx, r.date AS sample_date,
    coalesce(c.n, 0) AS n_endpoint_valid_assets, coalesce(r.validation_window_name, '') AS validation_window_name
    FROM (SELECT 'train' AS split, * FROM dman WHERE sample_eligible AND train_fact_allowed
      UNION ALL SELECT 'validation', * FROM dman WHERE validation_sample) r
    LEFT JOIN (SELECT split, date_idx, count(*) AS n FROM asset_facts GROUP BY 1, 2) c
    ON r.split = c.split AND r.date_idx = c.date_idx""",
    "dman",
    "asset_facts",
)
fragment("full_reqs", f"SELECT * FROM reqs WHERE sample_date_idx >= {W - 1}", "reqs")
fragment(
    "days",
    f"""SELECT split, sample_date_idx, sample_date_idx - {W - 1} + i AS date_idx, i AS position,
    i // {L} AS patch, i % {L} AS day_in_patch FROM full_reqs CROSS JOIN range({W}) r(i)""",
    "full_reqs",
)
fragment(
    "date_valid",
    """SELECT s.split, d.date_idx, CASE WHEN s.split = 'train' THEN d.train_fact_allowed ELSE true END AS target_date,
    coalesce(v.ok, false) AS valid_date, coalesce(v.stream, false) AS stream_valid
    FROM dman d CROSS JOIN (VALUES ('train'), ('validation')) s(split) LEFT JOIN (
      SELECT split, date_idx, true AS ok, bool_or(stream) AS stream FROM (
        SELECT split, date_idx, true AS stream FROM market_facts WHERE valid_date
        UNION ALL SELECT split, date_idx, true FROM macro_facts WHERE valid_date
        UNION ALL SELECT split, date_idx, false FROM asset_facts) GROUP BY 1, 2) v
    ON v.split = s.split AND v.date_idx = d.date_idx""",
    "dman",
    "market_facts",
    "macro_facts",
    "asset_facts",
)


def masks_sql(view: str, valid: str, total: str) -> str:
    """Patch masks computed day by day from the lookback of each sample."""
    return f"""SELECT d.split, d.sample_date_idx, d.patch, coalesce(a.valid_assets, 0) AS valid_assets,
    coalesce(a.valid_assets, 0) / {total} AS valid_asset_fraction, d.n > 0 AS patch_context,
    d.n >= {t.SAMPLES.min_dates_in_patch} AND coalesce(a.valid_assets, 0) / {total} >= {t.SAMPLES.min_asset_fraction}
      AND d.targets = {L} AS patch_target_eligible
    FROM (SELECT w.split, w.sample_date_idx, w.patch, count(*) FILTER ({valid}) AS n,
        count(*) FILTER (v.target_date) AS targets
      FROM days w JOIN date_valid v ON w.split = v.split AND w.date_idx = v.date_idx
      LEFT JOIN (SELECT DISTINCT x.split, x.sample_date_idx, f.date_idx FROM {view} x JOIN asset_facts f
        ON x.split = f.split AND x.asset_id = f.asset_id
        AND f.date_idx BETWEEN x.sample_date_idx - {W - 1} AND x.sample_date_idx) s
      ON s.split = w.split AND s.sample_date_idx = w.sample_date_idx AND s.date_idx = w.date_idx
      GROUP BY 1, 2, 3) d
    LEFT JOIN (SELECT split, sample_date_idx, patch, count(*) AS valid_assets FROM (
        SELECT x.split, x.sample_date_idx, (f.date_idx - x.sample_date_idx + {W - 1}) // {L} AS patch, x.asset_id
        FROM {view} x JOIN asset_facts f ON x.split = f.split AND x.asset_id = f.asset_id
        AND f.date_idx BETWEEN x.sample_date_idx - {W - 1} AND x.sample_date_idx
        GROUP BY 1, 2, 3, 4 HAVING count(*) >= {t.SAMPLES.min_days_per_asset_patch}) GROUP BY 1, 2, 3) a
    ON d.split = a.split AND d.sample_date_idx = a.sample_date_idx AND d.patch = a.patch"""


fragment("all_view", "SELECT r.split, r.sample_date_idx, a.asset_id FROM full_reqs r CROSS JOIN aman a", "full_reqs", "aman")
fragment(
    "masks",
    masks_sql("all_view", "v.valid_date", "(SELECT count(*) FROM aman)"),
    "days",
    "date_valid",
    "all_view",
    "asset_facts",
    "aman",
)

# --- I: manifests --------------------------------------------------------------------


@query("i1_date_spine", with_tables("SELECT date, CAST(date_idx AS INTEGER) AS date_idx FROM elig", "elig"))
def i1_date_spine(spark: SparkSession, sf: str) -> DataFrame:
    return splits.date_spine(t.calendar(spark, sf), t.CONTEXT_START)


@query("i2_sample_eligible", with_tables("SELECT date, sample_eligible FROM elig", "elig"))
def i2_sample_eligible(spark: SparkSession, sf: str) -> DataFrame:
    return t.eligible_dates(spark, sf).select("date", "sample_eligible")


@query(
    "i3_window_bounds",
    with_tables("SELECT window_name, first_idx, last_idx FROM bounds", "bounds"),
)
def i3_window_bounds(spark: SparkSession, sf: str) -> DataFrame:
    bounds = splits.window_bounds(t.eligible_dates(spark, sf), t.WINDOWS)
    splits.require_windows(bounds, t.WINDOWS)
    return bounds


REGIONS = ["validation_sample", "protected_input_lookback", "protected_forward_target"]


@query("i4_protected_regions", with_tables(f"SELECT date, {', '.join(REGIONS)} FROM dman", "dman"))
def i4_protected_regions(spark: SparkSession, sf: str) -> DataFrame:
    return splits.date_manifest(t.eligible_dates(spark, sf), t.WINDOWS, W, H).select("date", *REGIONS)


PERMISSIONS = ["protected_holdout", "train_fact_allowed", "validation_fact_allowed", "validation_window_name"]


@query("i5_date_permissions", with_tables(f"SELECT date, {', '.join(PERMISSIONS)} FROM dman", "dman"))
def i5_date_permissions(spark: SparkSession, sf: str) -> DataFrame:
    return t.date_manifest(spark, sf).select("date", *PERMISSIONS)


ASSETS = [
    "symbol", "asset_type", "first_available_date", "last_available_date", "valid_train_observations", "trainable",
    "exclusion_reason",
]


@query(
    "i6_asset_manifest",
    with_tables(f"SELECT CAST(asset_id AS INTEGER) AS asset_id, {', '.join(ASSETS)} FROM aman", "aman"),
)
def i6_asset_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return t.asset_manifest(spark, sf).select("asset_id", *ASSETS)


@query(
    "i7_feature_manifest",
    with_tables(
        " UNION ALL ".join(
            f"SELECT '{g}' AS input_group, {i} AS feature_index, '{n}' AS feature_name, '{k}' AS transform, "
            f"(SELECT count({n}) FROM {'feats' if g == 'asset' else 'features'}) AS known_values"
            for g, i, n, _, _, k in splits.feature_rows(t.FAMILIES, t.TRANSFORMS)
        ),
        "feats",
        "features",
    ),
)
def i7_feature_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """The configured features next to how many known values each has in its source table."""
    manifest = splits.feature_manifest(spark, t.FAMILIES, t.TRANSFORMS)

    def known(df: DataFrame, names: list[str]) -> DataFrame:
        counted = df.agg(*[F.count(n).alias(n) for n in names])
        return counted.unpivot([], names, "feature_name", "known_values")

    counts = known(t.panel_table(spark, sf), t.feature_names("asset")).unionByName(
        known(t.features_table(spark, sf), [*t.feature_names("market"), *t.feature_names("macro")])
    )
    return manifest.join(counts, "feature_name").select(
        "input_group", "feature_index", "feature_name", "transform", "known_values"
    )


# --- J: normalization -------------------------------------------------------------------

GROUP_TABLES = {"asset": "feats", "market": "features", "macro": "features"}


#: What a row of each group's table is keyed by; date groups have no symbol.
SYMBOL = {"asset": "symbol", "market": "CAST(NULL AS VARCHAR)", "macro": "CAST(NULL AS VARCHAR)"}


def group_rows(spark: SparkSession, sf: str, group: str) -> DataFrame:
    """The rows that a group's features are taken from, with a symbol that is null for date groups."""
    if group == "asset":
        return t.panel_table(spark, sf)
    return t.features_table(spark, sf).withColumn("symbol", F.lit(None).cast("string"))


def over_groups(one: Callable[[str], DataFrame]) -> DataFrame:
    """The rows of one(group) of all groups, with input_group."""
    parts = [one(group).select(F.lit(group).alias("input_group"), "*") for group in GROUP_TABLES]
    return reduce(DataFrame.unionByName, parts)


@query(
    "j1_feature_validity",
    with_tables(
        " UNION ALL ".join(
            f"SELECT '{g}' AS input_group, {SYMBOL[g]} AS symbol, '{f.name}' AS feature_name, "
            f"count(*) FILTER (({_value(f)}) IS NOT NULL) AS valid_count FROM {table} GROUP BY ALL"
            for g, table in GROUP_TABLES.items()
            for f in t.feature_list(g)
        ),
        "feats",
        "features",
    ),
)
def j1_feature_validity(spark: SparkSession, sf: str) -> DataFrame:
    """How many rows of each symbol (asset group) or of all dates have a valid value, by feature."""

    def one(group: str) -> DataFrame:
        names = [f.name for f in t.feature_list(group)]
        valid = [F.count_if(normalize.is_valid(f)).alias(f.name) for f in t.feature_list(group)]
        counted = group_rows(spark, sf, group).groupBy("symbol").agg(*valid)
        return counted.unpivot(["symbol"], names, "feature_name", "valid_count")

    return over_groups(one)


@query(
    "j2_transformed_values",
    with_tables(
        " UNION ALL ".join(
            f"SELECT '{g}' AS input_group, date, {SYMBOL[g]} AS symbol, '{f.name}' AS feature_name, {r6(_value(f), 'value')} "
            f"FROM {table}{' WHERE valid_observation' if g == 'asset' else ''}"
            for g, table in GROUP_TABLES.items()
            for f in t.feature_list(g)
        ),
        "feats",
        "features",
    ),
)
def j2_transformed_values(spark: SparkSession, sf: str) -> DataFrame:
    """Transformed values of every feature of all groups, one row a value."""

    def one(group: str) -> DataFrame:
        rows = group_rows(spark, sf, group)
        rows = rows.filter("valid_observation") if group == "asset" else rows
        names = [f.name for f in t.feature_list(group)]
        values = [normalize.transformed(f).cast("double").alias(f.name) for f in t.feature_list(group)]
        return rows.select("date", "symbol", *values).unpivot(["date", "symbol"], names, "feature_name", "value")

    return rounded(over_groups(one))


def _fit_sql(columns: list[str]) -> str:
    picked = ", ".join("fit_count" if c == "fit_count" else r6(c, c) for c in columns)
    return with_tables(
        " UNION ALL ".join(f"SELECT input_group, feature_name, {picked} FROM {g}_stats" for g in GROUP_TABLES),
        *[f"{g}_stats" for g in GROUP_TABLES],
    )


def all_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows = None
    for group in GROUP_TABLES:
        one = t.fitted(spark, sf, group).select(F.lit(group).alias("input_group"), "*")
        rows = one if rows is None else rows.unionByName(one)
    return rows


FIT = ["fit_count", "lower_bound", "center", "upper_bound"]


@query("j3_fit_normalization", _fit_sql(FIT))
def j3_fit_normalization(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(all_stats(spark, sf).select("input_group", "feature_name", *FIT))


@query("j4_robust_scale", _fit_sql(["scale"]))
def j4_robust_scale(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(all_stats(spark, sf).select("input_group", "feature_name", "scale"))


def fact_columns(group: str) -> list[str]:
    return [c for name in t.feature_names(group) for c in (name, f"{name}__valid")]


def facts_out(df: DataFrame, keys: list[str], group: str) -> DataFrame:
    """Facts with their float values as rounded doubles."""
    values = [
        F.round(F.col(c).cast("double"), 6).alias(c) if not c.endswith("__valid") else F.col(c)
        for c in fact_columns(group)
    ]
    return df.select(*keys, *values)


def facts_sql(group: str, keys: list[str], source: str | None = None) -> str:
    values = ", ".join(
        c if c.endswith("__valid") else f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in fact_columns(group)
    )
    ids = ", ".join(f"CAST({k} AS INTEGER) AS {k}" if k in ("date_idx", "asset_id") else k for k in keys)
    return f"SELECT {ids}, {values} FROM {source or group + '_facts'}"


def long_facts(df: DataFrame, keys: list[str], group: str) -> DataFrame:
    """Facts as one row a value: feature_name, value, valid."""
    each = [
        F.struct(F.lit(n).alias("feature_name"), F.round(F.col(n).cast("double"), 6).alias("value"), F.col(f"{n}__valid").alias("valid"))
        for n in t.feature_names(group)
    ]
    return df.select(*keys, F.explode(F.array(*each)).alias("_fact")).select(*keys, "_fact.*")


def long_facts_sql(groups: list[str], keys: list[str], keyless: dict[str, str] = {}) -> str:
    ids = {k: f"CAST({k} AS INTEGER) AS {k}" if k in ("date_idx", "asset_id") else k for k in keys}
    return with_tables(
        " UNION ALL ".join(
            f"SELECT '{g}' AS input_group, {', '.join(keyless.get(k, ids[k]) if g != 'asset' else ids[k] for k in keys)}, "
            f"'{n}' AS feature_name, round(CAST({n} AS DOUBLE), 6) AS value, {n}__valid AS valid FROM {g}_facts"
            for g in groups
            for n in t.feature_names(g)
        ),
        *[f"{g}_facts" for g in groups],
    )


@query(
    "j5_normalized_values",
    long_facts_sql(list(GROUP_TABLES), ["split", "date", "date_idx", "asset_id"], {"asset_id": "CAST(NULL AS INTEGER) AS asset_id"}),
)
def j5_normalized_values(spark: SparkSession, sf: str) -> DataFrame:
    """Normalized values of all groups, one row a value; date groups have no asset."""

    def one(group: str) -> DataFrame:
        facts = t.build_facts(spark, sf, group)
        facts = facts if group == "asset" else facts.withColumn("asset_id", F.lit(None).cast("int"))
        return long_facts(facts, ["split", "date", "date_idx", "asset_id"], group)

    return over_groups(one)


# --- K: facts -------------------------------------------------------------------------------

ASSET_KEYS = ["split", "date", "date_idx", "asset_id", "valid_asset"]
DATE_KEYS = ["split", "date", "date_idx", "valid_date"]


@query("k1_asset_facts", with_tables(facts_sql("asset", ASSET_KEYS), "asset_facts"))
def k1_asset_facts(spark: SparkSession, sf: str) -> DataFrame:
    return facts_out(t.build_facts(spark, sf, "asset"), ASSET_KEYS, "asset")


@query("k2_date_facts", long_facts_sql(["market", "macro"], DATE_KEYS))
def k2_date_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Market and macro facts, one row a value."""
    parts = [
        long_facts(t.build_facts(spark, sf, g), DATE_KEYS, g).select(F.lit(g).alias("input_group"), "*") for g in ("market", "macro")
    ]
    return parts[0].unionByName(parts[1])


@query(
    "k3_split_fanout",
    with_tables(
        " UNION ALL ".join(
            f"SELECT '{g}' AS input_group, split, count(*) AS row_count, min(date) AS first_date, max(date) AS last_date "
            f"FROM {g}_facts GROUP BY split"
            for g in GROUP_TABLES
        ),
        *[f"{g}_facts" for g in GROUP_TABLES],
    ),
)
def k3_split_fanout(spark: SparkSession, sf: str) -> DataFrame:
    """The six fact files as written, one folder per split, read back by split."""
    root = scratch_path(spark, "facts")
    rows = None
    for group, facts in t.FACTS.items():
        normalize.write_facts(facts(spark, sf), f"{root}/{group}")
        one = (
            spark.read.parquet(f"{root}/{group}")
            .groupBy("split")
            .agg(
                F.count(F.lit(1)).alias("row_count"),
                F.min("date").alias("first_date"),
                F.max("date").alias("last_date"),
            )
            .select(F.lit(group).alias("input_group"), "*")
        )
        rows = one if rows is None else rows.unionByName(one)
    return rows


@query(
    "k4_manifest_contract",
    with_tables(
        """SELECT bool_and(NOT (train_fact_allowed AND validation_fact_allowed)) AS permissions_disjoint,
        bool_and(p <= 1) AS protections_exclusive, bool_and(protected_holdout = (p > 0)) AS holdout_is_union,
        bool_and(protected_holdout = NOT train_fact_allowed) AS holdout_is_not_train FROM (SELECT *,
        CAST(validation_sample AS INT) + CAST(protected_input_lookback AS INT) + CAST(protected_forward_target AS INT) AS p
        FROM dman)""",
        "dman",
    ),
)
def k4_manifest_contract(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.manifest_contract(t.date_manifest(spark, sf))


FACT_KEYS = {"asset": ["split", "date_idx", "asset_id"], "market": ["split", "date_idx"], "macro": ["split", "date_idx"]}


@query(
    "k5_fact_key_checks",
    with_tables(
        " UNION ALL ".join(
            f"""SELECT 'duplicate_{g}_keys' AS check_name, count(*) AS offending_rows FROM
              (SELECT 1 FROM {g}_facts GROUP BY {', '.join(keys)} HAVING count(*) > 1)
            UNION ALL SELECT 'shared_{g}_split_dates', count(*) FROM (
              SELECT DISTINCT date FROM {g}_facts WHERE split = 'train' INTERSECT
              SELECT DISTINCT date FROM {g}_facts WHERE split = 'validation')"""
            for g, keys in FACT_KEYS.items()
        ),
        *[f"{g}_facts" for g in FACT_KEYS],
    ),
)
def k5_fact_key_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Repeated keys and dates in both splits, for the facts of each group."""
    checks = {}
    for group, keys in FACT_KEYS.items():
        facts = t.FACTS[group](spark, sf)
        checks[f"duplicate_{group}_keys"] = quality.duplicate_keys(facts, keys)
        checks[f"shared_{group}_split_dates"] = normalize.shared_split_dates(facts)
    return quality.check_counts(checks)


@query(
    "k6_quality_report",
    with_tables(
        "SELECT 'asset_type' AS section, asset_type AS item, count(*) AS row_count FROM aman WHERE trainable GROUP BY 2 "
        "UNION ALL SELECT 'trainable', CAST(trainable AS VARCHAR), count(*) FROM aman GROUP BY 2 "
        + "".join(
            f"UNION ALL SELECT 'date_flag', '{c}', count(*) FILTER ({c}) FROM dman "
            for c in (*REGIONS, "train_fact_allowed")
        )
        + "".join(
            f"UNION ALL SELECT 'facts', '{g}.' || split, count(*) FROM {g}_facts GROUP BY 2 " for g in GROUP_TABLES
        ),
        "aman",
        "dman",
        *[f"{g}_facts" for g in GROUP_TABLES],
    ),
)
def k6_quality_report(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.quality_report(
        t.date_manifest(spark, sf),
        t.asset_manifest(spark, sf),
        {g: facts(spark, sf) for g, facts in t.FACTS.items()},
    )


# --- L: samples ---------------------------------------------------------------------------------

REQUEST_SQL = (
    "SELECT split, CAST(sample_date_idx AS INTEGER) AS sample_date_idx, sample_date, n_endpoint_valid_assets, "
    "validation_window_name FROM "
)


@query("l1_request_index", with_tables(REQUEST_SQL + "reqs", "reqs"))
def l1_request_index(spark: SparkSession, sf: str) -> DataFrame:
    return t.all_requests(spark, sf)


@query("l2_short_history", with_tables(REQUEST_SQL + f"reqs WHERE sample_date_idx < {W - 1}", "reqs"))
def l2_short_history(spark: SparkSession, sf: str) -> DataFrame:
    return samples.short_history(t.all_requests(spark, sf), t.SAMPLES)


@query(
    "l3_dense_panel",
    with_tables(
        "SELECT s.split, CAST(d.date_idx AS INTEGER) AS date_idx, CAST(a.asset_id AS INTEGER) AS asset_id, "
        "coalesce(f.valid_asset, false) AS valid_asset, "
        + ", ".join(
            f"round(coalesce(CAST(f.{n} AS DOUBLE), 0), 6) AS {n}, coalesce(f.{n}__valid, false) AS {n}__valid"
            for n in t.feature_names("asset")
        )
        + " FROM dman d CROSS JOIN aman a CROSS JOIN (VALUES ('train'), ('validation')) s(split) LEFT JOIN asset_facts f "
        "ON f.split = s.split AND f.date_idx = d.date_idx AND f.asset_id = a.asset_id",
        "dman",
        "aman",
        "asset_facts",
    ),
)
def l3_dense_panel(spark: SparkSession, sf: str) -> DataFrame:
    dense = samples.dense_panel(
        t.asset_facts(spark, sf),
        t.date_manifest(spark, sf),
        t.asset_manifest(spark, sf),
        t.feature_names("asset"),
        "valid_asset",
    )
    return facts_out(dense, ["split", "date_idx", "asset_id", "valid_asset"], "asset")


def dense_stream(group: str) -> None:
    values = ", ".join(
        f"round(coalesce(CAST(f.{n} AS DOUBLE), 0), 6) AS {n}, coalesce(f.{n}__valid, false) AS {n}__valid"
        for n in t.feature_names(group)
    )
    sql = with_tables(
        "SELECT s.split, CAST(d.date_idx AS INTEGER) AS date_idx, coalesce(f.valid_date, false) AS valid_date, "
        f"{values} FROM dman d CROSS JOIN (VALUES ('train'), ('validation')) s(split) LEFT JOIN {group}_facts f "
        "ON f.split = s.split AND f.date_idx = d.date_idx",
        "dman",
        f"{group}_facts",
    )

    @query(f"l3_dense_{group}", sql)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        """Every position of both splits for an input stream without assets."""
        facts, dates = t.FACTS[group](spark, sf), t.date_manifest(spark, sf)
        dense = samples.dense_panel(facts, dates, None, t.feature_names(group), "valid_date")
        return facts_out(dense, ["split", "date_idx", "valid_date"], group)


dense_stream("market")
dense_stream("macro")


@query(
    "l4_lookback_window",
    with_tables(
        """SELECT d.split, CAST(d.sample_date_idx AS INTEGER) AS sample_date_idx, count(*) AS fact_rows,
        count(DISTINCT f.asset_id) AS assets, CAST(min(f.date_idx) AS INTEGER) AS first_idx,
        CAST(max(f.date_idx) AS INTEGER) AS last_idx, round(sum(CAST(f.close AS DOUBLE)), 4) AS close_sum
        FROM days d JOIN asset_facts f ON d.split = f.split AND d.date_idx = f.date_idx GROUP BY 1, 2""",
        "days",
        "asset_facts",
    ),
)
def l4_lookback_window(spark: SparkSession, sf: str) -> DataFrame:
    """Facts gathered per sample; the gather is an equality join on positions."""
    rows = samples.lookback_facts(t.requests(spark, sf), t.asset_facts(spark, sf), t.SAMPLES)
    return rows.groupBy(*samples.SAMPLE).agg(
        F.count(F.lit(1)).alias("fact_rows"),
        F.countDistinct("asset_id").alias("assets"),
        F.min("date_idx").alias("first_idx"),
        F.max("date_idx").alias("last_idx"),
        F.round(F.sum(F.col("close").cast("double")), 4).alias("close_sum"),
    )


@query(
    "l5_patches",
    with_tables(
        """SELECT d.split, CAST(d.sample_date_idx AS INTEGER) AS sample_date_idx, CAST(d.patch AS INTEGER) AS patch,
        CAST(min(d.date_idx) AS INTEGER) AS first_idx, CAST(max(d.date_idx) AS INTEGER) AS last_idx,
        string_agg(CASE WHEN v.valid_date THEN '1' ELSE '0' END, '' ORDER BY d.day_in_patch) AS day_mask
        FROM days d JOIN date_valid v ON d.split = v.split AND d.date_idx = v.date_idx GROUP BY 1, 2, 3""",
        "days",
        "date_valid",
    ),
)
def l5_patches(spark: SparkSession, sf: str) -> DataFrame:
    days = samples.lookback_facts(t.requests(spark, sf), t.validity(spark, sf), t.SAMPLES)
    ordered = F.array_sort(F.collect_list(F.struct("day_in_patch", "date_idx", "valid_date")))
    return (
        days.groupBy(*samples.SAMPLE, "patch")
        .agg(ordered.alias("d"))
        .select(
            *samples.SAMPLE,
            "patch",
            F.element_at("d", 1)["date_idx"].alias("first_idx"),
            F.element_at("d", -1)["date_idx"].alias("last_idx"),
            F.array_join(F.transform("d", lambda x: F.when(x["valid_date"], "1").otherwise("0")), "").alias("day_mask"),
        )
    )


VIEW_SQL = "SELECT split, CAST(sample_date_idx AS INTEGER) AS sample_date_idx, CAST(asset_id AS INTEGER) AS asset_id FROM "


@query("l6_all_assets_view", with_tables(VIEW_SQL + "all_view", "all_view"))
def l6_all_assets_view(spark: SparkSession, sf: str) -> DataFrame:
    return samples.all_assets_view(t.requests(spark, sf), t.asset_manifest(spark, sf))


FIXED_K, RANDOM_K, SEED, EPOCH = 5, 4, t.SAMPLES.seed, 3


def ranked_view_sql(key: str, k: int) -> str:
    return f"""SELECT split, sample_date_idx, asset_id FROM (SELECT r.split, r.sample_date_idx, f.asset_id,
    row_number() OVER (PARTITION BY r.split, r.sample_date_idx ORDER BY sha256({key}), f.asset_id) AS n
    FROM full_reqs r JOIN asset_facts f ON r.split = f.split AND r.sample_date_idx = f.date_idx) WHERE n <= {k}"""


def fixed_key(k: int, view: int = 0) -> str:
    return f"'{t.DATASET_VERSION}|' || CAST(r.sample_date AS VARCHAR) || '|{view}|{k}|' || f.asset_id"


fragment("fixed_view", ranked_view_sql(fixed_key(FIXED_K), FIXED_K), "full_reqs", "asset_facts")
fragment(
    "random_view",
    ranked_view_sql(
        f"'{SEED}|' || r.sample_date_idx || '|' || CASE WHEN r.split = 'train' THEN '{EPOCH}' ELSE '0' END "
        "|| '|0|' || f.asset_id",
        RANDOM_K,
    ),
    "full_reqs",
    "asset_facts",
)


def fixed_view(spark: SparkSession, sf: str, k: int = FIXED_K, view: int = 0) -> DataFrame:
    return samples.fixed_view(t.requests(spark, sf), t.asset_facts(spark, sf), t.DATASET_VERSION, k, view, "keep")


@query("l7_fixed_view", with_tables(VIEW_SQL + "fixed_view", "fixed_view"))
def l7_fixed_view(spark: SparkSession, sf: str) -> DataFrame:
    return fixed_view(spark, sf)


@query(
    "l7_short_views",
    with_tables(
        f"SELECT split, CAST(sample_date_idx AS INTEGER) AS sample_date_idx, n_endpoint_valid_assets, {FIXED_K} AS view_size "
        f"FROM full_reqs WHERE n_endpoint_valid_assets < {FIXED_K}",
        "full_reqs",
    ),
)
def l7_short_views(spark: SparkSession, sf: str) -> DataFrame:
    """Samples that cannot fill a view of FIXED_K assets: the views refuse them by default, the queries keep them."""
    return samples.short_views(t.requests(spark, sf), t.asset_facts(spark, sf), FIXED_K)


@query("l8_random_view", with_tables(VIEW_SQL + "random_view", "random_view"))
def l8_random_view(spark: SparkSession, sf: str) -> DataFrame:
    return samples.random_view(t.requests(spark, sf), t.asset_facts(spark, sf), RANDOM_K, SEED, EPOCH, short="keep")


MASK_SQL = (
    "SELECT split, CAST(sample_date_idx AS INTEGER) AS sample_date_idx, CAST(patch AS INTEGER) AS patch, valid_assets, "
    "round(valid_asset_fraction, 6) AS valid_asset_fraction, patch_context, patch_target_eligible FROM "
)


@query("l9_patch_masks", with_tables(MASK_SQL + "masks", "masks"))
def l9_patch_masks(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(
        samples.patch_masks(
            t.requests(spark, sf),
            t.asset_facts(spark, sf),
            t.validity(spark, sf),
            t.asset_manifest(spark, sf),
            t.SAMPLES,
        )
    )


def stream_validity(spark: SparkSession, sf: str) -> DataFrame:
    """Market and macro validity alone."""
    return samples.date_validity(
        t.date_manifest(spark, sf),
        t.asset_facts(spark, sf).filter("false"),
        t.market_facts(spark, sf),
        t.macro_facts(spark, sf),
    )


@query(
    "l9_fixed_view_masks",
    with_tables(
        MASK_SQL + f"({masks_sql('fixed_view', 'v.stream_valid OR s.date_idx IS NOT NULL', str(FIXED_K))})",
        "days",
        "date_valid",
        "fixed_view",
        "asset_facts",
    ),
)
def l9_fixed_view_masks(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(
        samples.view_patch_masks(
            t.requests(spark, sf),
            fixed_view(spark, sf),
            t.asset_facts(spark, sf),
            stream_validity(spark, sf),
            t.SAMPLES,
            FIXED_K,
        )
    )


@query(
    "l10_date_validity",
    with_tables(
        "SELECT split, CAST(date_idx AS INTEGER) AS date_idx, valid_date, target_date FROM date_valid", "date_valid"
    ),
)
def l10_date_validity(spark: SparkSession, sf: str) -> DataFrame:
    return t.validity(spark, sf)


MIN_MASKED = t.SAMPLES.min_masked


@query(
    "l11_viable_samples",
    with_tables(
        f"""SELECT split, CAST(sample_date_idx AS INTEGER) AS sample_date_idx,
        count(*) FILTER (patch_target_eligible) AS eligible_patches, count(*) FILTER (patch_context) AS context_patches,
        count(*) FILTER (patch_target_eligible) >= {MIN_MASKED} AND count(*) FILTER (patch_context) > {MIN_MASKED} AS viable
        FROM masks GROUP BY 1, 2""",
        "masks",
    ),
)
def l11_viable_samples(spark: SparkSession, sf: str) -> DataFrame:
    return samples.viable_samples(t.patch_masks(spark, sf), t.SAMPLES)


@t.layer
def masked_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Viable samples with their drawn target blocks."""
    masks = t.patch_masks(spark, sf)
    viable = samples.viable_samples(masks, t.SAMPLES).filter("viable").select(*samples.SAMPLE)
    return blocks.target_masks(samples.mask_arrays(masks).join(viable, samples.SAMPLE), t.SAMPLES, EPOCH)


def bits(name: str):
    return F.array_join(F.transform(name, lambda m: F.when(m, "1").otherwise("0")), "").alias(name)


@query("l12_target_blocks")
def l12_target_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return masked_samples(spark, sf).select(*samples.SAMPLE, bits("target"), bits("visible"), bits("eligible"))


@query(
    "l12_target_rules",
    with_tables(
        f"""SELECT split, CAST(sample_date_idx AS INTEGER) AS sample_date_idx, true AS inside_eligible, true AS count_in_bounds,
        true AS visible_is_rest_of_context, true AS context_left FROM masks GROUP BY 1, 2
        HAVING count(*) FILTER (patch_target_eligible) >= {MIN_MASKED} AND count(*) FILTER (patch_context) > {MIN_MASKED}""",
        "masks",
    ),
)
def l12_target_rules(spark: SparkSession, sf: str) -> DataFrame:
    """What every draw must keep, whatever its random numbers."""
    drawn = F.size(F.filter("target", lambda m: m))
    outside = F.exists(F.zip_with("target", "eligible", lambda a, b: a & ~b), lambda m: m)
    rest = F.zip_with("context", "target", lambda a, b: a & ~b)
    return masked_samples(spark, sf).select(
        *samples.SAMPLE,
        (~outside).alias("inside_eligible"),
        drawn.between(MIN_MASKED, t.SAMPLES.max_masked).alias("count_in_bounds"),
        (F.col("visible") == rest).alias("visible_is_rest_of_context"),
        F.exists("visible", lambda m: m).alias("context_left"),
    )


@query("l13_padded_target_ids")
def l13_padded_target_ids(spark: SparkSession, sf: str) -> DataFrame:
    padded = samples.padded_ids(masked_samples(spark, sf))
    return padded.select(
        *samples.SAMPLE, F.array_join("target_patch_ids", ",").alias("target_patch_ids"), bits("target_patch_id_mask")
    )


@query(
    "l13_padded_eligible_ids",
    with_tables(
        """SELECT split, CAST(sample_date_idx AS INTEGER) AS sample_date_idx,
        array_to_string(list_concat(ids, list_transform(range(longest - len(ids)), lambda i: -1)), ',') AS target_patch_ids,
        repeat('1', len(ids)) || repeat('0', CAST(longest - len(ids) AS INTEGER)) AS target_patch_id_mask FROM (
          SELECT *, max(len(ids)) OVER () AS longest FROM (
            SELECT split, sample_date_idx, coalesce(list(patch ORDER BY patch) FILTER (patch_target_eligible), []) AS ids
            FROM masks GROUP BY 1, 2))""",
        "masks",
    ),
)
def l13_padded_eligible_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Padding applied to each sample's eligible patches."""
    packed = samples.packed_patches(samples.mask_arrays(t.patch_masks(spark, sf)), "eligible")
    padded = samples.padded_ids(packed, "visible_patches")
    return padded.select(
        *samples.SAMPLE, F.array_join("target_patch_ids", ",").alias("target_patch_ids"), bits("target_patch_id_mask")
    )


def dropout_sql(epoch: int) -> str:
    parts = []
    for group in GROUP_TABLES:
        names = t.feature_names(group)
        drop = min(int(len(names) * t.SAMPLES.feature_dropout_rate), len(names) - 1)
        values = ", ".join(f"('{n}')" for n in names)
        parts.append(
            f"SELECT '{group}' AS input_group, feature_name FROM (SELECT feature_name, row_number() OVER "
            f"(ORDER BY sha256('{SEED}|{group}|' || feature_name)) - 1 AS slot FROM (VALUES {values}) v(feature_name)) "
            f"WHERE ((slot - {epoch}) % {len(names)} + {len(names)}) % {len(names)} < {drop}"
        )
    return " UNION ALL ".join(parts)


def feature_dropout(group: str, name: str) -> None:
    names = t.feature_names(group)
    off = f"SELECT feature_name FROM ({dropout_sql(EPOCH)}) WHERE input_group = '{group}'"
    left = ", ".join(
        f"count(*) FILTER ({n}__valid AND NOT (split = 'train' AND '{n}' IN ({off}))) AS {n}" for n in names
    )

    @query(name, with_tables(f"SELECT split, {left} FROM {group}_facts GROUP BY split", f"{group}_facts"))
    def run(spark: SparkSession, sf: str) -> DataFrame:
        """Valid cells left per feature of a group after the epoch's dropout."""
        manifest = splits.feature_manifest(spark, t.FAMILIES, t.TRANSFORMS).filter(F.col("input_group") == group)
        dropped = [r.feature_name for r in samples.dropped_features(manifest, t.SAMPLES, EPOCH).collect()]
        kept = samples.apply_dropout(t.FACTS[group](spark, sf), dropped)
        return kept.groupBy("split").agg(*[F.count_if(f"{n}__valid").alias(n) for n in names])


feature_dropout("macro", "l14_feature_dropout")
feature_dropout("asset", "l14_asset_feature_dropout")
feature_dropout("market", "l14_market_feature_dropout")


def dense_long(spark: SparkSession, sf: str) -> list[DataFrame]:
    dates, assets = t.date_manifest(spark, sf), t.asset_manifest(spark, sf)
    parts = []
    for group, facts in t.FACTS.items():
        names = t.feature_names(group)
        valid = "valid_asset" if group == "asset" else "valid_date"
        dense = samples.dense_panel(facts(spark, sf), dates, assets if group == "asset" else None, names, valid)
        parts.append(samples.long_facts(dense, names, group, valid))
    return parts


def long_sql(group: str, names: list[str]) -> str:
    asset = group == "asset"
    valid = "valid_asset" if asset else "valid_date"
    return " UNION ALL ".join(
        f"SELECT '{group}' AS input_group, split, date_idx, {'asset_id' if asset else 'NULL::BIGINT'} AS asset_id, "
        f"{valid} AS row_valid, {i} AS feature_index, '{n}' AS feature_name, {n} AS value, {n}__valid AS feature_valid "
        f"FROM {group}_facts"
        for i, n in enumerate(names)
    )


def snapshot_sql() -> str:
    parts = []
    for group in GROUP_TABLES:
        asset = group == "asset"
        names = ", ".join(f"({i}, '{n}')" for i, n in enumerate(t.feature_names(group)))
        ids = "(SELECT asset_id FROM aman)" if asset else "(SELECT NULL::BIGINT AS asset_id)"
        on = "AND l.asset_id = a.asset_id" if asset else ""
        parts.append(
            f"SELECT '{group}' AS input_group, d.split, CAST(d.sample_date_idx AS INTEGER) AS sample_date_idx, "
            f"CAST(d.date_idx AS INTEGER) AS date_idx, CAST(d.position AS INTEGER) AS position, CAST(d.patch AS INTEGER) AS patch, "
            f"CAST(d.day_in_patch AS INTEGER) AS day_in_patch, CAST(a.asset_id AS INTEGER) AS asset_id, "
            f"f.feature_index, f.feature_name, round(coalesce(CAST(l.value AS DOUBLE), 0), 6) AS value, "
            f"coalesce(l.feature_valid, false) AS feature_valid, coalesce(l.row_valid, false) AS row_valid, "
            f"m.patch_context, m.patch_target_eligible "
            f"FROM days d CROSS JOIN {ids} a "
            f"CROSS JOIN (VALUES {names}) f(feature_index, feature_name) "
            f"LEFT JOIN {group}_long l ON l.split = d.split AND l.date_idx = d.date_idx AND l.feature_name = f.feature_name {on} "
            f"JOIN masks m ON m.split = d.split AND m.sample_date_idx = d.sample_date_idx AND m.patch = d.patch"
        )
    return f"""SELECT input_group, split, sample_date_idx, feature_name, count(*) AS cell_count, count(DISTINCT asset_id) AS asset_count,
    min(date_idx) AS first_date_idx, max(date_idx) AS last_date_idx, count(*) FILTER (feature_valid) AS feature_valid_count,
    count(*) FILTER (row_valid) AS row_valid_count, count(*) FILTER (patch_context) AS context_count,
    count(*) FILTER (patch_target_eligible) AS eligible_count, CAST(sum(CAST(CASE WHEN feature_valid THEN value ELSE 0 END AS DECIMAL(18, 6))) AS DOUBLE) AS valid_sum,
    sum(position * 100 + patch * 10 + day_in_patch) AS place_sum FROM ({" UNION ALL ".join(parts)}) GROUP BY 1, 2, 3, 4"""


for _group in GROUP_TABLES:
    fragment(f"{_group}_long", long_sql(_group, t.feature_names(_group)), f"{_group}_facts")


@query(
    "l15_sample_snapshot",
    with_tables(snapshot_sql(), "days", "masks", "aman", *[f"{g}_long" for g in GROUP_TABLES]),
)
def l15_sample_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """The snapshot of every sample and asset, by sample and feature: its cells, masks, values and places."""
    masks = t.patch_masks(spark, sf).select(*samples.SAMPLE, "patch", "patch_context", "patch_target_eligible")
    rows = samples.sample_snapshot(
        t.requests(spark, sf), dense_long(spark, sf), masks, t.SAMPLES, sample_limit=0, asset_limit=0
    )
    value = F.round(F.col("value").cast("double"), 6)
    return rows.groupBy("input_group", "split", "sample_date_idx", "feature_name").agg(
        F.count(F.lit(1)).alias("cell_count"),
        F.count_distinct("asset_id").alias("asset_count"),
        F.min("date_idx").alias("first_date_idx"),
        F.max("date_idx").alias("last_date_idx"),
        F.count_if("feature_valid").alias("feature_valid_count"),
        F.count_if("row_valid").alias("row_valid_count"),
        F.count_if("patch_context").alias("context_count"),
        F.count_if("patch_target_eligible").alias("eligible_count"),
        F.sum(F.when(F.col("feature_valid"), value).otherwise(0.0).cast("decimal(18,6)")).cast("double").alias("valid_sum"),
        F.sum(F.col("position") * 100 + F.col("patch") * 10 + F.col("day_in_patch")).alias("place_sum"),
    )


def histogram_sql(mask: str) -> str:
    return f"""SELECT b.split, b.histogram_type, '{mask}' AS mask_name, CAST(b.bin AS INTEGER) AS bin,
    coalesce(c.n, 0) AS count, round(coalesce(c.n, 0) / b.sample_count, 6) AS fraction, b.sample_count FROM (
      SELECT split, sample_count, h AS histogram_type, i AS bin FROM
        (SELECT split, count(DISTINCT sample_date_idx) AS sample_count FROM masks GROUP BY 1)
        CROSS JOIN (SELECT 'patch_position' AS h, i FROM range({P}) r(i)
          UNION ALL SELECT 'selected_patch_count', i FROM range({P + 1}) r(i))) b
    LEFT JOIN (SELECT split, 'patch_position' AS h, patch AS bin, count(*) AS n FROM masks WHERE {mask} GROUP BY 1, 3
      UNION ALL SELECT split, 'selected_patch_count', k, count(*) FROM (
        SELECT split, sample_date_idx, count(*) FILTER ({mask}) AS k FROM masks GROUP BY 1, 2) GROUP BY 1, 3) c
    ON b.split = c.split AND b.histogram_type = c.h AND b.bin = c.bin"""


@query("l16_mask_histogram", with_tables(histogram_sql("patch_target_eligible"), "masks"))
def l16_mask_histogram(spark: SparkSession, sf: str) -> DataFrame:
    arrays = samples.mask_arrays(t.patch_masks(spark, sf)).select("split", F.col("eligible").alias("mask"))
    return rounded(samples.histogram(arrays, "patch_target_eligible", P))


@query("l16_target_histogram")
def l16_target_histogram(spark: SparkSession, sf: str) -> DataFrame:
    drawn = masked_samples(spark, sf)
    return rounded(
        samples.histogram(drawn.select("split", F.col("target").alias("mask")), "target", P).unionByName(
            samples.histogram(drawn.select("split", F.col("visible").alias("mask")), "visible", P)
        )
    )


VALUE_CAP = 200_000


def cell_values(spark: SparkSession, sf: str) -> DataFrame:
    rows = None
    for group, facts in t.FACTS.items():
        valid = "valid_asset" if group == "asset" else "valid_date"
        one = samples.long_facts(facts(spark, sf), t.feature_names(group), group, valid)
        rows = one if rows is None else rows.unionByName(one)
    return rows


LONGS = " UNION ALL ".join(f"SELECT * FROM {g}_long" for g in GROUP_TABLES)


@query(
    "l17_value_sample",
    with_tables(
        f"""SELECT split, input_group, CAST(date_idx AS INTEGER) AS date_idx, CAST(asset_id AS INTEGER) AS asset_id,
        feature_name, round(CAST(value AS DOUBLE), 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY split,
        input_group ORDER BY sha256('{SEED}|' || input_group || '|' || split || '|' || date_idx || '|' ||
        coalesce(CAST(asset_id AS VARCHAR), '-') || '|' || feature_name)) AS n FROM ({LONGS})
        WHERE row_valid AND feature_valid) WHERE n <= {VALUE_CAP}""",
        *[f"{g}_long" for g in GROUP_TABLES],
    ),
)
def l17_value_sample(spark: SparkSession, sf: str) -> DataFrame:
    kept = samples.value_sample(cell_values(spark, sf), VALUE_CAP, SEED)
    return kept.select(
        "split", "input_group", "date_idx", "asset_id", "feature_name", F.round(F.col("value").cast("double"), 6).alias("value")
    )


BINS = 80


@query(
    "l18_value_distribution",
    with_tables(
        f"""SELECT input_group, split, round(lower, 6) AS lower, round(upper, 6) AS upper, CAST(bin AS INTEGER) AS bin, n AS count,
        round(n / (sum(n) OVER (PARTITION BY input_group, split) * (upper - lower) / {BINS}), 6) AS density FROM (
        SELECT v.input_group, v.split, b.lower, b.upper,
        least(floor((v.value - b.lower) / (b.upper - b.lower) * {BINS}) + 1, {BINS}) AS bin, count(*) AS n
        FROM (SELECT input_group, split, CAST(value AS DOUBLE) AS value FROM ({LONGS}) WHERE row_valid AND feature_valid) v
        JOIN (SELECT input_group, quantile_cont(CAST(value AS DOUBLE), 0.005) AS lower,
          quantile_cont(CAST(value AS DOUBLE), 0.995) AS upper
          FROM ({LONGS}) WHERE row_valid AND feature_valid GROUP BY 1) b ON v.input_group = b.input_group
        WHERE v.value BETWEEN b.lower AND b.upper GROUP BY 1, 2, 3, 4, 5)""",
        *[f"{g}_long" for g in GROUP_TABLES],
    ),
)
def l18_value_distribution(spark: SparkSession, sf: str) -> DataFrame:
    values = cell_values(spark, sf).filter("row_valid AND feature_valid").select(
        "input_group", "split", F.col("value").cast("double").alias("value")
    )
    out = samples.value_distribution(values, BINS)
    return rounded(out.select("input_group", "split", "lower", "upper", F.col("bin").cast("int").alias("bin"), "count", "density"))


@query(
    "l19_eligibility_metrics",
    with_tables(
        """SELECT split, round(count(*) FILTER (patch_target_eligible) / count(*) FILTER (patch_context), 6) AS target_patch_eligibility_rate,
        round(count(*) FILTER (patch_target_eligible) / count(*) FILTER (patch_context), 6) AS masked_patch_rate,
        round(count(*) FILTER (patch_target_eligible) / count(DISTINCT sample_date_idx), 6) AS masked_patch_count_mean,
        count(DISTINCT sample_date_idx) AS sample_count FROM masks GROUP BY 1""",
        "masks",
    ),
)
def l19_eligibility_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Mask metrics if every eligible patch were a target."""
    arrays = samples.mask_arrays(t.patch_masks(spark, sf))
    return rounded(samples.mask_metrics(arrays.withColumn("target", F.col("eligible"))))


@query("l19_mask_metrics")
def l19_mask_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(samples.mask_metrics(masked_samples(spark, sf)))


@query(
    "l20_packed_patches",
    with_tables(
        """SELECT split, CAST(sample_date_idx AS INTEGER) AS sample_date_idx,
        coalesce(string_agg(CAST(patch AS VARCHAR), ',' ORDER BY patch) FILTER (patch_target_eligible), '') AS visible_patches,
        CAST(count(*) FILTER (patch_target_eligible) AS INTEGER) AS visible_count FROM masks GROUP BY 1, 2""",
        "masks",
    ),
)
def l20_packed_patches(spark: SparkSession, sf: str) -> DataFrame:
    packed = samples.packed_patches(samples.mask_arrays(t.patch_masks(spark, sf)), "eligible")
    return packed.select(*samples.SAMPLE, F.array_join("visible_patches", ",").alias("visible_patches"), "visible_count")
