"""Queries over probe targets, walk-forward splits, estimators and their evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeweave.functions.expr import rounded
from tapeweave.operators import bootstrap as boot
from tapeweave.operators import estimators as est
from tapeweave.operators import geometry, panel, probe_data, probes, report, splits, targets
from tapeweave.operators.metrics import incremental_comparison
from tapeweave.plans import representation as rep
from tapeweave.plans import tables as t
from tapeweave.plans.canonical import targets_sql
from tapeweave.plans.registry import query
from tapeweave.plans.sqlbase import fragment, r6, with_tables

MARKET = "MARKET"
HORIZONS = (5, 21)
PROBE_DIM = 16
TARGETS = sorted(
    f"future_{kind}_{h}d" for kind in ("return", "realized_vol", "max_drawdown", "trend_score") for h in HORIZONS
)
STATE_COLUMNS = ["xs_dispersion_1d", "breadth_1d", "vix_level", "treasury_10y_level", "yield_curve_10y_2y"]
TRAIL_COLUMNS = [f"{kind}_{h}d" for kind in ("return", "realized_vol", "drawdown") for h in HORIZONS]
BASELINES = [probe_data.baseline_name(c) for c in (*STATE_COLUMNS, *TRAIL_COLUMNS)] + [
    f"baseline__current_trend_score_{h}d" for h in HORIZONS
]
Z_COLUMNS = [f"z_{i + 1}" for i in range(PROBE_DIM)]
WINDOW = "validation_window_name"
BLOCK_LENGTHS = (5, 21, 63, 126)


@t.layer
def market_panel(spark: SparkSession, sf: str) -> DataFrame:
    """The equal-weighted index of all symbols with its trailing features."""
    daily = (
        t.bars(spark, sf)
        .groupBy("date")
        .agg(
            F.avg("open").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.avg("close").alias("close"),
            F.sum("volume").alias("volume"),
        )
        .select("date", F.lit(MARKET).alias("symbol"), "open", "high", "low", "close", "volume")
    )
    flagged = daily.withColumn("valid_observation", F.col("close").isNotNull())
    return panel.asset_features(flagged, HORIZONS)


def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return targets.future_targets(market_panel(spark, sf), MARKET, HORIZONS)


def baselines(spark: SparkSession, sf: str) -> DataFrame:
    return probe_data.baseline_features(
        outcomes(spark, sf), t.features_table(spark, sf), market_panel(spark, sf), MARKET, STATE_COLUMNS, TRAIL_COLUMNS,
        HORIZONS,
    )


@t.layer
def probe_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Probe dataset on PCA coordinates fitted on train days, with positions."""
    days = rep.z_days(spark, sf)
    pca = geometry.fit_pca(days.filter("split = 'train'"), "vector", PROBE_DIM)
    z = geometry.apply_pca(days, "vector", pca).drop("vector")
    coordinates = geometry.coordinates(z, "z", PROBE_DIM, {"representation_variant": "pooled_pca_8"})
    return probe_data.assemble(coordinates, outcomes(spark, sf), baselines(spark, sf), PROBE_DIM)


def windows(spark: SparkSession, sf: str) -> DataFrame:
    return splits.outer_windows(rep.z_days(spark, sf))


@t.layer
def outer(spark: SparkSession, sf: str) -> DataFrame:
    return probes.outer_rows(probe_rows(spark, sf), TARGETS, Z_COLUMNS, BASELINES, windows(spark, sf))


# --- SQL building blocks -----------------------------------------------------------------

fragment(
    "mkt",
    f"""SELECT date, '{MARKET}' AS symbol, avg(close) AS close, sum(volume) AS volume, true AS valid_observation
    FROM bars GROUP BY date""",
    "bars",
)
_mrets = ", ".join(f"ln(close) - lag(ln(close), {h}) OVER w AS return_{h}d" for h in HORIZONS)
fragment(
    "mrets",
    f"SELECT *, ln(close) - lag(ln(close), 1) OVER w AS return_1d, {_mrets} FROM mkt WINDOW w AS (PARTITION BY symbol ORDER BY date)",
    "mkt",
)
fragment(
    "mfeats",
    "SELECT *, "
    + ", ".join(
        f"CASE WHEN count(return_1d) OVER w{h} >= {panel.minimum_periods(h)} THEN stddev_samp(return_1d) OVER w{h} * sqrt(252) END AS realized_vol_{h}d, "
        f"CASE WHEN count(close) OVER w{h} >= {panel.minimum_periods(h)} THEN close / max(close) OVER w{h} - 1 END AS drawdown_{h}d"
        for h in HORIZONS
    )
    + " FROM mrets WINDOW "
    + ", ".join(
        f"w{h} AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN {h - 1} PRECEDING AND CURRENT ROW)" for h in HORIZONS
    ),
    "mrets",
)
fragment("mtargets", targets_sql(HORIZONS, MARKET, "mfeats"), "mfeats")
fragment(
    "base",
    "SELECT t.date, "
    + ", ".join(f"f.{c} AS {probe_data.baseline_name(c)}" for c in STATE_COLUMNS)
    + ", "
    + ", ".join(f"m.{c} AS {probe_data.baseline_name(c)}" for c in TRAIL_COLUMNS)
    + ", "
    + ", ".join(f"m.return_{h}d / (m.realized_vol_{h}d + 1e-12) AS baseline__current_trend_score_{h}d" for h in HORIZONS)
    + f" FROM (SELECT DISTINCT date FROM mtargets) t LEFT JOIN features f ON t.date = f.date "
    f"LEFT JOIN mfeats m ON m.date = t.date AND m.symbol = '{MARKET}' AND m.valid_observation",
    "mtargets",
    "features",
    "mfeats",
)
fragment(
    "pwins",
    "SELECT validation_window_name, min(pos) AS start_pos, min(date) AS start_date FROM zdays WHERE split = 'validation' GROUP BY 1",
    "zdays",
)
SPEC_VALUES = ", ".join(
    f"('{raw}', '{target}', '{kind}', {int(raw.rsplit('_', 1)[1][:-1])})"
    for raw, target, kind in probe_data.transform_specs(TARGETS)
)
_proxy = {
    raw: f"baseline__{probe_data.PROXIES[family]}_{raw.rsplit('_', 1)[1]}"
    for raw in TARGETS
    for family in probe_data.PROXIES
    if family in raw
}
TRANSFORMED = """CASE transform WHEN 'raw' THEN {v} WHEN 'log_realized_vol' THEN ln(greatest({v}, 1e-12))
    WHEN 'drawdown_magnitude' THEN greatest(-{v}, 0) ELSE ln(1 + greatest(-{v}, 0)) END"""
fragment(
    "ptargets",
    f"""SELECT *, {TRANSFORMED.format(v='raw_value')} AS value FROM (
    SELECT z.date, z.pos, z.split, z.validation_window_name, s.raw_target, s.target, s.transform, s.horizon,
    CASE s.raw_target {' '.join(f"WHEN '{r}' THEN t.{r}" for r in TARGETS)} END AS raw_value,
    CASE s.raw_target {' '.join(f"WHEN '{r}' THEN b.{p}" for r, p in _proxy.items())} END AS raw_proxy
    FROM zdays z JOIN mtargets t ON z.date = t.date JOIN base b ON b.date = z.date
    CROSS JOIN (VALUES {SPEC_VALUES}) s(raw_target, target, transform, horizon)) WHERE raw_value IS NOT NULL""",
    "zdays",
    "mtargets",
    "base",
)
fragment(
    "pouter",
    """SELECT w.validation_window_name, p.raw_target, p.target, p.transform, p.horizon, p.date, p.pos, p.raw_value, p.value,
    p.raw_proxy, 'fit' AS role FROM ptargets p JOIN pwins w ON p.split = 'train' AND p.pos + p.horizon < w.start_pos
    UNION ALL SELECT validation_window_name, raw_target, target, transform, horizon, date, pos, raw_value, value, raw_proxy,
    'score' FROM ptargets WHERE split = 'validation'""",
    "ptargets",
    "pwins",
)

# --- N: probe targets and dataset --------------------------------------------------------------


def _base_sql(columns: list[str]) -> str:
    return with_tables(f"SELECT date, {', '.join(r6(c, c) for c in columns)} FROM base", "base")


@query("n2_baseline_features", _base_sql(BASELINES[:-2]))
def n2_baseline_features(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(baselines(spark, sf).select("date", *BASELINES[:-2]))


@query("n3_current_trend_score", _base_sql(BASELINES[-2:]))
def n3_current_trend_score(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(baselines(spark, sf).select("date", *BASELINES[-2:]))


@query(
    "n4_target_export",
    with_tables(f"SELECT date, {', '.join(r6(c, c) for c in TARGETS)} FROM mtargets", "mtargets"),
)
def n4_target_export(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(probe_data.exported_targets(outcomes(spark, sf)))


RAW_Z = [f"z_{i + 1}" for i in range(rep.DIM)]


def raw_dataset(spark: SparkSession, sf: str) -> DataFrame:
    raw = geometry.coordinates(rep.z_days(spark, sf), "vector", rep.DIM, {})
    return probe_data.assemble(raw, outcomes(spark, sf), baselines(spark, sf), rep.DIM)


@query(
    "n5_probe_dataset",
    with_tables(
        "SELECT z.date, any_value(z.split) AS split, any_value(z.validation_window_name) AS validation_window_name, "
        + ", ".join(f"round(max(CASE WHEN z.i = {i + 1} THEN z.v END), 6) AS z_{i + 1}" for i in range(rep.DIM))
        + ", "
        + ", ".join(f"round(any_value(t.{c}), 6) AS {c}" for c in TARGETS)
        + ", "
        + ", ".join(f"round(any_value(b.{c}), 6) AS {c}" for c in BASELINES)
        + " FROM zday_long z LEFT JOIN mtargets t ON z.date = t.date LEFT JOIN base b ON z.date = b.date GROUP BY z.date",
        "zday_long",
        "mtargets",
        "base",
    ),
)
def n5_probe_dataset(spark: SparkSession, sf: str) -> DataFrame:
    rows = raw_dataset(spark, sf)
    return rounded(rows.select("date", "split", WINDOW, *RAW_Z, *TARGETS, *BASELINES))


@query(
    "n6_target_availability",
    with_tables(
        "SELECT z.date, " + ", ".join(f"t.{c} IS NOT NULL AS target_available__{c}" for c in TARGETS)
        + " FROM zdays z LEFT JOIN mtargets t ON z.date = t.date",
        "zdays",
        "mtargets",
    ),
)
def n6_target_availability(spark: SparkSession, sf: str) -> DataFrame:
    return probe_rows(spark, sf).select("date", *[f"target_available__{c}" for c in TARGETS])


@query(
    "n7_window_table",
    with_tables(
        "SELECT validation_window_name, min(date) AS validation_start, max(date) AS validation_end, "
        "min(date) AS train_cutoff_exclusive, count(*) AS validation_row_count FROM zdays WHERE split = 'validation' GROUP BY 1",
        "zdays",
    ),
)
def n7_window_table(spark: SparkSession, sf: str) -> DataFrame:
    return probe_data.window_table(rep.z_days(spark, sf))


@query(
    "n8_reloaded_dataset",
    with_tables(
        "SELECT split, count(*) AS row_count, min(date) AS first_date, max(date) AS last_date FROM zdays GROUP BY 1", "zdays"
    ),
)
def n8_reloaded_dataset(spark: SparkSession, sf: str) -> DataFrame:
    rows = probe_data.reloaded(probe_rows(spark, sf), TARGETS)
    return rows.groupBy("split").agg(
        F.count(F.lit(1)).alias("row_count"), F.min("date").alias("first_date"), F.max("date").alias("last_date")
    )


# --- O: transforms and labels -----------------------------------------------------------------------


@query(
    "o1_target_variants",
    with_tables(
        "SELECT raw_target, target, transform AS target_transform, count(*) AS row_count FROM ptargets GROUP BY 1, 2, 3",
        "ptargets",
    ),
)
def o1_target_variants(spark: SparkSession, sf: str) -> DataFrame:
    long = probe_data.target_rows(probe_rows(spark, sf), TARGETS, ["date"])
    return long.groupBy("raw_target", "target", "target_transform").agg(F.count(F.lit(1)).alias("row_count"))


@query(
    "o2_transformed_targets",
    with_tables("SELECT date, target, round(value, 6) AS value FROM ptargets", "ptargets"),
)
def o2_transformed_targets(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(probe_data.target_rows(probe_rows(spark, sf), TARGETS, ["date"]).select("date", "target", "value"))


@query(
    "o3_inverse_predictions",
    with_tables(
        """SELECT date, target, round(CASE transform WHEN 'raw' THEN p WHEN 'log_realized_vol' THEN exp(p)
        WHEN 'drawdown_magnitude' THEN -greatest(p, 0) ELSE -(exp(greatest(p, 0)) - 1) END, 6) AS prediction,
        transform IN ('drawdown_magnitude', 'log_drawdown_magnitude') AND p < 0 AS clipped
        FROM (SELECT date, target, transform, value - 0.1 AS p FROM ptargets)""",
        "ptargets",
    ),
)
def o3_inverse_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Inverse map of predictions that miss each value by 0.1."""
    long = probe_data.target_rows(probe_rows(spark, sf), TARGETS, ["date"])
    raw, clipped = probe_data.inverse_value(F.col("value") - 0.1, F.col("target_transform"))
    return rounded(long.select("date", "target", raw.alias("prediction"), clipped.alias("clipped")))


LABEL_SQL = """SELECT w, raw_target, split_part(raw_target, '_', -1) AS suffix, lab, thr FROM (
  SELECT validation_window_name AS w, raw_target, count(*) AS n, quantile_cont(raw_value, 0.8) AS high,
  quantile_cont(greatest(-raw_value, 0), 0.8) AS fall, quantile_cont(abs(raw_value), 1.0 - 0.8) AS weak
  FROM pouter WHERE role = 'fit' AND transform = 'raw' GROUP BY 1, 2),
  LATERAL (SELECT unnest(CASE WHEN raw_target LIKE '%realized_vol%' THEN [{'lab': 'high_vol', 'thr': high}]
    WHEN raw_target LIKE '%max_drawdown%' THEN [{'lab': 'severe_drawdown', 'thr': fall}]
    WHEN raw_target LIKE '%future_return%' THEN [{'lab': 'positive_return', 'thr': 0.0}]
    ELSE [{'lab': 'strong_trend', 'thr': high}, {'lab': 'weak_or_chop', 'thr': weak}] END, recursive := true)) l
  WHERE n >= 3"""


@query(
    "o4_label_thresholds",
    with_tables(
        f"SELECT w AS validation_window_name, raw_target, lab || '_' || suffix AS classification_label, round(thr, 6) AS threshold FROM ({LABEL_SQL})",
        "pouter",
    ),
)
def o4_label_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    raw = outer(spark, sf).filter("target_transform = 'raw' AND role = 'fit'")
    return rounded(probe_data.label_thresholds(raw, [WINDOW]).drop("label_kind"))


@query(
    "o4_regime_labels",
    with_tables(
        f"""SELECT p.validation_window_name, l.lab || '_' || l.suffix AS classification_label, p.role, count(*) AS row_count,
        count(*) FILTER (CASE WHEN l.lab IN ('high_vol', 'strong_trend') THEN p.raw_value >= l.thr
          WHEN l.lab = 'severe_drawdown' THEN greatest(-p.raw_value, 0) >= l.thr
          WHEN l.lab = 'positive_return' THEN p.raw_value > l.thr ELSE abs(p.raw_value) <= l.thr END) AS positive_count
        FROM pouter p JOIN ({LABEL_SQL}) l ON p.validation_window_name = l.w AND p.raw_target = l.raw_target
        WHERE p.transform = 'raw' GROUP BY 1, 2, 3""",
        "pouter",
    ),
)
def o4_regime_labels(spark: SparkSession, sf: str) -> DataFrame:
    raw = outer(spark, sf).filter("target_transform = 'raw'")
    thresholds = probe_data.label_thresholds(raw.filter("role = 'fit'"), [WINDOW])
    value = probe_data.label_value(F.col("raw_value"), F.col("label_kind"), F.col("threshold"))
    return (
        raw.join(thresholds, [WINDOW, "raw_target"])
        .groupBy(WINDOW, "classification_label", "role")
        .agg(F.count(F.lit(1)).alias("row_count"), F.count_if(value == 1).alias("positive_count"))
    )


@query(
    "o5_target_horizon",
    with_tables(
        """SELECT target, CAST(regexp_extract(target, '_([0-9]+)d(__.*)?$', 1) AS INTEGER) AS horizon_days,
        regexp_extract(target, '^(future_[a-z_]+)_[0-9]+d', 1) AS target_family, count(*) AS row_count FROM ptargets GROUP BY 1""",
        "ptargets",
    ),
)
def o5_target_horizon(spark: SparkSession, sf: str) -> DataFrame:
    long = probe_data.target_rows(probe_rows(spark, sf), TARGETS, ["date"])
    return long.groupBy(
        "target",
        probe_data.horizon_of(F.col("target")).alias("horizon_days"),
        probe_data.family_of(F.col("target")).alias("target_family"),
    ).agg(F.count(F.lit(1)).alias("row_count"))


@query(
    "o6_trailing_proxy",
    with_tables(
        "SELECT raw_target, CASE raw_target "
        + " ".join(f"WHEN '{r}' THEN '{p}'" for r, p in _proxy.items())
        + " END AS proxy_column, count(raw_proxy) AS known_proxies, round(avg(raw_proxy), 6) AS mean_proxy "
        "FROM ptargets WHERE transform = 'raw' GROUP BY 1",
        "ptargets",
    ),
)
def o6_trailing_proxy(spark: SparkSession, sf: str) -> DataFrame:
    long = probe_data.target_rows(probe_rows(spark, sf), TARGETS, ["date"]).filter("target_transform = 'raw'")
    return rounded(
        long.groupBy("raw_target", probe_data.proxy_column(F.col("raw_target")).alias("proxy_column")).agg(
            F.count("raw_proxy").alias("known_proxies"), F.avg("raw_proxy").alias("mean_proxy")
        )
    )


# --- P: splits -------------------------------------------------------------------------------------------


@query(
    "p1_outer_walk_forward",
    with_tables(
        "SELECT w.validation_window_name, z.date FROM zdays z JOIN pwins w ON z.split = 'train' AND z.date < w.start_date",
        "zdays",
        "pwins",
    ),
)
def p1_outer_walk_forward(spark: SparkSession, sf: str) -> DataFrame:
    return splits.outer_train(rep.z_days(spark, sf), windows(spark, sf)).select(WINDOW, "date")


def by_horizon(spark: SparkSession, sf: str) -> DataFrame:
    rows = rep.z_days(spark, sf)
    return rows.select(*rows.columns, F.explode(F.array(*[F.lit(h) for h in HORIZONS])).alias("horizon"))


HORIZON_SQL = ", ".join(f"({h})" for h in HORIZONS)
fragment(
    "ptrain",
    f"""SELECT w.validation_window_name, h.horizon, z.date, z.pos FROM zdays z JOIN pwins w ON z.split = 'train'
    CROSS JOIN (VALUES {HORIZON_SQL}) h(horizon) WHERE z.pos + h.horizon < w.start_pos""",
    "zdays",
    "pwins",
)


@query(
    "p2_purged_train",
    with_tables("SELECT validation_window_name, horizon, date FROM ptrain", "ptrain"),
)
def p2_purged_train(spark: SparkSession, sf: str) -> DataFrame:
    purged = splits.outer_train(by_horizon(spark, sf), windows(spark, sf), F.col("horizon"))
    return purged.select(WINDOW, "horizon", "date")


@query(
    "p3_expanding_folds",
    with_tables(
        f"""SELECT * FROM (
        SELECT b.validation_window_name, b.horizon, CAST(f.fold AS INTEGER) AS fold, b.date,
        CASE WHEN b.block = f.fold THEN 'score' WHEN b.pos + b.horizon < f.start THEN 'fit' END AS role FROM (
          SELECT *, CASE WHEN late THEN ntile(3) OVER (PARTITION BY validation_window_name, horizon, late ORDER BY pos) END AS block
          FROM (SELECT *, pos > min(pos) OVER (PARTITION BY validation_window_name, horizon) + horizon + {splits.MIN_HISTORY} AS late
            FROM ptrain)) b
        JOIN (SELECT validation_window_name, horizon, block AS fold, min(pos) AS start FROM (
          SELECT *, ntile(3) OVER (PARTITION BY validation_window_name, horizon ORDER BY pos) AS block FROM (
            SELECT *, min(pos) OVER (PARTITION BY validation_window_name, horizon) AS first FROM ptrain)
          WHERE pos > first + horizon + {splits.MIN_HISTORY}) GROUP BY 1, 2, 3) f
        ON b.validation_window_name = f.validation_window_name AND b.horizon = f.horizon) WHERE role IS NOT NULL""",
        "ptrain",
    ),
)
def p3_expanding_folds(spark: SparkSession, sf: str) -> DataFrame:
    train = splits.outer_train(by_horizon(spark, sf), windows(spark, sf), F.col("horizon"))
    return splits.expanding_folds(train, [WINDOW, "horizon"]).select(WINDOW, "horizon", "fold", "date", "role")


# --- Q: estimators ------------------------------------------------------------------------------------------

HAND_VALUES = ", ".join(f"({i}, '{c}')" for i, c in enumerate(BASELINES))


@query(
    "q1_standardized_hand_features",
    with_tables(
        f"""SELECT validation_window_name, target, role, date, CAST(slot AS INTEGER) AS slot,
        round((coalesce(x, med) - avg(coalesce(x, med)) FILTER (role = 'fit') OVER g) /
          CASE WHEN stddev_pop(coalesce(x, med)) FILTER (role = 'fit') OVER g > 0
          THEN stddev_pop(coalesce(x, med)) FILTER (role = 'fit') OVER g ELSE 1 END, 5) AS value
        FROM (SELECT *, quantile_cont(x, 0.5) FILTER (role = 'fit') OVER (PARTITION BY validation_window_name, target, slot) AS med
          FROM (SELECT p.validation_window_name, p.target, p.role, p.date, s.slot, CASE s.name
            {' '.join(f"WHEN '{c}' THEN b.{c}" for c in BASELINES)} END AS x
            FROM pouter p JOIN base b ON p.date = b.date CROSS JOIN (VALUES {HAND_VALUES}) s(slot, name)
            WHERE p.transform = 'raw')) WINDOW g AS (PARTITION BY validation_window_name, target, slot)""",
        "pouter",
        "base",
    ),
)
def q1_standardized_hand_features(spark: SparkSession, sf: str) -> DataFrame:
    rows = outer(spark, sf).filter("target_transform = 'raw'")
    design = rows.select(*probes.CELL, F.lit(0).alias("fold"), "role", "date", F.col("hand").alias("x"))
    scaled = est.standardize(design, probes.CELL)
    return rounded(
        scaled.select(*probes.CELL, "role", "date", F.posexplode("x").alias("slot", "value")), 5
    )


@t.layer
def regression_selection(spark: SparkSession, sf: str) -> DataFrame:
    regression_predictions(spark, sf)
    return _SELECTED[(spark.sparkContext.applicationId, sf, "regression")]


@t.layer
def classification_selection(spark: SparkSession, sf: str) -> DataFrame:
    classification_predictions(spark, sf)
    return _SELECTED[(spark.sparkContext.applicationId, sf, "classification")]


_SELECTED: dict[tuple[str, str, str], DataFrame] = {}


@t.layer
def regression_predictions(spark: SparkSession, sf: str) -> DataFrame:
    selection, predictions = probes.regression_probes(outer(spark, sf))
    _SELECTED[(spark.sparkContext.applicationId, sf, "regression")] = selection
    return predictions


@t.layer
def classification_predictions(spark: SparkSession, sf: str) -> DataFrame:
    selection, predictions = probes.classification_probes(probes.label_rows(outer(spark, sf)))
    _SELECTED[(spark.sparkContext.applicationId, sf, "classification")] = selection
    return predictions


@t.layer
def baseline_predictions(spark: SparkSession, sf: str) -> DataFrame:
    return probes.baseline_predictions(outer(spark, sf))


@t.layer
def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """The long prediction table of all predictors."""
    return (
        baseline_predictions(spark, sf)
        .unionByName(regression_predictions(spark, sf))
        .unionByName(classification_predictions(spark, sf))
    )


PREDICTION = ["date", WINDOW, "target", "score_space", "predictor_name", "actual", "prediction"]


def head_predictions(name: str, head: str) -> None:
    @query(name)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = classification_predictions if head == "logistic" else regression_predictions
        rows = df(spark, sf).filter((F.col("model_name") == head) & (F.col("predictor_kind") == "model"))
        return rounded(rows.select(*PREDICTION, "selected_alpha"))


for _name, _head in (
    ("q2_ridge", "ridge"),
    ("q3_elastic_net", "elastic_net"),
    ("q4_huber", "huber"),
    ("q5_logistic", "logistic"),
):
    head_predictions(_name, _head)


def head_optimality(name: str, head: str) -> None:
    grid = ", ".join(f"({a}, {'NULL' if r is None else r})" for a, r in est.candidates_of(head))

    @query(
        name,
        with_tables(
            f"""SELECT validation_window_name, target, CAST(alpha AS DOUBLE) AS alpha, CAST(l1_ratio AS DOUBLE) AS l1_ratio, row_count,
            true AS optimal FROM (SELECT validation_window_name, target, count(*) AS row_count FROM pouter
              WHERE role = 'fit' GROUP BY 1, 2) CROSS JOIN (VALUES {grid}) g(alpha, l1_ratio)""",
            "pouter",
        ),
    )
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = outer(spark, sf)
        design = rows.select(
            *probes.CELL,
            F.lit(0).alias("fold"),
            "role",
            F.datediff("date", F.lit("1970-01-01").cast("date")).cast("long").alias("pos"),
            F.col("hand").alias("x"),
            F.col("value").alias("y"),
        )
        scaled = est.standardize(design, probes.CELL)
        found = est.optimality(scaled, est.fit(scaled, probes.CELL, (head,)), probes.CELL)
        return found.select(*probes.CELL, "alpha", "l1_ratio", "row_count", (F.col("violation") < OPTIMAL).alias("optimal"))


#: Largest entry of a gradient that counts as none: targets are of the order of 0.01 to 1. The
#: elastic net has no such row, as its sweeps end after a hundred, at the optimum or not.
OPTIMAL = 1e-6

for _name, _head in (
    ("q2_ridge_optimality", "ridge"),
    ("q4_huber_optimality", "huber"),
):
    head_optimality(_name, _head)


@query("q6_hand_pca")
def q6_hand_pca(spark: SparkSession, sf: str) -> DataFrame:
    derived = probes.derived_families(outer(spark, sf).filter("target_transform = 'raw'"), probes.CELL)
    return rounded(
        derived.select(*probes.CELL, "date", F.posexplode("hand_pca").alias("component", "value"))
    )


@query("q7_residual_z")
def q7_residual_z(spark: SparkSession, sf: str) -> DataFrame:
    derived = probes.derived_families(outer(spark, sf).filter("target_transform = 'raw'"), probes.CELL)
    return rounded(derived.select(*probes.CELL, "date", F.posexplode("residual_z").alias("coordinate", "value")))


@query("q8_incremental_model")
def q8_incremental_model(spark: SparkSession, sf: str) -> DataFrame:
    rows = regression_predictions(spark, sf).filter(F.col("feature_family") == probes.INCREMENTAL)
    return rounded(rows.select(*PREDICTION, "selected_alpha"))


@query("q9_parameter_search")
def q9_parameter_search(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(regression_selection(spark, sf).unionByName(classification_selection(spark, sf)))


@query(
    "q11_feature_families",
    with_tables(
        f"""SELECT f.family, CAST(f.width AS INTEGER) AS feature_count, count(*) AS row_count FROM pouter p CROSS JOIN
        (VALUES ('z_only', {PROBE_DIM}), ('hand_market_features', {len(BASELINES)}), ('hand_market_pca', 8),
        ('hand_market_features_plus_z', {len(BASELINES) + PROBE_DIM}), ('feature_residualized_z_only', {PROBE_DIM})) f(family, width)
        GROUP BY 1, 2""",
        "pouter",
    ),
)
def q11_feature_families(spark: SparkSession, sf: str) -> DataFrame:
    rows = outer(spark, sf)
    derived = probes.derived_families(rows, probes.CELL)
    folds = rows.select(*probes.CELL, "date", F.lit(0).alias("fold"), F.col("role").alias("fold_role"))
    design = probes.design_rows(rows, derived, folds, probes.CELL, probes.family_columns(residual=True))
    return design.groupBy("family", F.size("x").alias("feature_count")).agg(F.count(F.lit(1)).alias("row_count"))


SPACES = """SELECT *, 'original' AS score_space FROM ({rows}) UNION ALL SELECT *, 'transformed' FROM ({rows}) WHERE transform <> 'raw'"""
MEANS = """SELECT p.*, m.mean FROM pouter p JOIN (SELECT validation_window_name, target, avg(value) AS mean FROM pouter
  WHERE role = 'fit' GROUP BY 1, 2) m ON p.validation_window_name = m.validation_window_name AND p.target = m.target WHERE p.role = 'score'"""
INVERSE = """CASE transform WHEN 'raw' THEN {v} WHEN 'log_realized_vol' THEN exp({v}) WHEN 'drawdown_magnitude' THEN -greatest({v}, 0)
  ELSE -(exp(greatest({v}, 0)) - 1) END"""


@query(
    "q12_constant_baselines",
    with_tables(
        f"""SELECT date, validation_window_name, target, score_space, predictor_name, round(actual, 6) AS actual,
        round(prediction, 6) AS prediction FROM (
        SELECT *, CASE score_space WHEN 'original' THEN raw_value ELSE value END AS actual, unnest([
          {{'predictor_name': 'train_mean', 'prediction': base}},
          {{'predictor_name': 'trailing_target_proxy', 'prediction': coalesce(CASE score_space WHEN 'original' THEN raw_proxy
            ELSE {TRANSFORMED.format(v='raw_proxy')} END, base)}}], recursive := true)
        FROM (SELECT *, CASE score_space WHEN 'original' THEN {INVERSE.format(v='mean')} ELSE mean END AS base
          FROM ({SPACES.format(rows=MEANS)})))""",
        "pouter",
    ),
)
def q12_constant_baselines(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(probes.baseline_predictions(outer(spark, sf)).select(*PREDICTION))


# --- R, S, T over the probes ------------------------------------------------------------------------------------


@query("r10_prediction_table")
def r10_prediction_table(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(predictions(spark, sf))


@t.layer
def regression_results(spark: SparkSession, sf: str) -> DataFrame:
    return probes.regression_results(predictions(spark, sf))


@t.layer
def classification_results(spark: SparkSession, sf: str) -> DataFrame:
    return probes.classification_results(predictions(spark, sf))


def results(spark: SparkSession, sf: str) -> DataFrame:
    return regression_results(spark, sf).unionByName(classification_results(spark, sf), allowMissingColumns=True)


@query("r1_probe_regression_results")
def r1_probe_regression_results(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(regression_results(spark, sf))


@query("r6_probe_classification_results")
def r6_probe_classification_results(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(classification_results(spark, sf))


def comparisons(spark: SparkSession, sf: str) -> DataFrame:
    rows = regression_results(spark, sf).filter("score_space = 'original'")
    keys = [WINDOW, "raw_target", "target", "model_name"]
    return incremental_comparison(rows, keys, "hand_market_features", probes.INCREMENTAL)


@query("r9_incremental_comparison")
def r9_incremental_comparison(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(comparisons(spark, sf))


COMBINATION = ["raw_target", "target", "task_type", "score_space", "model_name", "feature_family", "predictor_name"]
PER_WINDOW = [WINDOW, *COMBINATION]
SHAPES = [(40, 5), (40, 21), (97, 21)]


@query(
    "s1_block_starts",
    with_tables(
        f"""SELECT window_name, CAST(horizon AS INTEGER) AS horizon, CAST(draw AS INTEGER) AS draw, CAST(block AS INTEGER) AS block, CAST(start AS INTEGER) AS start,
        CAST(least(size, n - block * size) AS INTEGER) AS length FROM (SELECT *, ('0x' || substr(sha256('{boot.SEED}|' || n || '|' || size || '|' || draw
        || '|' || block), 1, 13))::BIGINT % (n - size + 1) AS start FROM (
          SELECT w.name AS window_name, h.horizon, w.n, least(h.horizon, w.n) AS size, d.draw, b.block FROM
          (SELECT validation_window_name AS name, count(*) AS n FROM zdays WHERE split = 'validation' GROUP BY 1) w
          CROSS JOIN (VALUES (5), (21), (63), (126)) h(horizon) CROSS JOIN range({boot.SAMPLES}) d(draw)
          JOIN range(1000) b(block) ON b.block * least(h.horizon, w.n) < w.n))""",
        "zdays",
    ),
)
def s1_block_starts(spark: SparkSession, sf: str) -> DataFrame:
    """Block starts of every draw for the validation windows at every block length."""
    shapes = rep.z_days(spark, sf).filter("split = 'validation'").groupBy(F.col(WINDOW).alias("window_name")).agg(
        F.count(F.lit(1)).cast("int").alias("n")
    ).select(
        "*", F.lit(0).alias("segment"), F.explode(F.array(*[F.lit(h) for h in BLOCK_LENGTHS])).alias("horizon")
    )
    shapes = shapes.withColumn("block_length", F.col("horizon"))
    return boot.block_starts(shapes, ["window_name", "horizon"]).drop("segment")


@t.layer
def aligned(spark: SparkSession, sf: str) -> DataFrame:
    """Candidate and hand predictions side by side."""
    return boot.align(predictions(spark, sf), PER_WINDOW)


def window_draws(spark: SparkSession, sf: str, task: str) -> DataFrame:
    rows = aligned(spark, sf).filter(F.col("task_type") == task)
    draw = boot.regression_draws if task == "regression" else boot.classification_draws
    return draw(rows, PER_WINDOW, boot.window_segment(), boot.SAMPLES, boot.SEED)


@query("s2_window_intervals")
def s2_window_intervals(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(
        boot.intervals(window_draws(spark, sf, "regression"), PER_WINDOW, boot.REGRESSION_METRICS).unionByName(
            boot.intervals(window_draws(spark, sf, "classification"), PER_WINDOW, boot.CLASSIFICATION_METRICS)
        )
    )


@query("s3_aligned_pairs")
def s3_aligned_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Point estimates of each task's metrics by window."""
    parts = [
        estimates(spark, sf, task).unpivot([*PER_WINDOW, "aligned_row_count"], metrics, "metric", "value")
        for task, metrics in (
            ("regression", boot.REGRESSION_METRICS),
            ("classification", boot.CLASSIFICATION_METRICS),
        )
    ]
    return rounded(parts[0].unionByName(parts[1]))


def estimates(spark: SparkSession, sf: str, task: str) -> DataFrame:
    measure = boot.point_estimates if task == "regression" else boot.classification_estimates
    return measure(aligned(spark, sf).filter(F.col("task_type") == task), PER_WINDOW)


def pooled_intervals(spark: SparkSession, sf: str, task: str = "regression") -> DataFrame:
    rows = aligned(spark, sf).filter(F.col("task_type") == task)
    regression = task == "regression"
    draw = boot.regression_draws if regression else boot.classification_draws
    draws = draw(rows, COMBINATION, boot.pooled_segment(COMBINATION), boot.SAMPLES, boot.SEED)
    return boot.intervals(
        draws, COMBINATION, boot.REGRESSION_METRICS if regression else boot.CLASSIFICATION_METRICS
    )


@query("s4_window_stability")
def s4_window_stability(spark: SparkSession, sf: str) -> DataFrame:
    """How each combination does across windows, with its pooled interval, for both tasks."""
    parts = []
    for task, metric in (
        ("regression", "rmse_difference_vs_hand"),
        ("classification", "brier_score_difference_vs_hand"),
    ):
        pooled = pooled_intervals(spark, sf, task).filter(F.col("metric") == metric)
        parts.append(boot.stability(estimates(spark, sf, task), COMBINATION, metric).join(pooled, COMBINATION))
    return rounded(parts[0].unionByName(parts[1]))


EXPECTED_WINDOWS = len(rep.Z_WINDOWS)


@query("t2_pooled_results")
def t2_pooled_results(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(report.pooled_results(predictions(spark, sf).filter("task_type = 'regression'")))


@query("t3_probe_regression_summary")
def t3_probe_regression_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(report.regression_summary(results(spark, sf)))


@query("t4_probe_classification_summary")
def t4_probe_classification_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(report.classification_summary(results(spark, sf)))


@query("t7_incremental_ranking")
def t7_incremental_ranking(spark: SparkSession, sf: str) -> DataFrame:
    support = pooled_intervals(spark, sf).filter(
        (F.col("metric") == "rmse_difference_vs_hand") & (F.col("feature_family") == probes.INCREMENTAL)
    )
    return rounded(
        report.incremental_ranking(comparisons(spark, sf), results(spark, sf), support, EXPECTED_WINDOWS)
    )


@query("t8_classification_ranking")
def t8_classification_ranking(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(report.classification_ranking(results(spark, sf), EXPECTED_WINDOWS))


@query("t9_warnings")
def t9_warnings(spark: SparkSession, sf: str) -> DataFrame:
    table = results(spark, sf)
    summaries = [report.regression_summary(table), report.classification_summary(table)]
    selection = regression_selection(spark, sf).unionByName(classification_selection(spark, sf))
    return report.warnings(table, summaries, EXPECTED_WINDOWS, selection, rep.windowed_ranks(spark, sf))
