"""Queries over vector tables and pooled panel states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeweave.functions.expr import rounded
from tapeweave.functions.ordered import exact_percentiles
from tapeweave.functions.vectors import cosine, slots
from tapeweave.operators import geometry, samples, states
from tapeweave.plans import dataset as ds
from tapeweave.plans import tables as t
from tapeweave.plans.registry import query
from tapeweave.plans.sqlbase import fragment, r6, with_tables
from tapeweave.sources import driver_tables as src

DIM = 64
# Where the named windows of the vector dates start, and their share.
Z_WINDOWS = [("first", 0.40), ("second", 0.62), ("third", 0.84)]
Z_SHARE = 0.08


def median(df: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    return exact_percentiles(df, keys, column, [0.5]).select(*keys, F.element_at("percentiles", 1).alias(name))


def calendar_positions(spark: SparkSession, sf: str) -> DataFrame:
    days = t.calendar(spark, sf)
    return days.select("date", (F.row_number().over(Window.orderBy("date")) - 1).alias("cal_idx"))


@t.layer
def z_days(spark: SparkSession, sf: str) -> DataFrame:
    """One pooled vector per calendar day with split and validation window.

    All vectors enter: vector i belongs to calendar day i modulo the number of days, and a
    day with several vectors holds their mean.
    """
    calendar = calendar_positions(spark, sf)
    size = calendar.agg(F.count(F.lit(1))).scalar()
    placed = src.vectors(spark, sf).select(
        F.pmod(F.col("vec_id"), size).cast("int").alias("cal_idx"), *slots("vector", DIM, "v")
    )
    pooled = placed.groupBy("cal_idx").agg(F.array(*[F.avg(f"v{i + 1}") for i in range(DIM)]).alias("vector"))
    rows = pooled.join(calendar, "cal_idx")
    ordered = rows.select("date", "vector", (F.row_number().over(Window.orderBy("date")) - 1).alias("pos"))
    count = pooled.agg(F.count(F.lit(1))).scalar()
    length = F.floor(count * F.lit(Z_SHARE))
    name = None
    for window, share in Z_WINDOWS:
        start = F.floor(count * F.lit(share))
        inside = (F.col("pos") >= start) & (F.col("pos") < start + length)
        name = F.when(inside, window) if name is None else name.when(inside, window)
    return ordered.select(
        "date",
        "pos",
        "vector",
        F.when(name.isNotNull(), "validation").otherwise("train").alias("split"),
        F.coalesce(name.otherwise(None), F.lit("")).alias("validation_window_name"),
    )


# --- SQL building blocks --------------------------------------------------------------

fragment(
    "zlong",
    "SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings",
)
fragment(
    "zday_long",
    """SELECT date, pos, i, v, CASE WHEN w.name IS NULL THEN 'train' ELSE 'validation' END AS split,
    coalesce(w.name, '') AS validation_window_name FROM (
      SELECT c.date, dense_rank() OVER (ORDER BY c.date) - 1 AS pos, z.i, z.v FROM (
        SELECT vec_id %% (SELECT count(*) FROM cal) AS d, i, avg(v) AS v FROM zlong GROUP BY 1, 2) z
      JOIN (SELECT date, row_number() OVER (ORDER BY date) - 1 AS d FROM cal) c ON c.d = z.d) p
    LEFT JOIN (SELECT name, floor(share * n) AS a, floor(%s * n) AS len FROM (VALUES %s) s(name, share)
      CROSS JOIN (SELECT count(DISTINCT vec_id %% (SELECT count(*) FROM cal)) AS n FROM embeddings)) w
    ON p.pos >= w.a AND p.pos < w.a + w.len"""
    % (Z_SHARE, ", ".join(f"('{n}', {s})" for n, s in Z_WINDOWS)),
    "zlong",
    "cal",
)
fragment(
    "zdays",
    "SELECT date, pos, any_value(split) AS split, any_value(validation_window_name) AS validation_window_name, "
    "list(v ORDER BY i) AS vector FROM zday_long GROUP BY 1, 2",
    "zday_long",
)

NAMES = {g: t.feature_names(g) for g in states.STREAMS}
STATE_SIZE = sum(len(n) for n in NAMES.values())


def state_sql(view: str | None) -> str:
    """Pooled state in long form, computed day by day from every cell of each lookback."""
    parts = []
    base = 0
    for group, names in NAMES.items():
        extra = f"JOIN {view} x ON x.split = d.split AND x.sample_date_idx = d.sample_date_idx AND x.asset_id = l.asset_id" if view and group == "asset" else ""
        parts.append(
            f"SELECT d.split, d.sample_date_idx, d.patch, l.feature_index + {base} AS slot, "
            f"avg(CAST(l.value AS DOUBLE)) AS v FROM days d JOIN {group}_long l "
            f"ON l.split = d.split AND l.date_idx = d.date_idx AND l.row_valid AND l.feature_valid {extra} GROUP BY 1, 2, 3, 4"
        )
        base += len(names)
    cells = " UNION ALL ".join(parts)
    return f"""SELECT split, sample_date_idx, half, slot, v FROM (
      SELECT m.split, m.sample_date_idx, s.slot, avg(CASE WHEN m.patch_context THEN coalesce(c.v, 0) END) AS mean_v,
      max(CASE WHEN m.patch = {ds.P - 1} AND m.patch_context THEN coalesce(c.v, 0) END) AS end_v
      FROM masks m CROSS JOIN range({STATE_SIZE}) s(slot) LEFT JOIN ({cells}) c
      ON c.split = m.split AND c.sample_date_idx = m.sample_date_idx AND c.patch = m.patch AND c.slot = s.slot
      GROUP BY 1, 2, 3) UNPIVOT (v FOR half IN (mean_v, end_v))"""


LONG_NEEDS = [f"{g}_long" for g in states.STREAMS]
fragment("state_all", state_sql(None), "days", "masks", *LONG_NEEDS)
VIEWS = (0, 1, 2)
for _v in VIEWS:
    fragment(
        f"fixed_view_{_v}", ds.ranked_view_sql(ds.fixed_key(ds.FIXED_K, _v), ds.FIXED_K), "full_reqs", "asset_facts"
    )
    fragment(f"state_view_{_v}", state_sql(f"fixed_view_{_v}"), "days", "masks", f"fixed_view_{_v}", *LONG_NEEDS)


# --- M1, M2: pooled states ----------------------------------------------------------------


@t.layer
def asset_patch_sums(spark: SparkSession, sf: str) -> DataFrame:
    return states.patch_sums(t.asset_facts(spark, sf), NAMES["asset"], "valid_asset", t.SAMPLES)


@t.layer
def date_patch_vectors(spark: SparkSession, sf: str) -> DataFrame:
    sums = {g: states.patch_sums(t.FACTS[g](spark, sf), NAMES[g], "valid_date", t.SAMPLES) for g in ("market", "macro")}
    return states.date_patch_vectors(sums, NAMES)


def build_states(spark: SparkSession, sf: str, view: DataFrame | None = None) -> DataFrame:
    vectors = states.patch_vectors(
        t.requests(spark, sf), asset_patch_sums(spark, sf), date_patch_vectors(spark, sf), NAMES, t.SAMPLES, view
    )
    return states.pooled_states(vectors, t.patch_masks(spark, sf), STATE_SIZE, ds.P, "drop")


@t.layer
def panel_states(spark: SparkSession, sf: str) -> DataFrame:
    """Pooled states on the whole asset axis."""
    return build_states(spark, sf)


def state_half(half: str, name: str):
    sql = with_tables(
        f"SELECT split, CAST(sample_date_idx AS INTEGER) AS sample_date_idx, CAST(slot AS INTEGER) AS slot, {r6('v', 'value')} "
        f"FROM state_all WHERE half = '{half}'",
        "state_all",
    )

    @query(name, sql)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        column = "mean_state" if half == "mean_v" else "endpoint_state"
        pooled = build_states(spark, sf)
        return rounded(
            pooled.select(*samples.SAMPLE, F.posexplode(column).alias("slot", "value"))
        )


state_half("mean_v", "m1_masked_mean_state")
state_half("end_v", "m2_endpoint_state")


@query(
    "m2_invalid_endpoints",
    with_tables(
        "SELECT split, CAST(sample_date_idx AS INTEGER) AS sample_date_idx FROM masks "
        f"WHERE patch = {ds.P - 1} AND NOT patch_context",
        "masks",
    ),
)
def m2_invalid_endpoints(spark: SparkSession, sf: str) -> DataFrame:
    """Samples that states.pooled_states refuses by default; the state queries drop them."""
    return states.invalid_endpoints(t.patch_masks(spark, sf), ds.P)


@query(
    "m2_pooled_state_norm",
    with_tables(
        "SELECT split, CAST(sample_date_idx AS INTEGER) AS sample_date_idx, CAST(count(*) AS INTEGER) AS state_size, "
        "round(sum(v * v), 6) AS squared_norm FROM state_all GROUP BY 1, 2",
        "state_all",
    ),
)
def m2_pooled_state_norm(spark: SparkSession, sf: str) -> DataFrame:
    pooled = panel_states(spark, sf)
    total = F.aggregate("pooled_state", F.lit(0.0), lambda s, x: s + x * x)
    return rounded(
        pooled.select(*samples.SAMPLE, F.size("pooled_state").alias("state_size"), total.alias("squared_norm"))
    )


# --- M3-M5: PCA -------------------------------------------------------------------------------

PCA_SIZE = 16


def z_pca(spark: SparkSession, sf: str) -> tuple[DataFrame, geometry.Pca]:
    days = z_days(spark, sf)
    pca = geometry.fit_pca(days.filter("split = 'train'"), "vector", PCA_SIZE)
    return geometry.apply_pca(days, "vector", pca), pca


def variance_rows(spark: SparkSession, fitted: dict[str, geometry.Pca]) -> DataFrame:
    rows = [
        (name, i + 1, float(v), float(r))
        for name, pca in fitted.items()
        for i, (v, r) in enumerate(zip(pca.variance, pca.ratio))
    ]
    return spark.createDataFrame(
        rows, "variant string, component int, explained_variance double, explained_variance_ratio double"
    )


@query("m3_pca_fit")
def m3_pca_fit(spark: SparkSession, sf: str) -> DataFrame:
    """PCA of the whole embedding table."""
    return rounded(variance_rows(spark, {"embeddings": geometry.fit_pca(src.vectors(spark, sf), "vector", PCA_SIZE)}))


@query(
    "m3_total_variance",
    with_tables(
        "SELECT count(*) AS component_count, round(sum(x), 6) AS total_variance, 1.0 AS total_ratio "
        "FROM (SELECT var_samp(v) AS x FROM zlong GROUP BY i)",
        "zlong",
    ),
)
def m3_total_variance(spark: SparkSession, sf: str) -> DataFrame:
    """All components together keep the variance of the vectors."""
    rows = src.vectors(spark, sf)
    entries = rows.select(F.size("vector")).first()[0]
    kept = variance_rows(spark, {"embeddings": geometry.fit_pca(rows, "vector", entries)})
    return rounded(
        kept.agg(
            F.count(F.lit(1)).alias("component_count"),
            F.sum("explained_variance").alias("total_variance"),
            F.sum("explained_variance_ratio").alias("total_ratio"),
        )
    )


@query("m4_pca_apply")
def m4_pca_apply(spark: SparkSession, sf: str) -> DataFrame:
    rows = src.vectors(spark, sf)
    projected = geometry.apply_pca(rows, "vector", geometry.fit_pca(rows, "vector", PCA_SIZE))
    return rounded(projected.select("vec_id", "label", *slots("z", PCA_SIZE, "z_")))


@query("m5_representation_variants")
def m5_representation_variants(spark: SparkSession, sf: str) -> DataFrame:
    _, fitted = geometry.representation_variants(panel_states(spark, sf), (16, 32, 64))
    return rounded(variance_rows(spark, fitted))


# --- M6, M16: paired rows ------------------------------------------------------------------------


def neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """Each vector beside the one with the next id."""
    rows = src.vectors(spark, sf)
    following = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vector").alias("candidate"))
    return rows.withColumnRenamed("vector", "reference").join(following, "vec_id")


fragment(
    "pair_stats",
    """SELECT label, vec_id, CASE WHEN na * nb > 1e-12 THEN ab / (na * nb) ELSE 0 END AS cosine,
    sqrt(dd) / greatest(na, 1e-12) AS relative_l2 FROM (
      SELECT a.label, a.vec_id, sum(a.v * b.v) AS ab, sqrt(sum(a.v * a.v)) AS na, sqrt(sum(b.v * b.v)) AS nb,
      sum((b.v - a.v) * (b.v - a.v)) AS dd FROM zlong a JOIN zlong b ON b.vec_id = a.vec_id + 1 AND a.i = b.i GROUP BY 1, 2)""",
    "zlong",
)


@query(
    "m6_paired_distance",
    with_tables(
        """SELECT label, count(*) AS pair_count, round(avg(cosine), 6) AS mean_cosine_similarity,
        round(quantile_cont(cosine, 0.5), 6) AS median_cosine_similarity, round(avg(relative_l2), 6) AS mean_relative_l2_distance,
        round(quantile_cont(relative_l2, 0.5), 6) AS median_relative_l2_distance FROM pair_stats GROUP BY 1""",
        "pair_stats",
    ),
)
def m6_paired_distance(spark: SparkSession, sf: str) -> DataFrame:
    distances = geometry.paired_distances(neighbours(spark, sf), "reference", "candidate")
    return rounded(geometry.distance_summary(distances, ["label"], median))


@query(
    "m16_normalized_error",
    with_tables(
        "SELECT round(sum((label + 1) * (2 - 2 * cosine)) / sum(label + 1), 6) AS weighted_error, count(*) AS pair_count FROM pair_stats",
        "pair_stats",
    ),
)
def m16_normalized_error(spark: SparkSession, sf: str) -> DataFrame:
    """Normalized error of neighbouring vectors, weighted by label plus one."""
    errors = geometry.normalized_error(neighbours(spark, sf), "candidate", "reference")
    weight = F.col("label") + 1
    return rounded(
        errors.agg(
            (F.sum(weight * F.col("error")) / F.sum(weight)).alias("weighted_error"),
            F.count(F.lit(1)).alias("pair_count"),
        )
    )


# --- M7-M10, M15: geometry -------------------------------------------------------------------------

SIMILARITY = ["similarity_mean", "similarity_median", "similarity_std", "similarity_min", "similarity_max"]
DISTANCE = [c.replace("similarity", "distance") for c in SIMILARITY]
PAIR_SQL = """SELECT a.split, sum(a.v * b.v) / (sqrt(sum(a.v * a.v)) * sqrt(sum(b.v * b.v))) AS c
    FROM zday_long a JOIN zday_long b ON a.split = b.split AND a.i = b.i AND a.pos < b.pos GROUP BY a.split, a.pos, b.pos"""


def similarity_sql(count: str, value: str = "c") -> str:
    return (
        f"count(*) AS {count}, round(avg({value}), 6) AS similarity_mean, round(quantile_cont({value}, 0.5), 6) AS similarity_median, "
        f"round(stddev_pop({value}), 6) AS similarity_std, round(min({value}), 6) AS similarity_min, "
        f"round(max({value}), 6) AS similarity_max, round(1 - avg({value}), 6) AS distance_mean, "
        f"round(1 - quantile_cont({value}, 0.5), 6) AS distance_median, round(stddev_pop({value}), 6) AS distance_std, "
        f"round(1 - max({value}), 6) AS distance_min, round(1 - min({value}), 6) AS distance_max"
    )


@query(
    "m7_pairwise_cosine",
    with_tables(f"SELECT split, {similarity_sql('pair_count')} FROM ({PAIR_SQL}) GROUP BY split", "zday_long"),
)
def m7_pairwise_cosine(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs of daily states, one state per calendar day."""
    return rounded(geometry.pairwise_cosine_summary(z_days(spark, sf), ["split"], "pos", "vector"))


@query(
    "m7_mean_cosine_by_label",
    with_tables(
        """SELECT label, round(avg(c), 6) AS similarity_mean, round(stddev_pop(c), 6) AS similarity_std FROM (
        SELECT a.label, sum(a.v * b.v) / (sqrt(sum(a.v * a.v)) * sqrt(sum(b.v * b.v))) AS c FROM zlong a JOIN zlong b
        ON a.label = b.label AND a.i = b.i AND a.vec_id < b.vec_id GROUP BY a.label, a.vec_id, b.vec_id) GROUP BY label""",
        "zlong",
    ),
)
def m7_mean_cosine_by_label(spark: SparkSession, sf: str) -> DataFrame:
    """Closed form over the whole table: one pass, no pair of rows is formed."""

    def measure(m):
        mean, spread = geometry.cosine_moments(m)
        return {"similarity_mean": mean, "similarity_std": spread}

    packed = geometry.moments(src.vectors(spark, sf), ["label"], "vector", geometry=True)
    return rounded(geometry.per_key_metrics(packed, ["label"], ["similarity_mean", "similarity_std"], measure))


@query(
    "m8_dimension_moments",
    with_tables(
        "SELECT label, CAST(i AS INTEGER) AS dimension, count(*) AS sample_count, round(avg(v), 6) AS mean, "
        "round(var_samp(v), 6) AS sample_variance FROM zlong GROUP BY 1, 2",
        "zlong",
    ),
)
def m8_dimension_moments(spark: SparkSession, sf: str) -> DataFrame:
    rows = geometry.collapse_diagnostics(src.vectors(spark, sf), ["label"], "vector")
    return rounded(rows.select("label", "dimension", "sample_count", "mean", "sample_variance"))


@query("m8_collapse_diagnostics")
def m8_collapse_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    rows = geometry.collapse_diagnostics(src.vectors(spark, sf), ["label"], "vector")
    return rounded(rows.drop("covariance_row", "correlation_row"))


@query("m9_rank_metrics")
def m9_rank_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(geometry.rank_metrics(z_days(spark, sf), ["split"], "pos", "vector"))


@query(
    "m9_mean_metrics",
    with_tables(
        f"""SELECT n.split, n.sample_count, round(p.mean_c, 6) AS mean_pairwise_cosine, round(p.median_c, 6) AS median_pairwise_cosine,
        round(n.mean_norm, 6) AS mean_vector_norm FROM (SELECT split, count(*) AS sample_count, avg(s) AS mean_norm FROM
          (SELECT split, pos, sqrt(sum(v * v)) AS s FROM zday_long GROUP BY 1, 2) GROUP BY 1) n
        JOIN (SELECT split, avg(c) AS mean_c, quantile_cont(c, 0.5) AS median_c FROM ({PAIR_SQL}) GROUP BY 1) p ON n.split = p.split""",
        "zday_long",
    ),
)
def m9_mean_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """The rank metrics that need no eigenvalues."""
    rows = geometry.rank_metrics(z_days(spark, sf), ["split"], "pos", "vector")
    return rounded(
        rows.select(
            "split",
            F.col("sample_count").cast("bigint").alias("sample_count"),
            "mean_pairwise_cosine",
            "median_pairwise_cosine",
            "mean_vector_norm",
        )
    )


COMPARED = [*geometry.RANK_METRICS, "median_pairwise_cosine"]


def windowed_ranks(spark: SparkSession, sf: str) -> DataFrame:
    rows = geometry.matched_blocks(z_days(spark, sf))
    metrics = geometry.rank_metrics(rows, ["validation_window_name", "block"], "pos", "vector")
    return geometry.compare_with_history(metrics, COMPARED)


@query("m10_matched_history_rank")
def m10_matched_history_rank(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(windowed_ranks(spark, sf))


@query(
    "m10_matched_blocks",
    with_tables(
        """SELECT validation_window_name, CAST(block AS INTEGER) AS block, CAST(min(pos) AS INTEGER) AS first_pos,
        CAST(max(pos) AS INTEGER) AS last_pos, count(*) AS day_count FROM (
          SELECT w.name AS validation_window_name, h.pos, unnest(list_filter([
            CASE WHEN h.r // w.len < w.m // w.len THEN h.r // w.len END,
            CASE WHEN w.m % w.len <> 0 AND h.r >= w.m - w.len THEN w.m // w.len END], lambda x: x IS NOT NULL)) AS block
          FROM (SELECT v.name, v.start, v.len, (SELECT count(*) FROM zdays z WHERE z.split = 'train' AND z.pos < v.start) AS m
            FROM (SELECT validation_window_name AS name, min(pos) AS start, count(*) AS len FROM zdays
              WHERE split = 'validation' GROUP BY 1) v) w
          JOIN (SELECT pos, row_number() OVER (ORDER BY pos) - 1 AS r FROM zdays WHERE split = 'train') h ON h.pos < w.start
          UNION ALL SELECT validation_window_name, pos, -1 FROM zdays WHERE split = 'validation') GROUP BY 1, 2""",
        "zdays",
    ),
)
def m10_matched_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return geometry.matched_blocks(z_days(spark, sf)).groupBy("validation_window_name", "block").agg(
        F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.count(F.lit(1)).alias("day_count")
    )


@query(
    "m15_spread_statistics",
    with_tables(
        """SELECT s.label, round(s.m, 6) AS mean_feature_std, round(greatest(0.1 - s.m, 0), 6) AS variance_hinge,
        round(c.e, 6) AS covariance_energy FROM (SELECT label, avg(sqrt(x + 1e-4)) AS m FROM
          (SELECT label, i, var_samp(v) AS x FROM zlong GROUP BY 1, 2) GROUP BY 1) s
        JOIN (SELECT label, sum(x * x) / 64 AS e FROM (SELECT a.label, covar_samp(a.v, b.v) AS x FROM zlong a JOIN zlong b
          ON a.vec_id = b.vec_id AND a.i <> b.i GROUP BY a.label, a.i, b.i) GROUP BY 1) c ON s.label = c.label""",
        "zlong",
    ),
)
def m15_spread_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(geometry.spread_statistics(src.vectors(spark, sf), ["label"], "vector"))


# --- M11-M13: stability and ablations --------------------------------------------------------------

PAIRED = "a.split = b.split AND a.sample_date_idx = b.sample_date_idx AND a.half = b.half AND a.slot = b.slot"


def stability_values(spark: SparkSession, sf: str, column: str = "pooled_state") -> DataFrame:
    """Cosine of each sample's all-asset state with its state in every k-asset view."""
    whole = panel_states(spark, sf).select(*samples.SAMPLE, F.col(column).alias("whole"))
    views = None
    for v in VIEWS:
        one = ds.fixed_view(spark, sf, ds.FIXED_K, v).withColumn("view", F.lit(f"view_{v}"))
        views = one if views is None else views.unionByName(one)
    parts = build_states(spark, sf, views).select("view", *samples.SAMPLE, F.col(column).alias("part"))
    return whole.join(parts, samples.SAMPLE).select("view", *samples.SAMPLE, cosine("whole", "part").alias("similarity"))


def stability(values: DataFrame) -> DataFrame:
    """Statistics per view and over all views."""
    both = values.select(F.explode(F.array(F.col("view"), F.lit("pooled"))).alias("view"), "similarity")
    return geometry.similarity_stats(both, ["view"], median)


STABILITY_ROWS = " UNION ALL ".join(
    f"SELECT 'view_{v}' AS view, a.split, a.sample_date_idx, sum(a.v * b.v) / (sqrt(sum(a.v * a.v)) * sqrt(sum(b.v * b.v))) AS c "
    f"FROM state_all a JOIN state_view_{v} b ON {PAIRED} GROUP BY 1, 2, 3"
    for v in VIEWS
)


@query(
    "m11_view_stability",
    with_tables(
        f"SELECT view, {similarity_sql('sample_count')} FROM (SELECT view, c FROM ({STABILITY_ROWS}) UNION ALL "
        f"SELECT 'pooled', c FROM ({STABILITY_ROWS})) GROUP BY view",
        "state_all",
        *[f"state_view_{v}" for v in VIEWS],
    ),
)
def m11_view_stability(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stability(stability_values(spark, sf)))


def ablation_report(pairs: DataFrame, key: str) -> DataFrame:
    """Distance to the reference state and effective rank of the candidate state per setting."""
    distances = geometry.distance_summary(
        geometry.paired_distances(pairs, "reference", "candidate"), [key], median
    )
    ranks = geometry.per_key_metrics(
        geometry.moments(pairs, [key], "candidate", geometry=True),
        [key],
        ["effective_rank"],
        lambda m: {"effective_rank": geometry.effective_rank(geometry.spectrum(m))},
    )
    return distances.join(ranks, key)


ASSET_COUNTS = (2, 4, 6)


@query("m12_asset_count_ablation")
def m12_asset_count_ablation(spark: SparkSession, sf: str) -> DataFrame:
    whole = panel_states(spark, sf).filter("split = 'validation'")
    reference = whole.select(*samples.SAMPLE, F.col("pooled_state").alias("reference"))
    views = None
    for k in ASSET_COUNTS:
        one = ds.fixed_view(spark, sf, k).withColumn("asset_view", F.lit(f"k_{k}"))
        views = one if views is None else views.unionByName(one)
    chosen = build_states(spark, sf, views.filter("split = 'validation'"))
    pairs = reference.select(
        F.lit("all_valid").alias("asset_view"), "reference", F.col("reference").alias("candidate")
    ).unionByName(
        reference.join(chosen.select("asset_view", *samples.SAMPLE, F.col("pooled_state").alias("candidate")), samples.SAMPLE).select(
            "asset_view", "reference", "candidate"
        )
    )
    return rounded(ablation_report(pairs, "asset_view"))


def input_pairs(spark: SparkSession, sf: str) -> DataFrame:
    whole = panel_states(spark, sf).filter("split = 'validation'")
    modes = F.array(
        *[
            F.struct(
                F.lit(mode).alias("input_mode"), states.without_stream("pooled_state", NAMES, mode).alias("candidate")
            )
            for mode in states.INPUT_MODES
        ]
    )
    return whole.select(F.col("pooled_state").alias("reference"), F.explode(modes).alias("m")).select(
        "m.input_mode", "reference", "m.candidate"
    )


def _dropped_slots(mode: str) -> str:
    dropped = states.INPUT_MODES[mode]
    if dropped is None:
        return "false"
    start = sum(len(NAMES[g]) for g in states.STREAMS[: states.STREAMS.index(dropped)])
    return f"slot BETWEEN {start} AND {start + len(NAMES[dropped]) - 1}"


INPUT_SQL = " UNION ALL ".join(
    f"SELECT '{mode}' AS input_mode, sqrt(sum(v * v)) AS na, sqrt(sum(CASE WHEN {_dropped_slots(mode)} THEN 0 ELSE v * v END)) AS nb, "
    f"sum(CASE WHEN {_dropped_slots(mode)} THEN 0 ELSE v * v END) AS ab, sum(CASE WHEN {_dropped_slots(mode)} THEN v * v ELSE 0 END) AS dd "
    f"FROM state_all WHERE split = 'validation' GROUP BY split, sample_date_idx"
    for mode in states.INPUT_MODES
)


@query(
    "m13_input_ablation_distance",
    with_tables(
        f"""SELECT input_mode, count(*) AS pair_count, round(avg(c), 6) AS mean_cosine_similarity,
        round(quantile_cont(c, 0.5), 6) AS median_cosine_similarity, round(avg(d), 6) AS mean_relative_l2_distance,
        round(quantile_cont(d, 0.5), 6) AS median_relative_l2_distance FROM (SELECT input_mode,
        CASE WHEN na * nb > 1e-12 THEN ab / (na * nb) ELSE 0 END AS c, sqrt(dd) / greatest(na, 1e-12) AS d FROM ({INPUT_SQL})) GROUP BY 1""",
        "state_all",
    ),
)
def m13_input_ablation_distance(spark: SparkSession, sf: str) -> DataFrame:
    distances = geometry.paired_distances(input_pairs(spark, sf), "reference", "candidate")
    return rounded(geometry.distance_summary(distances, ["input_mode"], median))


@query("m13_input_ablation")
def m13_input_ablation(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ablation_report(input_pairs(spark, sf), "input_mode"))


# --- M14, M17: exports ---------------------------------------------------------------------------------

VERSIONS = {"dataset_version": t.DATASET_VERSION, "representation_variant": "pooled_raw_64"}


@query(
    "m14_coordinates",
    with_tables(
        "SELECT date, split, validation_window_name, "
        + ", ".join(f"round(max(CASE WHEN i = {i + 1} THEN v END), 6) AS z_{i + 1}" for i in range(DIM))
        + "".join(f", '{v}' AS {k}" for k, v in VERSIONS.items())
        + " FROM zday_long GROUP BY 1, 2, 3",
        "zday_long",
    ),
)
def m14_coordinates(spark: SparkSession, sf: str) -> DataFrame:
    rows = z_days(spark, sf).drop("pos")
    return rounded(geometry.coordinates(rows, "vector", DIM, VERSIONS))


@query(
    "m17_matched_cosine",
    with_tables("SELECT label, round(avg(cosine), 6) AS matched_cosine, count(*) AS pair_count FROM pair_stats GROUP BY 1", "pair_stats"),
)
def m17_matched_cosine(spark: SparkSession, sf: str) -> DataFrame:
    """Mean cosine of matched vector pairs per label."""
    pairs = neighbours(spark, sf)
    return rounded(
        pairs.groupBy("label").agg(
            F.avg(cosine("reference", "candidate")).alias("matched_cosine"), F.count(F.lit(1)).alias("pair_count")
        )
    )


@query("m17_compact_summary")
def m17_compact_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Rank, cosine and stability figures of raw and PCA states side by side."""
    pooled = panel_states(spark, sf)
    pca = geometry.fit_pca(pooled.filter("split = 'train'"), "pooled_state", PCA_SIZE)
    projected = geometry.apply_pca(pooled, "pooled_state", pca, "pca_state").filter("split = 'validation'")
    rows = None
    for name, column in (("raw", "pooled_state"), ("pca", "pca_state")):
        ranks = geometry.rank_metrics(projected, ["split"], "sample_date_idx", column)
        one = ranks.unpivot(["split"], COMPARED, "metric", "value").select(
            F.lit(name).alias("representation"), "metric", "value"
        )
        rows = one if rows is None else rows.unionByName(one)
    kept = spark.createDataFrame(
        [("pca", f"explained_variance_ratio_{i + 1}", float(r)) for i, r in enumerate(pca.ratio)],
        "representation string, metric string, value double",
    )
    stable = stability(stability_values(spark, sf)).filter("view = 'pooled'")
    stable = stable.unpivot([], SIMILARITY, "metric", "value").select(
        F.lit("raw").alias("representation"), F.concat(F.lit("view_"), "metric").alias("metric"), "value"
    )
    return rounded(rows.unionByName(kept).unionByName(stable))
