"""Date, asset and feature manifests; purged walk-forward splits."""

from __future__ import annotations

from fnmatch import fnmatchcase

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeweave.functions.expr import any_of
from tapeweave.functions.ordered import with_positions


def date_spine(dates: DataFrame, context_start: str, sample_end: str | None = None) -> DataFrame:
    """Distinct dates of the configured range with a dense index.

    One row per day at most, so a single ordered window over it is cheap at any scale.
    """
    kept = dates.select("date").distinct().filter(F.col("date") >= F.lit(context_start).cast("date"))
    if sample_end is not None:
        kept = kept.filter(F.col("date") <= F.lit(sample_end).cast("date"))
    return kept.select("date", (F.row_number().over(Window.orderBy("date")) - 1).alias("date_idx"))


def with_sample_eligibility(
    spine: DataFrame, sample_dates: DataFrame, sample_start: str, sample_end: str | None = None
) -> DataFrame:
    """Eligible: the reference instrument was observed and the date is in the sample range."""
    observed = sample_dates.select("date", F.lit(True).alias("_observed")).distinct()
    inside = F.col("date") >= F.lit(sample_start).cast("date")
    if sample_end is not None:
        inside = inside & (F.col("date") <= F.lit(sample_end).cast("date"))
    return spine.join(observed, "date", "left").select(
        *spine.columns, (F.coalesce("_observed", F.lit(False)) & inside).alias("sample_eligible")
    )


def _inside(window: tuple[str, str, str]):
    _, start, end = window
    return F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))


def window_bounds(eligible: DataFrame, windows: list[tuple[str, str, str]]) -> DataFrame:
    """First and last eligible position of each configured validation window."""
    labels = F.array_compact(
        F.array(*[F.when(_inside(w) & F.col("sample_eligible"), F.lit(w[0])) for w in windows])
    )
    return (
        eligible.select("date_idx", F.explode(labels).alias("window_name"))
        .groupBy("window_name")
        .agg(F.min("date_idx").alias("first_idx"), F.max("date_idx").alias("last_idx"))
    )


def require_windows(bounds: DataFrame, windows: list[tuple[str, str, str]]) -> None:
    empty = {w[0] for w in windows} - {r.window_name for r in bounds.collect()}
    if empty:
        raise ValueError(f"validation windows without sample dates: {sorted(empty)}")


def date_manifest(
    eligible: DataFrame, windows: list[tuple[str, str, str]], lookback: int, horizon: int
) -> DataFrame:
    """Protection flags and split permissions per date.

    Each window unfolds into the positions it protects, which meet the spine by equality.
    A date between a window's ends that is not eligible carries the name but no flag.
    """
    bounds = window_bounds(eligible, windows)
    regions = bounds.select(
        "window_name",
        "first_idx",
        "last_idx",
        F.explode(
            F.sequence(F.greatest(F.lit(0), F.col("first_idx") - max(lookback - 1, 0)), F.col("last_idx") + horizon)
        ).alias("date_idx"),
    )
    flags = regions.groupBy("date_idx").agg(
        F.max(F.col("date_idx") < F.col("first_idx")).alias("_lookback"),
        F.max(F.col("date_idx") > F.col("last_idx")).alias("_forward"),
        F.array_join(F.array_sort(F.collect_set("window_name")), "|").alias("validation_window_name"),
    )
    no = F.lit(False)
    sample = F.col("sample_eligible") & any_of([_inside(w) for w in windows])
    flagged = eligible.join(flags, "date_idx", "left").select(
        "date_idx",
        "date",
        "sample_eligible",
        sample.alias("validation_sample"),
        (F.coalesce("_lookback", no) & ~sample).alias("protected_input_lookback"),
        (F.coalesce("_forward", no) & ~sample & ~F.coalesce("_lookback", no)).alias("protected_forward_target"),
        "validation_window_name",
    )
    holdout = F.col("validation_sample") | F.col("protected_input_lookback") | F.col("protected_forward_target")
    return flagged.select(
        "date_idx",
        "date",
        "sample_eligible",
        "validation_sample",
        "protected_input_lookback",
        "protected_forward_target",
        holdout.alias("protected_holdout"),
        (~holdout).alias("train_fact_allowed"),
        holdout.alias("validation_fact_allowed"),
        "validation_window_name",
    )


def asset_manifest(
    manifest: DataFrame,
    panel: DataFrame,
    dates: DataFrame,
    include_types: list[str] | None = None,
    include_symbols: list[str] | None = None,
    exclude_symbols: list[str] | None = None,
    minimum: int = 63,
) -> DataFrame:
    """Selected assets with their valid train rows, trainability and a dense id by symbol."""
    chosen = manifest.select("symbol", "asset_type", "first_available_date", "last_available_date")
    if include_types:
        chosen = chosen.filter(F.col("asset_type").isin(*include_types))
    if include_symbols:
        chosen = chosen.filter(F.col("symbol").isin(*include_symbols))
    if exclude_symbols:
        chosen = chosen.filter(~F.col("symbol").isin(*exclude_symbols))
    train_days = dates.filter("train_fact_allowed").select("date")
    counts = (
        panel.filter("valid_observation")
        .select("symbol", "date")
        .join(train_days, "date", "left_semi")
        .groupBy("symbol")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    n = F.coalesce("_n", F.lit(0))
    return with_positions(chosen.join(counts, "symbol", "left"), ["symbol"], "asset_id").select(
        F.col("asset_id").cast("int").alias("asset_id"),
        *chosen.columns,
        n.alias("valid_train_observations"),
        (n >= minimum).alias("trainable"),
        F.when(n < minimum, f"fewer_than_{minimum}_valid_train_observations").alias("exclusion_reason"),
    )


def feature_rows(
    families: dict[str, list[dict]], transforms: dict[str, list[str]]
) -> list[tuple[str, int, str, str, str, str]]:
    """(group, index, name, family, source, transform); the last matching pattern wins."""
    rows = []
    for group, members in families.items():
        index = 0
        seen = set()
        for family in members:
            for name in family["names"]:
                if name in seen:
                    raise ValueError(f"feature {group}.{name} is configured twice")
                seen.add(name)
                transform = "none"
                for kind, patterns in transforms.items():
                    if any(fnmatchcase(name, p) for p in patterns):
                        transform = kind
                rows.append((group, index, name, family["feature_family"], family["series_source"], transform))
                index += 1
    return rows


def feature_manifest(spark: SparkSession, families: dict[str, list[dict]], transforms: dict[str, list[str]]) -> DataFrame:
    return spark.createDataFrame(
        feature_rows(families, transforms),
        "input_group string, feature_index int, feature_name string, feature_family string, "
        "series_source string, transform string",
    )


# --- walk-forward splits over probe rows --------------------------------------------


def positions(dates: DataFrame) -> DataFrame:
    """Dense position of each distinct date; calendar-sized."""
    return dates.select("date").distinct().select(
        "date", (F.row_number().over(Window.orderBy("date")) - 1).alias("pos")
    )


def outer_windows(rows: DataFrame) -> DataFrame:
    """Validation windows of positioned rows with the position they start at."""
    return (
        rows.filter((F.col("split") == "validation") & (F.coalesce("validation_window_name", F.lit("")) != ""))
        .groupBy("validation_window_name")
        .agg(F.min("pos").alias("start_pos"), F.min("date").alias("start_date"))
    )


def outer_train(rows: DataFrame, windows: DataFrame, horizon: int | Column = 0) -> DataFrame:
    """Train rows before each window's start; with a horizon, only those whose outcome ends before it.

    Windows are a few named rows: each train row unfolds into the windows it precedes.
    """
    bounds = windows.agg(
        F.collect_list(F.struct(F.col("validation_window_name").alias("name"), F.col("start_pos").alias("start")))
    ).scalar()
    reach = F.col("pos") + (F.lit(horizon) if isinstance(horizon, int) else horizon)
    return (
        rows.filter(F.col("split") == "train")
        .select("*", bounds.alias("_windows"))
        .select(
            *[c for c in rows.columns if c != "validation_window_name"],
            F.explode(F.filter("_windows", lambda w: reach < w["start"])).alias("_window"),
        )
        .select("*", F.col("_window.name").alias("validation_window_name"))
        .drop("_window")
    )


MIN_HISTORY = 19


def fold_blocks(train: DataFrame, keys: list[str], horizon: str = "horizon") -> DataFrame:
    """Validation block 1..3 of each key's train dates; early history belongs to no block.

    A key's rows are one per date, so its ordered window is calendar-sized.
    """
    own = Window.partitionBy(*keys)
    late = F.col("pos") > F.min("pos").over(own) + F.col(horizon) + MIN_HISTORY
    marked = train.select("*", late.alias("_late"))
    block = F.ntile(3).over(Window.partitionBy(*keys, "_late").orderBy("pos"))
    return marked.select(*train.columns, F.when(F.col("_late"), block).alias("block"))


def expanding_folds(train: DataFrame, keys: list[str], horizon: str = "horizon") -> DataFrame:
    """Three expanding folds per key: rows with fold and role 'fit' or 'score'.

    Keys without three usable folds (each at least two fit rows and one scored row) have none.
    """
    blocks = fold_blocks(train, keys, horizon)
    own = Window.partitionBy(*keys)
    starts = F.array(*[F.min(F.when(F.col("block") == b, F.col("pos"))).over(own) for b in (1, 2, 3)])
    started = blocks.select("*", starts.alias("_starts"))
    numbered = started.select(
        *train.columns,
        F.explode(
            F.transform(
                F.array(F.lit(1), F.lit(2), F.lit(3)),
                lambda b: F.struct(
                    b.alias("fold"),
                    F.when(F.col("block") == b, "score")
                    .when(F.col("pos") + F.col(horizon) < F.element_at("_starts", b), "fit")
                    .alias("role"),
                ),
            )
        ).alias("_fold"),
    ).select(*train.columns, "_fold.fold", "_fold.role").filter("role IS NOT NULL")
    per_fold = numbered.groupBy(*keys, "fold").agg(
        F.count_if(F.col("role") == "fit").alias("fit_rows"),
        F.count_if(F.col("role") == "score").alias("score_rows"),
    )
    usable = (
        per_fold.filter("fit_rows >= 2 AND score_rows >= 1")
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_folds"))
        .filter("_folds = 3")
        .select(*keys)
    )
    return numbered.join(usable, keys, "left_semi")
