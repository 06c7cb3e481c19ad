"""Windowed samples over sparse facts: requests, views, patches and patch masks.

Positions are date_idx values of the date spine. A patch is fixed by the position of its
last day, so per-asset patch counts are computed once per patch end (facts times patch
length) and shared by every sample, instead of unfolding each sample's whole lookback.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeweave.functions.ordered import exact_percentiles, lowest_by_hash


@dataclass(frozen=True)
class WindowConfig:
    lookback: int = 252
    patch_len: int = 6
    min_days_per_asset_patch: int = 4
    min_dates_in_patch: int = 4
    min_asset_fraction: float = 0.25
    mask_ratio: float = 0.35
    min_masked: int = 5
    max_masked: int = 15
    min_blocks: int = 1
    max_blocks: int = 2
    feature_dropout_rate: float = 0.20
    seed: int = 1337

    def __post_init__(self) -> None:
        if self.lookback % self.patch_len:
            raise ValueError("the lookback must be a whole number of patches")

    @property
    def patches(self) -> int:
        return self.lookback // self.patch_len


SAMPLE = ["split", "sample_date_idx"]


def request_index(dates: DataFrame, asset_facts: DataFrame) -> DataFrame:
    """Train and validation endpoints with their count of valid assets that day."""
    split = F.when(F.col("validation_sample"), "validation").when(
        F.col("sample_eligible") & F.col("train_fact_allowed"), "train"
    )
    counts = asset_facts.groupBy("split", "date_idx").agg(
        F.count_if("valid_asset").alias("n_endpoint_valid_assets")
    )
    return (
        dates.select(
            split.alias("split"),
            "date_idx",
            F.col("date").alias("sample_date"),
            F.coalesce("validation_window_name", F.lit("")).alias("validation_window_name"),
        )
        .filter("split IS NOT NULL")
        .join(counts, ["split", "date_idx"], "left")
        .select(
            "split",
            F.col("date_idx").alias("sample_date_idx"),
            "sample_date",
            F.coalesce("n_endpoint_valid_assets", F.lit(0)).alias("n_endpoint_valid_assets"),
            "validation_window_name",
        )
    )


def short_history(requests: DataFrame, config: WindowConfig) -> DataFrame:
    """Endpoints without a full lookback behind them."""
    return requests.filter(F.col("sample_date_idx") < config.lookback - 1)


def with_history(requests: DataFrame, config: WindowConfig, short: str = "refuse") -> DataFrame:
    """Endpoints with a full lookback; without one they are refused or, on request, dropped."""
    if one_of(short, "refuse", "drop") == "refuse":
        return require_history(requests, config)
    return requests.filter(F.col("sample_date_idx") >= config.lookback - 1)


def require_history(requests: DataFrame, config: WindowConfig) -> DataFrame:
    lacking = short_history(requests, config).count()
    if lacking:
        raise ValueError(f"{lacking} endpoints lack {config.lookback} days of history")
    return requests


def one_of(choice: str, *allowed: str) -> str:
    if choice not in allowed:
        raise ValueError(f"{choice!r} is none of {', '.join(allowed)}")
    return choice


def window_days(requests: DataFrame, config: WindowConfig) -> DataFrame:
    """One row per sample and lookback day with its position, patch and day in the patch."""
    position = F.col("position")
    return requests.select(
        *SAMPLE,
        F.posexplode(
            F.sequence(F.col("sample_date_idx") - (config.lookback - 1), F.col("sample_date_idx"))
        ).alias("position", "date_idx"),
    ).select(
        "*",
        F.floor(position / config.patch_len).cast("int").alias("patch"),
        (position % config.patch_len).cast("int").alias("day_in_patch"),
    )


def lookback_facts(requests: DataFrame, facts: DataFrame, config: WindowConfig) -> DataFrame:
    """Facts of each sample's lookback, met by equality on split and position."""
    return window_days(requests, config).join(facts, ["split", "date_idx"])


def dense_panel(
    facts: DataFrame, dates: DataFrame, assets: DataFrame | None, features: list[str], valid: str
) -> DataFrame:
    """Every position (and asset) of both splits; absent facts are 0 with a false mask."""
    splits = F.explode(F.array(F.lit("train"), F.lit("validation"))).alias("split")
    keys = ["split", "date_idx"]
    spine = dates.select(splits, "date_idx")
    if assets is not None:
        days = dates.agg(F.array_sort(F.collect_set("date_idx"))).scalar()
        spine = assets.select(splits, "asset_id").select("split", "asset_id", F.explode(days).alias("date_idx"))
        keys.append("asset_id")
    filled = []
    for f in features:
        filled += [
            F.coalesce(F.col(f), F.lit(0.0).cast("float")).alias(f),
            F.coalesce(F.col(f"{f}__valid"), F.lit(False)).alias(f"{f}__valid"),
        ]
    return spine.join(facts, keys, "left").select(*keys, F.coalesce(valid, F.lit(False)).alias(valid), *filled)


# --- asset views --------------------------------------------------------------------------


def all_assets_view(requests: DataFrame, assets: DataFrame) -> DataFrame:
    """The whole asset axis for every sample."""
    ids = assets.agg(F.array_sort(F.collect_set("asset_id"))).scalar()
    return requests.select(*SAMPLE, F.explode(ids).alias("asset_id"))


def endpoint_assets(requests: DataFrame, asset_facts: DataFrame) -> DataFrame:
    """Assets valid on the sample's own last day."""
    present = asset_facts.filter("valid_asset").select(
        "split", F.col("date_idx").alias("sample_date_idx"), "asset_id"
    )
    return requests.select(*SAMPLE, "sample_date").join(present, SAMPLE)


def _ranked_view(requests: DataFrame, asset_facts: DataFrame, digest: Column, k: int) -> DataFrame:
    """The k assets with the lowest digest; a sample has at most one row per asset."""
    order = Window.partitionBy(*SAMPLE).orderBy("digest", "asset_id")
    return (
        endpoint_assets(requests, asset_facts)
        .select(*SAMPLE, "asset_id", digest.alias("digest"))
        .select("*", F.row_number().over(order).alias("view_rank"))
        .filter(F.col("view_rank") <= k)
        .select(*SAMPLE, "asset_id")
    )


def fixed_view(
    requests: DataFrame, asset_facts: DataFrame, version: str, k: int, view_index: int = 0, short: str = "refuse"
) -> DataFrame:
    """k endpoint assets ranked by SHA-256 of version|date|view|k|asset.

    Samples with fewer than k are refused or, on request, kept with all they have.
    """
    if one_of(short, "refuse", "keep") == "refuse":
        require_view_size(requests, asset_facts, k)
    text = F.concat_ws(
        "|", F.lit(version), F.col("sample_date").cast("string"), F.lit(str(view_index)), F.lit(str(k)),
        F.col("asset_id").cast("string"),
    )
    return _ranked_view(requests, asset_facts, F.sha2(text, 256), k)


def random_view(
    requests: DataFrame,
    asset_facts: DataFrame,
    k: int,
    seed: int,
    epoch: int = 0,
    view_index: int = 0,
    short: str = "refuse",
) -> DataFrame:
    """k endpoint assets without replacement, drawn by a hash keyed on seed, date, epoch and view.

    Only train samples follow the epoch. Samples with fewer than k are refused or, on
    request, kept with all they have.
    """
    if one_of(short, "refuse", "keep") == "refuse":
        require_view_size(requests, asset_facts, k)
    step = F.when(F.col("split") == "train", F.lit(str(epoch))).otherwise("0")
    text = F.concat_ws(
        "|", F.lit(str(seed)), F.col("sample_date_idx").cast("string"), step, F.lit(str(view_index)),
        F.col("asset_id").cast("string"),
    )
    return _ranked_view(requests, asset_facts, F.sha2(text, 256), k)


def short_views(requests: DataFrame, asset_facts: DataFrame, k: int) -> DataFrame:
    """Samples with fewer than k valid endpoint assets, none included."""
    present = endpoint_assets(requests, asset_facts).groupBy(*SAMPLE).agg(F.count(F.lit(1)).alias("_present"))
    n = F.coalesce("_present", F.lit(0))
    found = requests.select(*SAMPLE).join(present, SAMPLE, "left").filter(n < k)
    return found.select(*SAMPLE, n.alias("n_endpoint_valid_assets"), F.lit(k).alias("view_size"))


def require_view_size(requests: DataFrame, asset_facts: DataFrame, k: int) -> DataFrame:
    lacking = short_views(requests, asset_facts, k).count()
    if lacking:
        raise ValueError(f"{lacking} samples have fewer than {k} valid endpoint assets")
    return requests


# --- patch masks ----------------------------------------------------------------------------


def _patch_ends(position: str, patch_len: int) -> Column:
    return F.explode(F.sequence(F.col(position), F.col(position) + (patch_len - 1))).alias("patch_end")


def asset_patch_ends(asset_facts: DataFrame, config: WindowConfig) -> DataFrame:
    """Assets with enough valid days in the patch that ends at patch_end."""
    return (
        asset_facts.filter("valid_asset")
        .select("split", "asset_id", _patch_ends("date_idx", config.patch_len))
        .groupBy("split", "asset_id", "patch_end")
        .agg(F.count(F.lit(1)).alias("valid_days"))
        .filter(F.col("valid_days") >= config.min_days_per_asset_patch)
    )


def date_validity(
    dates: DataFrame, asset_facts: DataFrame, market_facts: DataFrame, macro_facts: DataFrame
) -> DataFrame:
    """Per split and position: any stream valid, and whether the date may be a target."""
    usable = (
        market_facts.filter("valid_date").select("split", "date_idx")
        .unionByName(macro_facts.filter("valid_date").select("split", "date_idx"))
        .unionByName(asset_facts.filter("valid_asset").select("split", "date_idx"))
        .distinct()
        .withColumn("valid_date", F.lit(True))
    )
    return _target_dates(dates).join(usable, ["split", "date_idx"], "left").select(
        "split", "date_idx", F.coalesce("valid_date", F.lit(False)).alias("valid_date"), "target_date"
    )


def _target_dates(dates: DataFrame) -> DataFrame:
    allowed = F.explode(
        F.array(
            F.struct(F.lit("train").alias("split"), F.col("train_fact_allowed").alias("target_date")),
            F.struct(F.lit("validation").alias("split"), F.lit(True).alias("target_date")),
        )
    ).alias("_side")
    return dates.select("date_idx", allowed).select("_side.split", "date_idx", "_side.target_date")


def date_patch_ends(validity: DataFrame, config: WindowConfig) -> DataFrame:
    """Valid and target-allowed days of the patch that ends at patch_end."""
    return (
        validity.select("split", "valid_date", "target_date", _patch_ends("date_idx", config.patch_len))
        .groupBy("split", "patch_end")
        .agg(
            F.count_if("valid_date").alias("valid_dates"),
            F.count_if("target_date").alias("target_dates"),
        )
    )


def sample_patches(requests: DataFrame, config: WindowConfig) -> DataFrame:
    """One row per sample and patch with the position of the patch's last day."""
    last = config.patches - 1
    return requests.select(
        *SAMPLE,
        F.posexplode(
            F.sequence(
                F.col("sample_date_idx") - last * config.patch_len,
                F.col("sample_date_idx"),
                F.lit(config.patch_len),
            )
        ).alias("patch", "patch_end"),
    )


def _mask_columns(config: WindowConfig, assets: Column) -> list[Column]:
    fraction = F.coalesce(F.col("valid_assets"), F.lit(0)) / assets
    dates = F.coalesce(F.col("valid_dates"), F.lit(0))
    eligible = (
        (dates >= config.min_dates_in_patch)
        & (fraction >= config.min_asset_fraction)
        & (F.coalesce(F.col("target_dates"), F.lit(0)) == config.patch_len)
    )
    return [
        F.coalesce(F.col("valid_assets"), F.lit(0)).alias("valid_assets"),
        fraction.alias("valid_asset_fraction"),
        (dates > 0).alias("patch_context"),
        eligible.alias("patch_target_eligible"),
    ]


def patch_masks(
    requests: DataFrame,
    asset_facts: DataFrame,
    validity: DataFrame,
    assets: DataFrame,
    config: WindowConfig,
) -> DataFrame:
    """Context and target eligibility of every patch on the whole asset axis."""
    per_end = asset_patch_ends(asset_facts, config).groupBy("split", "patch_end").agg(
        F.count(F.lit(1)).alias("valid_assets")
    )
    total = assets.agg(F.count(F.lit(1))).scalar()
    return (
        sample_patches(requests, config)
        .join(per_end, ["split", "patch_end"], "left")
        .join(date_patch_ends(validity, config), ["split", "patch_end"], "left")
        .select(*SAMPLE, "patch", *_mask_columns(config, total))
    )


def view_patch_masks(
    requests: DataFrame,
    view: DataFrame,
    asset_facts: DataFrame,
    stream_validity: DataFrame,
    config: WindowConfig,
    k: int,
) -> DataFrame:
    """Patch masks of a k-asset view; only the view's assets count, for dates as for coverage.

    stream_validity holds the market and macro validity alone.
    """
    patches = sample_patches(requests, config)
    covered = (
        patches.join(view, SAMPLE)
        .join(asset_patch_ends(asset_facts, config), ["split", "asset_id", "patch_end"])
        .groupBy(*SAMPLE, "patch")
        .agg(F.count(F.lit(1)).alias("valid_assets"))
    )
    in_view = (
        window_days(requests, config)
        .join(view, SAMPLE)
        .join(asset_facts.filter("valid_asset").select("split", "date_idx", "asset_id"), ["split", "date_idx", "asset_id"])
        .select(*SAMPLE, "date_idx")
        .distinct()
        .withColumn("in_view", F.lit(True))
    )
    days = (
        window_days(requests, config)
        .join(stream_validity, ["split", "date_idx"], "left")
        .join(in_view, [*SAMPLE, "date_idx"], "left")
        .groupBy(*SAMPLE, "patch")
        .agg(
            F.count_if(F.coalesce("valid_date", F.lit(False)) | F.coalesce("in_view", F.lit(False))).alias("valid_dates"),
            F.count_if("target_date").alias("target_dates"),
        )
    )
    return days.join(covered, [*SAMPLE, "patch"], "left").select(*SAMPLE, "patch", *_mask_columns(config, F.lit(k)))


def mask_arrays(masks: DataFrame) -> DataFrame:
    """Per sample the context and eligibility masks as arrays in patch order."""
    ordered = F.array_sort(F.collect_list(F.struct("patch", "patch_context", "patch_target_eligible")))
    return masks.groupBy(*SAMPLE).agg(ordered.alias("_p")).select(
        *SAMPLE,
        F.transform("_p", lambda p: p["patch_context"]).alias("context"),
        F.transform("_p", lambda p: p["patch_target_eligible"]).alias("eligible"),
    )


def viable_samples(masks: DataFrame, config: WindowConfig) -> DataFrame:
    """Samples with enough eligible patches and more context than the fewest targets."""
    return (
        masks.groupBy(*SAMPLE)
        .agg(
            F.count_if("patch_target_eligible").alias("eligible_patches"),
            F.count_if("patch_context").alias("context_patches"),
        )
        .select(
            "*",
            (
                (F.col("eligible_patches") >= config.min_masked) & (F.col("context_patches") > config.min_masked)
            ).alias("viable"),
        )
    )


# --- feature dropout --------------------------------------------------------------------------


def dropped_features(manifest: DataFrame, config: WindowConfig, epoch: int) -> DataFrame:
    """Features switched off in a training epoch: a seeded order per group, rotated by epoch."""
    digest = F.sha2(F.concat_ws("|", F.lit(str(config.seed)), "input_group", "feature_name"), 256)
    group = Window.partitionBy("input_group")
    size = F.col("group_size")
    drop = F.least(F.floor(size * config.feature_dropout_rate), size - 1)
    return (
        manifest.select(
            "input_group",
            "feature_name",
            (F.row_number().over(group.orderBy(digest)) - 1).alias("slot"),
            F.count(F.lit(1)).over(group).alias("group_size"),
        )
        .select("*", drop.alias("drop_count"))
        .filter((F.col("drop_count") > 0) & (F.pmod(F.col("slot") - F.lit(epoch), size) < F.col("drop_count")))
        .select("input_group", "feature_name")
    )


def apply_dropout(facts: DataFrame, dropped: list[str], train_only: bool = True) -> DataFrame:
    """Zero the values and masks of the dropped features in train rows."""
    hit = (F.col("split") == "train") if train_only else F.lit(True)
    columns = []
    for name in facts.columns:
        if name in dropped:
            columns.append(F.when(hit, F.lit(0.0).cast("float")).otherwise(F.col(name)).alias(name))
        elif name.removesuffix("__valid") in dropped:
            columns.append((F.col(name) & ~hit).alias(name))
        else:
            columns.append(F.col(name))
    return facts.select(*columns)


# --- snapshots and value distributions ----------------------------------------------------------


def long_facts(facts: DataFrame, features: list[str], group: str, valid: str) -> DataFrame:
    """One row per fact and feature with value and mask."""
    pairs = F.array(
        *[
            F.struct(
                F.lit(i).alias("feature_index"),
                F.lit(f).alias("feature_name"),
                F.col(f).alias("value"),
                F.col(f"{f}__valid").alias("feature_valid"),
            )
            for i, f in enumerate(features)
        ]
    )
    asset = F.col("asset_id") if "asset_id" in facts.columns else F.lit(None).cast("int")
    return facts.select(
        F.lit(group).alias("input_group"),
        "split",
        "date_idx",
        asset.alias("asset_id"),
        F.col(valid).alias("row_valid"),
        F.explode(pairs).alias("_f"),
    ).select("input_group", "split", "date_idx", "asset_id", "row_valid", "_f.*")


def sample_snapshot(
    requests: DataFrame, dense: list[DataFrame], masks: DataFrame, config: WindowConfig, sample_limit: int, asset_limit: int
) -> DataFrame:
    """Every scalar of the first samples of each split with its masks and patch position.

    The limits are the snapshot's own: zero keeps everything.
    """
    chosen = requests
    if sample_limit:
        order = Window.partitionBy("split").orderBy("sample_date_idx")
        chosen = (
            requests.select("*", F.row_number().over(order).alias("_n"))
            .filter(F.col("_n") <= sample_limit)
            .drop("_n")
        )
    days = window_days(chosen, config)
    rows = None
    for part in dense:
        kept = part.filter(F.col("asset_id").isNull() | (F.col("asset_id") < asset_limit)) if asset_limit else part
        joined = days.join(kept, ["split", "date_idx"])
        rows = joined if rows is None else rows.unionByName(joined)
    return rows.join(masks, [*SAMPLE, "patch"], "left")


def histogram(masks: DataFrame, name: str, patches: int) -> DataFrame:
    """How often each patch is selected and how many patches each sample selects.

    masks: split and one boolean array per sample. Bins without a hit are listed as zero.
    """
    totals = masks.groupBy("split").agg(F.count(F.lit(1)).alias("sample_count"))
    positions = masks.select(
        "split", F.lit("patch_position").alias("histogram_type"), F.posexplode("mask").alias("bin", "hit")
    ).filter("hit").drop("hit")
    counts = masks.select(
        "split",
        F.lit("selected_patch_count").alias("histogram_type"),
        F.size(F.filter("mask", lambda m: m)).alias("bin"),
    )
    seen = positions.unionByName(counts).groupBy("split", "histogram_type", "bin").agg(F.count(F.lit(1)).alias("_n"))
    bins = totals.select(
        "split",
        "sample_count",
        F.explode(
            F.array(
                F.struct(F.lit("patch_position").alias("histogram_type"), F.sequence(F.lit(0), F.lit(patches - 1)).alias("bins")),
                F.struct(F.lit("selected_patch_count").alias("histogram_type"), F.sequence(F.lit(0), F.lit(patches)).alias("bins")),
            )
        ).alias("_h"),
    ).select("split", "sample_count", "_h.histogram_type", F.explode("_h.bins").alias("bin"))
    n = F.coalesce("_n", F.lit(0))
    return bins.join(seen, ["split", "histogram_type", "bin"], "left").select(
        "split",
        "histogram_type",
        F.lit(name).alias("mask_name"),
        "bin",
        n.alias("count"),
        (n / F.col("sample_count")).alias("fraction"),
        "sample_count",
    )


def value_sample(values: DataFrame, cap: int, seed: int) -> DataFrame:
    """At most cap valid values per split and group, chosen by a seeded hash of the cell."""
    valid = values.filter("row_valid AND feature_valid")
    cell = F.concat_ws(
        "|", F.lit(str(seed)), "input_group", "split", F.col("date_idx").cast("string"),
        F.coalesce(F.col("asset_id").cast("string"), F.lit("-")), "feature_name",
    )
    keyed = valid.withColumn("digest", F.sha2(cell, 256))
    return lowest_by_hash(keyed, ["split", "input_group"], "digest", cap)


def value_distribution(values: DataFrame, bins: int = 80, tails: tuple[float, float] = (0.005, 0.995)) -> DataFrame:
    """Density per split over equal bins between two quantiles of the group; the last bin is closed."""
    bounds = exact_percentiles(values, ["input_group"], "value", list(tails)).select(
        "input_group", F.element_at("percentiles", 1).alias("lower"), F.element_at("percentiles", 2).alias("upper")
    )
    placed = (
        values.join(F.broadcast(bounds), "input_group")  # one row per input group
        .filter(F.col("value").between(F.col("lower"), F.col("upper")))
        .select(
            "input_group",
            "split",
            "lower",
            "upper",
            F.least(F.width_bucket("value", "lower", "upper", F.lit(bins)), F.lit(bins)).alias("bin"),
        )
    )
    counted = placed.groupBy("input_group", "split", "lower", "upper", "bin").agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(Window.partitionBy("input_group", "split"))
    return counted.select(
        "*", (F.col("count") / (total * (F.col("upper") - F.col("lower")) / bins)).alias("density")
    )


# --- mask metrics and packing ------------------------------------------------------------------


def mask_metrics(samples: DataFrame) -> DataFrame:
    """Eligibility and masking rates per split, pooled over samples.

    samples: split and the context, eligible and target arrays of each sample.
    """

    def hits(name: str) -> Column:
        return F.sum(F.size(F.filter(name, lambda m: m)))

    context = F.greatest(hits("context"), F.lit(1))
    return samples.groupBy("split").agg(
        (hits("eligible") / context).alias("target_patch_eligibility_rate"),
        (hits("target") / context).alias("masked_patch_rate"),
        (hits("target") / F.count(F.lit(1))).alias("masked_patch_count_mean"),
        F.count(F.lit(1)).alias("sample_count"),
    )


def packed_patches(samples: DataFrame, mask: str = "context") -> DataFrame:
    """Visible patch numbers in time order and their count; zero marks a sample without any."""
    visible = F.filter(F.sequence(F.lit(0), F.size(mask) - 1), lambda i: F.get(F.col(mask), i))
    return samples.select(*SAMPLE, visible.alias("visible_patches")).select(
        "*", F.size("visible_patches").alias("visible_count")
    )


def padded_ids(samples: DataFrame, ids: str = "target_ids") -> DataFrame:
    """Target ids padded with -1 to the longest list."""
    longest = samples.agg(F.max(F.size(ids))).scalar()
    padded = F.concat(F.col(ids), F.array_repeat(F.lit(-1), (longest - F.size(ids)).cast("int")))
    return samples.select(*SAMPLE, padded.alias("target_patch_ids")).select(
        "*", F.transform("target_patch_ids", lambda i: i >= 0).alias("target_patch_id_mask")
    )
