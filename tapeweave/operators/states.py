"""Pooled state of each sample from its panel features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeweave.operators.samples import SAMPLE, WindowConfig, _patch_ends, one_of, sample_patches

STREAMS = ("asset", "market", "macro")
INPUT_MODES = {"all_streams": None, "without_assets": "asset", "without_market": "market", "without_macro": "macro"}


def _cell_sums(features: list[str]) -> list[Column]:
    return [
        expression
        for f in features
        for expression in (
            F.sum(F.when(F.col(f"{f}__valid"), F.col(f).cast("double"))).alias(f"{f}__sum"),
            F.count_if(f"{f}__valid").alias(f"{f}__n"),
        )
    ]


def _added(features: list[str]) -> list[Column]:
    return [F.sum(f"{f}__{part}").alias(f"{f}__{part}") for f in features for part in ("sum", "n")]


def _means(features: list[str]) -> Column:
    """Mean over valid cells per feature; 0 where there is none."""
    return F.array(*[F.coalesce(F.try_divide(f"{f}__sum", f"{f}__n"), F.lit(0.0)) for f in features])


def patch_sums(facts: DataFrame, features: list[str], valid: str, config: WindowConfig) -> DataFrame:
    """Sum and count of every feature's valid cells over the patch that ends at patch_end.

    Facts with an asset id stay apart per asset. Cells are added up per day before they
    unfold to the patches they belong to.
    """
    keys = ["split", *[c for c in ("asset_id",) if c in facts.columns]]
    daily = facts.filter(valid).groupBy(*keys, "date_idx").agg(*_cell_sums(features))
    parts = [f"{f}__{p}" for f in features for p in ("sum", "n")]
    return (
        daily.select(*keys, _patch_ends("date_idx", config.patch_len), *parts)
        .groupBy(*keys, "patch_end")
        .agg(*_added(features))
    )


def date_patch_vectors(sums: dict[str, DataFrame], features: dict[str, list[str]]) -> DataFrame:
    """Market and macro means of each patch as arrays."""
    market, macro = (
        sums[g].select("split", "patch_end", _means(features[g]).alias(f"{g}_means")) for g in ("market", "macro")
    )
    return market.join(macro, ["split", "patch_end"], "full")


def patch_vectors(
    requests: DataFrame,
    asset_sums: DataFrame,
    date_vectors: DataFrame,
    features: dict[str, list[str]],
    config: WindowConfig,
    view: DataFrame | None = None,
) -> DataFrame:
    """One vector per sample and patch: asset, market and macro means side by side.

    With views only their assets enter the asset means; further columns of view name the
    view, and every view is computed in the same pass.
    """
    patches = sample_patches(requests, config)
    means = _means(features["asset"]).alias("asset_means")
    names: list[str] = []
    if view is None:
        ends = asset_sums.groupBy("split", "patch_end").agg(*_added(features["asset"]))
        out = patches.join(ends.select("split", "patch_end", means), ["split", "patch_end"], "left")
    else:
        names = [c for c in view.columns if c not in (*SAMPLE, "asset_id")]
        patches = patches.join(view.select(*names, *SAMPLE).distinct(), SAMPLE)
        asset = (
            patches.join(view, [*names, *SAMPLE])
            .join(asset_sums, ["split", "asset_id", "patch_end"])
            .groupBy(*names, *SAMPLE, "patch")
            .agg(*_added(features["asset"]))
        )
        out = patches.join(asset.select(*names, *SAMPLE, "patch", means), [*names, *SAMPLE, "patch"], "left")
    out = out.join(date_vectors, ["split", "patch_end"], "left")
    filled = [
        F.coalesce(F.col(f"{g}_means"), F.array_repeat(F.lit(0.0), len(features[g]))) for g in STREAMS
    ]
    return out.select(*names, *SAMPLE, "patch", F.concat(*filled).alias("patch_vector"))


def pooled_states(
    vectors: DataFrame, masks: DataFrame, size: int, patches: int, invalid: str = "refuse"
) -> DataFrame:
    """Mean over context patches, the final patch, and both side by side.

    A sample whose final patch is not valid has no state: it is refused, before any vector
    is read, or dropped on request.
    """
    if one_of(invalid, "refuse", "drop") == "refuse":
        require_endpoints(masks, patches)
    names = [c for c in vectors.columns if c not in (*SAMPLE, "patch", "patch_vector")]
    joined = vectors.join(masks.select(*SAMPLE, "patch", "patch_context"), [*SAMPLE, "patch"])
    slots = [F.get("patch_vector", i) for i in range(size)]
    means = [
        F.coalesce(F.avg(F.when(F.col("patch_context"), s)), F.lit(0.0)) for s in slots
    ]
    last = F.col("patch") == patches - 1
    pooled = joined.groupBy(*names, *SAMPLE).agg(
        F.array(*means).alias("mean_state"),
        F.max(F.when(last & F.col("patch_context"), F.col("patch_vector"))).alias("endpoint_state"),
    )
    return pooled.filter("endpoint_state IS NOT NULL").select(
        "*", F.concat("mean_state", "endpoint_state").alias("pooled_state")
    )


def invalid_endpoints(masks: DataFrame, patches: int) -> DataFrame:
    """Samples whose final patch has no valid date."""
    return masks.filter((F.col("patch") == patches - 1) & ~F.col("patch_context")).select(*SAMPLE)


def require_endpoints(masks: DataFrame, patches: int) -> DataFrame:
    lacking = invalid_endpoints(masks, patches).count()
    if lacking:
        raise ValueError(f"{lacking} samples end in a patch without a valid date")
    return masks


def without_stream(vector: str, features: dict[str, list[str]], mode: str) -> Column:
    """State vector with one input stream set to zero in both of its halves."""
    dropped = INPUT_MODES[mode]
    if dropped is None:
        return F.col(vector)
    sizes = [len(features[g]) for g in STREAMS]
    start = sum(sizes[: STREAMS.index(dropped)])
    width, half = sizes[STREAMS.index(dropped)], sum(sizes)
    return F.transform(
        F.col(vector),
        lambda x, i: F.when((i % half >= start) & (i % half < start + width), F.lit(0.0)).otherwise(x),
    )
