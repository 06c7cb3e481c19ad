"""Geometry of vector tables: PCA, spectra, pairwise cosines, paired distances."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeweave.functions.ordered import running_before
from tapeweave.functions.vectors import (
    SMALL_NORM,
    Moments,
    cosine,
    dot,
    minus,
    moments,
    norm,
    unit,
    unpack,
    vector_size,
)
from tapeweave.operators.splits import outer_train, outer_windows
from tapeweave.session import spread, written

# --- PCA --------------------------------------------------------------------------------


@dataclass
class Pca:
    """Centered, unwhitened projection; each axis points to its largest loading."""

    mean: np.ndarray
    components: np.ndarray
    variance: np.ndarray
    ratio: np.ndarray


def fit_pca(train: DataFrame, vector: str, size: int) -> Pca:
    """PCA of the train rows from one pass of moments; only a size-by-size matrix reaches the driver."""
    packed = moments(train, [], vector).first()
    if packed is None:
        raise ValueError("no train rows to fit")
    m = unpack(packed["moments"], vector_size(len(packed["moments"])))
    if not 1 <= size <= min(int(m.n), m.total.size):
        raise ValueError(f"{size} components from {int(m.n)} rows of {m.total.size} dimensions")
    values, axes = np.linalg.eigh(m.covariance)
    order = np.argsort(values)[::-1]
    values = np.clip(values[order], 0.0, None)
    components = axes[:, order[:size]].T.copy()
    for axis in components:
        if axis[np.argmax(np.abs(axis))] < 0:
            axis *= -1
    whole = values.sum()
    ratio = values[:size] / whole if whole > 0 else np.zeros(size)
    return Pca(m.mean, components, values[:size], ratio)


def apply_pca(rows: DataFrame, vector: str, pca: Pca, out: str = "z") -> DataFrame:
    mean, axes = pca.mean, pca.components.T

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def project(vectors: pd.Series) -> pd.Series:
        if vectors.empty:
            return vectors
        return pd.Series(list((np.stack(vectors.to_numpy()) - mean) @ axes))

    return rows.withColumn(out, project(F.col(vector)))


VARIANT_SOURCES = ("mean", "endpoint", "pooled")


def representation_variants(
    states: DataFrame, sizes: tuple[int, ...], train: str = "split = 'train'"
) -> tuple[DataFrame, dict[str, Pca]]:
    """Adds <source>_pca_<k> columns for each state vector; every PCA is fit on train rows only.

    A size beyond a vector's entries is the raw vector itself and has no fit.
    """
    fitted: dict[str, Pca] = {}
    out = states
    entries = states.select(*[F.size(f"{source}_state").alias(source) for source in VARIANT_SOURCES]).first()
    for source in VARIANT_SOURCES:
        for k in sizes:
            if entries is None or k > entries[source]:
                continue
            name = f"{source}_pca_{k}"
            fitted[name] = fit_pca(states.filter(train), f"{source}_state", k)
            out = apply_pca(out, f"{source}_state", fitted[name], name)
    return out, fitted


def coordinates(rows: DataFrame, vector: str, size: int, versions: dict[str, str]) -> DataFrame:
    """z_1..z_k columns and the version columns next to the rows' own columns."""
    return rows.select(
        *[c for c in rows.columns if c != vector],
        *[F.get(F.col(vector), i).alias(f"z_{i + 1}") for i in range(size)],
        *[F.lit(value).alias(name) for name, value in versions.items()],
    )


# --- paired rows ---------------------------------------------------------------------------


def paired_distances(pairs: DataFrame, reference: str, candidate: str) -> DataFrame:
    """Cosine (0 for a vanishing norm) and relative distance of each aligned pair."""
    return pairs.select(
        *[c for c in pairs.columns if c not in (reference, candidate)],
        cosine(reference, candidate, SMALL_NORM).alias("cosine"),
        (norm(minus(candidate, reference)) / F.greatest(norm(reference), F.lit(SMALL_NORM))).alias("relative_l2"),
    )


def distance_summary(distances: DataFrame, keys: list[str], median) -> DataFrame:
    """Mean and median per key; median(df, keys, column) supplies the exact medians."""
    means = distances.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("pair_count"),
        F.avg("cosine").alias("mean_cosine_similarity"),
        F.avg("relative_l2").alias("mean_relative_l2_distance"),
    )
    middles = median(distances, keys, "cosine", "median_cosine_similarity").join(
        median(distances, keys, "relative_l2", "median_relative_l2_distance"), keys
    )
    return means.join(middles, keys)


def normalized_error(pairs: DataFrame, predicted: str, target: str) -> DataFrame:
    """Squared distance of the two normalized vectors of each pair."""
    difference = minus(unit(predicted), unit(target))
    return pairs.select(
        *[c for c in pairs.columns if c not in (predicted, target)],
        F.aggregate(difference, F.lit(0.0), lambda s, x: s + x * x).alias("error"),
    )


def similarity_stats(values: DataFrame, keys: list[str], median) -> DataFrame:
    """Mean, median, spread and range of a similarity column and of one minus it."""
    s = F.col("similarity")
    plain = values.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.avg(s).alias("similarity_mean"),
        F.stddev_pop(s).alias("similarity_std"),
        F.min(s).alias("similarity_min"),
        F.max(s).alias("similarity_max"),
    )
    middle = median(values, keys, "similarity", "similarity_median")
    return with_distances(plain.join(middle, keys))


def with_distances(stats: DataFrame) -> DataFrame:
    """Distance figures of one minus the similarity."""
    return stats.select(
        "*",
        (1 - F.col("similarity_mean")).alias("distance_mean"),
        (1 - F.col("similarity_median")).alias("distance_median"),
        F.col("similarity_std").alias("distance_std"),
        (1 - F.col("similarity_max")).alias("distance_min"),
        (1 - F.col("similarity_min")).alias("distance_max"),
    )


# --- pairwise cosines ---------------------------------------------------------------------

#: Rows of a block; a group of so many blocks is cut along so many fixed directions at most.
BLOCK_ROWS = 256
MOST_CUTS = 16
BINS = 4096
#: What rounding may add to a cosine: bounds are widened by it.
SLACK = 1e-9


def _unit_rows(vectors) -> np.ndarray:
    x = np.array([np.asarray(v, dtype=np.float64) for v in vectors])
    sizes = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, sizes, out=np.zeros_like(x), where=sizes > 0)


def _pair_values(row) -> np.ndarray:
    left, right = _unit_rows(row.left), _unit_rows(row.right)
    products = left @ right.T
    if row.row_block == row.other_block:
        return products[np.triu_indices(len(left), 1)]
    return products.ravel()


def _bin_of(values: np.ndarray) -> np.ndarray:
    return np.clip(((values + 1.0) * (BINS / 2)).astype(np.int64), 0, BINS - 1)


def _sides(x: np.ndarray, cuts: int) -> np.ndarray:
    """On which side of `cuts` fixed random planes each row lies, as a number."""
    planes = np.random.default_rng(x.shape[1]).standard_normal((x.shape[1], MOST_CUTS))[:, :cuts]
    return ((x @ planes) > 0) @ (1 << np.arange(cuts))


def row_blocks(rows: DataFrame, keys: list[str], row_id: str, vector: str) -> DataFrame:
    """Blocks of neighbouring rows of each key: keys, row_block, n, centre, radius, vectors.

    Rows on the same sides of fixed planes are neighbours; more than BLOCK_ROWS of them are
    dealt by hash, so no block holds a whole group whatever its size. centre is a unit
    vector, radius the largest angle from it. Rows without length are blocks of their own,
    without a centre.
    """
    size = rows.groupBy(*keys).agg(
        F.least(F.greatest(F.ceil(F.log2(F.count(F.lit(1)) / F.lit(BLOCK_ROWS))), F.lit(0)), F.lit(MOST_CUTS)).cast("int").alias("cuts")
    )

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            side = np.zeros(len(batch), dtype=np.int64)
            for (_, cuts), at in batch.groupby([batch["v"].map(len), "cuts"]).indices.items():
                x = _unit_rows(batch["v"].iloc[at])
                side[at] = np.where(x.any(axis=1), _sides(x, int(cuts)), -1)
            yield batch.assign(side=side).drop(columns="cuts")

    source = rows.select(*keys, F.xxhash64(row_id).alias("spot"), F.col(vector).cast("array<double>").alias("v")).join(size, keys)
    longs, vectors = T.LongType(), T.ArrayType(T.DoubleType())
    schema = T.StructType([*_key_fields(rows, keys), T.StructField("spot", longs), T.StructField("v", vectors), T.StructField("side", longs)])
    sided = source.mapInPandas(placed, schema)
    shares = sided.groupBy(*keys, "side").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("shares"))
    name = F.struct("side", F.pmod("spot", F.col("shares")).alias("share"))
    blocks = sided.join(shares, [*keys, "side"]).groupBy(*keys, name.alias("name")).agg(F.collect_list("v").alias("vectors"))

    def described(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            centres, radii = [], []
            for block in batch["vectors"]:
                x = _unit_rows(block)
                middle = x.sum(axis=0)
                length = np.linalg.norm(middle)
                # Without a direction of its own a block takes its first row's.
                centre = middle / length if length > 1e-6 else x[0]
                centres.append(centre if x.any() else None)
                radii.append(float(np.arccos(np.clip((x @ centre).min(), -1.0, 1.0))))
            yield batch.assign(n=batch["vectors"].map(len), centre=centres, radius=radii)

    described_schema = T.StructType(
        [
            *_key_fields(rows, keys),
            T.StructField("row_block", longs),
            T.StructField("vectors", T.ArrayType(vectors)),
            T.StructField("n", longs),
            T.StructField("centre", vectors),
            T.StructField("radius", T.DoubleType()),
        ]
    )
    numbered = blocks.select(*keys, (F.col("name.side") * (1 << 32) + F.col("name.share")).alias("row_block"), "vectors")
    return spread(numbered).mapInPandas(described, described_schema)


def block_bounds(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of blocks of each key: how many pairs of rows they make, and least and greatest cosine that those can have.

    Of blocks whose centres are t apart, with radii r and s, rows are t - r - s to t + r + s apart.
    """
    a = blocks.select(*keys, "row_block", F.col("n").alias("n_a"), F.col("centre").alias("c_a"), F.col("radius").alias("r_a"))
    b = blocks.select(
        *keys, F.col("row_block").alias("other_block"), F.col("n").alias("n_b"), F.col("centre").alias("c_b"), F.col("radius").alias("r_b")
    )
    same = F.col("row_block") == F.col("other_block")
    apart = F.when(same, F.lit(0.0)).otherwise(F.acos(F.least(F.greatest(dot("c_a", "c_b"), F.lit(-1.0)), F.lit(1.0))))
    wide = F.col("r_a") + F.col("r_b")
    flat = F.col("c_a").isNull() | F.col("c_b").isNull()
    least = F.when(flat, F.lit(0.0)).otherwise(F.cos(F.least(apart + wide, F.lit(float(np.pi))))) - SLACK
    greatest = F.when(flat, F.lit(0.0)).otherwise(F.cos(F.greatest(apart - wide, F.lit(0.0)))) + SLACK
    count = F.when(same, F.col("n_a") * (F.col("n_a") - 1) / 2).otherwise(F.col("n_a") * F.col("n_b")).cast("long")
    pairs = spread(a.join(b, keys).filter("row_block <= other_block"))
    return pairs.select(*keys, "row_block", "other_block", count.alias("count"), least.alias("least"), greatest.alias("greatest")).filter("count > 0")


def bin_column(value: Column) -> Column:
    return F.least(F.greatest(F.floor((value + 1.0) * (BINS / 2)), F.lit(0)), F.lit(BINS - 1)).cast("int")


def straddling(bounds: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(block pairs to multiply, counts of the rest) for median, minimum and maximum of each key's cosines.

    The middle values lie between the first bin that the least cosines can reach the rank in
    and the first in which the greatest must have. Block pairs outside that range, which hold
    neither the smallest nor the largest value, are only counted: below says how many of their
    pairs lie under the range.
    """
    binned = bounds.withColumn("low_bin", bin_column(F.col("least"))).withColumn("high_bin", bin_column(F.col("greatest")))
    whole = binned.groupBy(*keys).agg(
        F.sum("count").alias("pair_count"), F.max("least").alias("max_is_over"), F.min("greatest").alias("min_is_under")
    )
    lower, upper = F.floor((F.col("pair_count") - 1) / 2), F.floor(F.col("pair_count") / 2)

    def first_over(bin_name: str, rank: Column, name: str) -> DataFrame:
        upto = F.sum("count").over(Window.partitionBy(*keys).orderBy("bin"))
        sums = binned.groupBy(*keys, F.col(bin_name).alias("bin")).agg(F.sum("count").alias("count"))
        reached = sums.withColumn("upto", upto).join(whole, keys).filter(F.col("upto") > rank)
        return reached.groupBy(*keys).agg(F.min("bin").alias(name))

    limits = whole.join(first_over("low_bin", lower, "from_bin"), keys).join(first_over("high_bin", upper, "to_bin"), keys)
    placed = binned.join(limits, keys)
    wanted = (
        ((F.col("high_bin") >= F.col("from_bin")) & (F.col("low_bin") <= F.col("to_bin")))
        | (F.col("greatest") >= F.col("max_is_over"))
        | (F.col("least") <= F.col("min_is_under"))
    )
    below = F.sum(F.when(~wanted & (F.col("high_bin") < F.col("from_bin")), F.col("count")).otherwise(F.lit(0)))
    counted = placed.groupBy(*keys, "pair_count").agg(below.alias("below"), F.count_if(wanted).alias("multiplied"), F.count(F.lit(1)).alias("block_pairs"))
    return placed.filter(wanted).select(*keys, "row_block", "other_block"), counted


def block_pairs(blocks: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The vectors of wanted pairs of blocks: the unit of work that is multiplied."""
    left = blocks.select(*keys, "row_block", F.col("vectors").alias("left"))
    right = blocks.select(*keys, F.col("row_block").alias("other_block"), F.col("vectors").alias("right"))
    return spread(wanted.join(left, [*keys, "row_block"]).join(right, [*keys, "other_block"]))


def _key_fields(df: DataFrame, keys: list[str]) -> list[T.StructField]:
    return [df.schema[k] for k in keys]


def cosine_histogram(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, least and greatest cosine per key and bin, added up inside each task."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple, list[np.ndarray]] = {}
        for batch in batches:
            for row in batch.itertuples(index=False):
                values = _pair_values(row)
                if not values.size:
                    continue
                key = tuple(getattr(row, k) for k in keys)
                if key not in seen:
                    seen[key] = [np.zeros(BINS, dtype=np.int64), np.full(BINS, np.inf), np.full(BINS, -np.inf)]
                counts, low, high = seen[key]
                at = _bin_of(values)
                counts += np.bincount(at, minlength=BINS)
                np.minimum.at(low, at, values)
                np.maximum.at(high, at, values)
        for key, (counts, low, high) in seen.items():
            hit = np.flatnonzero(counts)
            frame = pd.DataFrame({"bin": hit.astype(np.int32), "pairs": counts[hit], "low": low[hit], "high": high[hit]})
            for name, part in zip(keys, key):
                frame[name] = part
            yield frame[[*keys, "bin", "pairs", "low", "high"]]

    schema = T.StructType(
        [
            *_key_fields(pairs, keys),
            T.StructField("bin", T.IntegerType()),
            T.StructField("pairs", T.LongType()),
            T.StructField("low", T.DoubleType()),
            T.StructField("high", T.DoubleType()),
        ]
    )
    return (
        pairs.mapInPandas(count, schema)
        .groupBy(*keys, "bin")
        .agg(F.sum("pairs").alias("pairs"), F.min("low").alias("low"), F.max("high").alias("high"))
    )


def pairwise_order_stats(rows: DataFrame, keys: list[str], row_id: str, vector: str) -> DataFrame:
    """Exact median, minimum and maximum of all pairwise cosines of each key, whatever its size.

    Bounds on the cosines between blocks leave the block pairs that can hold one of these
    values (see straddling); only those are multiplied, in a histogram that finds the bins of
    the middle values. A second pass returns only the values of those bins, tied values
    counted.
    """
    blocks = written(row_blocks(rows, keys, row_id, vector), "row-blocks")
    wanted, counted = straddling(written(block_bounds(blocks, keys), "block-bounds"), keys)
    counted = written(counted, "counted-blocks")
    pairs = block_pairs(blocks, wanted, keys)
    bins = written(cosine_histogram(pairs, keys), "cosine-bins")
    upto = F.sum("pairs").over(Window.partitionBy(*keys).orderBy("bin"))
    # What was only counted below comes before every bin of the range; the middle values are in it.
    ranked = bins.join(counted, keys).select(*bins.columns, "pair_count", (F.col("below") + upto - F.col("pairs")).alias("before"))
    lower, upper = F.floor((F.col("pair_count") - 1) / 2), F.floor(F.col("pair_count") / 2)

    def inside(rank):
        return (rank >= F.col("before")) & (rank < F.col("before") + F.col("pairs"))

    middle = (
        ranked.filter(inside(lower) | inside(upper))
        .groupBy(*keys, "pair_count")
        .agg(F.min("bin").alias("first_bin"), F.max("bin").alias("last_bin"), F.min("before").alias("before"))
    )

    def select(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                values = _pair_values(row)
                at = _bin_of(values)
                kept = values[(at == row.first_bin) | (at == row.last_bin)]
                distinct, ties = np.unique(kept, return_counts=True)
                frame = pd.DataFrame({"value": distinct, "ties": ties.astype(np.int64)})
                for name in keys:
                    frame[name] = getattr(row, name)
                yield frame[[*keys, "value", "ties"]]

    schema = T.StructType(
        [*_key_fields(rows, keys), T.StructField("value", T.DoubleType()), T.StructField("ties", T.LongType())]
    )
    values = (
        pairs.join(middle.select(*keys, "first_bin", "last_bin"), keys)
        .mapInPandas(select, schema)
        .groupBy(*keys, "value")
        .agg(F.sum("ties").alias("ties"))
    )
    values = written(values, "middle-cosines")
    located = running_before(values, keys, "value", ["ties"]).join(middle, keys)
    start = F.col("before") + F.col("ties_before")

    def covers(rank):
        return (rank >= start) & (rank < start + F.col("ties"))

    medians = located.groupBy(*keys, "pair_count").agg(
        (
            (F.max(F.when(covers(lower), F.col("value"))) + F.max(F.when(covers(upper), F.col("value")))) / 2
        ).alias("similarity_median")
    )
    ranges = bins.groupBy(*keys).agg(F.min("low").alias("similarity_min"), F.max("high").alias("similarity_max"))
    return medians.join(ranges, keys)


def _metrics_schema(df: DataFrame, keys: list[str], names: list[str]) -> T.StructType:
    return T.StructType([*_key_fields(df, keys), *[T.StructField(n, T.DoubleType()) for n in names]])


def per_key_metrics(df: DataFrame, keys: list[str], names: list[str], measure, geometry: bool = True) -> DataFrame:
    """Metrics of each key's moments: one bounded matrix row in, one row of numbers out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                measure(unpack(packed, vector_size(len(packed), geometry), geometry)) for packed in batch["moments"]
            ]
            yield batch[keys].assign(**{n: [float(r[n]) for r in rows] for n in names})

    return df.mapInPandas(run, _metrics_schema(df, keys, names))


def spectrum(m: Moments) -> np.ndarray:
    return np.clip(np.linalg.eigvalsh(m.covariance)[::-1], 0.0, None)


def effective_rank(values: np.ndarray) -> float:
    """Exponential of the entropy of the eigenvalue shares."""
    whole = values.sum()
    if whole <= 0:
        return 0.0
    shares = values[values > 0] / whole
    return float(np.exp(-(shares * np.log(shares)).sum()))


def cosine_moments(m: Moments) -> tuple[float, float]:
    """Mean and spread of all pairwise cosines, in closed form from the unit-vector sums."""
    pairs = m.n * (m.n - 1)
    if pairs <= 0:
        return 0.0, 0.0
    mean = (m.unit_total @ m.unit_total - m.nonzero) / pairs
    square = ((m.unit_gram**2).sum() - m.nonzero) / pairs
    return float(mean), float(np.sqrt(max(square - mean * mean, 0.0)))


RANK_METRICS = [
    "sample_count",
    "effective_rank",
    "top_eigenvalue_share",
    "top_5_eigenvalue_share",
    "mean_pairwise_cosine",
    "mean_vector_norm",
]


def rank_measures(m: Moments) -> dict[str, float]:
    values = spectrum(m)
    whole = values.sum()
    return {
        "sample_count": m.n,
        "effective_rank": effective_rank(values),
        "top_eigenvalue_share": values[0] / whole if whole > 0 else 0.0,
        "top_5_eigenvalue_share": values[:5].sum() / whole if whole > 0 else 0.0,
        "mean_pairwise_cosine": cosine_moments(m)[0],
        "mean_vector_norm": m.norm_sum / m.n,
    }


def rank_metrics(rows: DataFrame, keys: list[str], row_id: str, vector: str) -> DataFrame:
    """The seven rank metrics per key; the median cosine comes from the blocked pair pass."""
    base = per_key_metrics(moments(rows, keys, vector, geometry=True), keys, RANK_METRICS, rank_measures)
    middle = pairwise_order_stats(rows, keys, row_id, vector).select(
        *keys, F.col("similarity_median").alias("median_pairwise_cosine")
    )
    return base.join(middle, keys, "left").select(
        *keys, *RANK_METRICS, F.coalesce("median_pairwise_cosine", F.lit(0.0)).alias("median_pairwise_cosine")
    )


def pairwise_cosine_summary(rows: DataFrame, keys: list[str], row_id: str, vector: str) -> DataFrame:
    """Count, mean, median, spread and range of the off-diagonal cosines of each key."""

    def measure(m: Moments) -> dict[str, float]:
        mean, spread = cosine_moments(m)
        return {"similarity_mean": mean, "similarity_std": spread}

    closed = per_key_metrics(
        moments(rows, keys, vector, geometry=True), keys, ["similarity_mean", "similarity_std"], measure
    )
    ordered = pairwise_order_stats(rows, keys, row_id, vector)
    zero = F.lit(0.0)
    joined = closed.join(ordered, keys, "left").select(
        *keys,
        F.coalesce("pair_count", F.lit(0)).alias("pair_count"),
        "similarity_mean",
        "similarity_std",
        *[F.coalesce(c, zero).alias(c) for c in ("similarity_median", "similarity_min", "similarity_max")],
    )
    return with_distances(joined)


def collapse_diagnostics(rows: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Per key and dimension: mean, variance, eigenvalue and strongest correlation partner.

    Key-level figures (counts of zero norms, effective rank) repeat on each dimension row.
    """
    packed = moments(rows, keys, vector, geometry=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i, values in enumerate(batch["moments"]):
                m = unpack(values, vector_size(len(values), True), True)
                covariance = m.covariance
                deviation = np.sqrt(np.clip(np.diag(covariance), 0.0, None))
                scale = np.outer(deviation, deviation)
                correlation = np.divide(covariance, scale, out=np.zeros_like(covariance), where=scale > 0)
                others = np.abs(correlation - np.diag(np.diag(correlation)))
                eigenvalues = spectrum(m)
                frame = pd.DataFrame(
                    {
                        "dimension": np.arange(1, m.total.size + 1, dtype=np.int32),
                        "sample_count": int(m.n),
                        "mean": m.mean,
                        "sample_variance": np.diag(covariance),
                        "eigenvalue": eigenvalues,
                        "strongest_correlation": others.max(axis=1),
                        "covariance_row": list(covariance),
                        "correlation_row": list(correlation),
                        "effective_rank": effective_rank(eigenvalues),
                        "zero_norm_count": int(m.n - m.nonzero),
                        "near_zero_norm_count": int(m.near_zero),
                    }
                )
                for name in keys:
                    frame[name] = batch[name].iloc[i]
                yield frame[[*keys, *[c for c in frame.columns if c not in keys]]]

    schema = T.StructType(
        [
            *_key_fields(rows, keys),
            T.StructField("dimension", T.IntegerType()),
            T.StructField("sample_count", T.LongType()),
            T.StructField("mean", T.DoubleType()),
            T.StructField("sample_variance", T.DoubleType()),
            T.StructField("eigenvalue", T.DoubleType()),
            T.StructField("strongest_correlation", T.DoubleType()),
            T.StructField("covariance_row", T.ArrayType(T.DoubleType())),
            T.StructField("correlation_row", T.ArrayType(T.DoubleType())),
            T.StructField("effective_rank", T.DoubleType()),
            T.StructField("zero_norm_count", T.LongType()),
            T.StructField("near_zero_norm_count", T.LongType()),
        ]
    )
    return packed.mapInPandas(run, schema)


def spread_statistics(rows: DataFrame, keys: list[str], vector: str, floor: float = 0.1, epsilon: float = 1e-4) -> DataFrame:
    """Mean deviation per dimension, its shortfall below a floor and off-diagonal covariance energy."""

    def measure(m: Moments) -> dict[str, float]:
        if m.n < 2:
            return {"mean_feature_std": 0.0, "variance_hinge": 0.0, "covariance_energy": 0.0}
        c = m.covariance
        mean_std = float(np.sqrt(np.clip(np.diag(c), 0.0, None) + epsilon).mean())
        energy = ((c**2).sum() - (np.diag(c) ** 2).sum()) / m.total.size
        return {"mean_feature_std": mean_std, "variance_hinge": max(floor - mean_std, 0.0), "covariance_energy": energy}

    names = ["mean_feature_std", "variance_hinge", "covariance_energy"]
    return per_key_metrics(moments(rows, keys, vector), keys, names, measure, geometry=False)


# --- matched-length history ---------------------------------------------------------------


def matched_blocks(rows: DataFrame) -> DataFrame:
    """Rows of each validation window and of the history blocks of the same length before it.

    rows: one per date with pos, split and validation_window_name. History is cut into
    whole non-overlapping blocks plus one trailing block; block -1 is the window itself.
    """
    windows = outer_windows(rows)
    own = F.col("split") == "validation"
    lengths = rows.filter(own).groupBy("validation_window_name").agg(F.count(F.lit(1)).alias("length"))
    train = outer_train(rows, windows).join(lengths, "validation_window_name")
    window = Window.partitionBy("validation_window_name")
    numbered = train.select(
        "*",
        (F.row_number().over(window.orderBy("pos")) - 1).alias("_i"),
        F.count(F.lit(1)).over(window).alias("_m"),
    )
    short = numbered.filter("_m < length").limit(1).collect()
    if short or lengths.join(train, "validation_window_name", "left_anti").limit(1).collect():
        raise ValueError("a validation window is longer than the history before it")
    whole = F.floor(F.col("_m") / F.col("length"))
    block = F.floor(F.col("_i") / F.col("length")).cast("int")
    trailing = (F.col("_m") % F.col("length") != 0) & (F.col("_i") >= F.col("_m") - F.col("length"))
    blocks = F.array_compact(F.array(F.when(block < whole, block), F.when(trailing, whole.cast("int"))))
    names = [c for c in rows.columns]
    history = numbered.select(*names, F.explode(blocks).alias("block"))
    return history.unionByName(
        rows.filter(own & (F.coalesce("validation_window_name", F.lit("")) != "")).select(*names, F.lit(-1).alias("block"))
    )


def compare_with_history(metrics: DataFrame, names: list[str]) -> DataFrame:
    """Each window's metric beside median, 5th, 95th percentile and rank among its history blocks."""
    long = metrics.unpivot(["validation_window_name", "block"], names, "metric", "value")
    here = long.filter("block = -1").select("validation_window_name", "metric", F.col("value").alias("validation_value"))
    past = long.filter("block >= 0").join(here, ["validation_window_name", "metric"])
    quantiles = F.percentile("value", F.array(F.lit(0.5), F.lit(0.05), F.lit(0.95)))
    return past.groupBy("validation_window_name", "metric", "validation_value").agg(
        F.count(F.lit(1)).alias("matched_train_window_count"),
        quantiles[0].alias("matched_train_median"),
        quantiles[1].alias("matched_train_5th_percentile"),
        quantiles[2].alias("matched_train_95th_percentile"),
        (100 * F.avg((F.col("value") <= F.col("validation_value")).cast("double"))).alias("validation_percentile"),
    )
