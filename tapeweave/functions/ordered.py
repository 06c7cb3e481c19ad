"""Exact order statistics that never put one large group on one task.

One path for every size: ties are aggregated first (average_ranks gives them a bucket of their
own instead), then each group's distinct values fall into buckets between split points, rows
are ordered inside buckets only, and bucket totals (groups times buckets) are combined across
them. A group gets one bucket for every ROWS_PER_BUCKET of its distinct values, MOST_BUCKETS at
most. Split points come from one bounded sketch per group; they stay a distributed table, and
but for average_ranks nothing runs before the result is asked for.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeweave.session import written

ROWS_PER_BUCKET = 500_000
MOST_BUCKETS = 1024
BUCKET = "_bucket"


def ordinal(df: DataFrame, value: str) -> Column:
    """The ordering value as a double, for placing split points."""
    kind = df.schema[value].dataType.typeName()
    if kind == "date":
        return F.unix_date(value).cast("double")
    if kind in ("timestamp", "timestamp_ntz"):
        return F.unix_micros(F.col(value).cast("timestamp")).cast("double")
    if not isinstance(df.schema[value].dataType, T.NumericType):
        raise ValueError(f"cannot place split points on a {kind} column")
    return F.col(value).cast("double")


def _points(df: DataFrame, value: str) -> Column:
    """The sketched values at MOST_BUCKETS even shares of a group."""
    shares = [i / MOST_BUCKETS for i in range(1, MOST_BUCKETS)]
    return F.percentile_approx(ordinal(df, value), shares, 10 * MOST_BUCKETS)


def _chosen(points: str, rows: str, rows_per_bucket: int) -> Column:
    """As many of the points, ascending, as rows need buckets."""
    buckets = F.least(F.lit(MOST_BUCKETS), F.floor(F.col(rows) / rows_per_bucket) + 1)
    step = F.ceil(F.lit(MOST_BUCKETS) / buckets)
    return F.array_sort(F.array_distinct(F.filter(points, lambda p, i: (i + 1) % step == 0)))


def split_points(levels: DataFrame, keys: list[str], value: str, rows_per_bucket: int) -> DataFrame:
    """One row per group with its ascending split points: none for groups of one bucket."""
    sketched = levels.groupBy(*keys).agg(F.count(value).alias("_levels"), _points(levels, value).alias("_points"))
    return sketched.select(
        *[F.col(k).alias(f"_of_{k}") for k in keys], _chosen("_points", "_levels", rows_per_bucket).alias("_splits")
    )


def _place(splits: Column, value: Column) -> Column:
    """How many of the ascending split points are at or below value, by bisection; 0 for NULL."""
    halves = F.array(*[F.lit(1 << i) for i in reversed(range(MOST_BUCKETS.bit_length()))])
    steps = F.slice(halves, F.lit(-1) * F.greatest(F.length(F.bin(F.size(splits))), F.lit(1)), MOST_BUCKETS)

    def further(place: Column, half: Column) -> Column:
        return place + F.when(F.get(splits, place + half - 1) <= value, half).otherwise(0)

    return F.when(F.size(splits) > 0, F.aggregate(steps, F.lit(0), further)).otherwise(0)


def with_bucket(levels: DataFrame, keys: list[str], value: str, rows_per_bucket: int) -> DataFrame:
    """levels, one row per group and value, with the bucket of its value."""
    splits = split_points(levels.filter(F.col(value).isNotNull()), keys, value, rows_per_bucket)
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys] or [F.lit(True)]
    joined = levels.join(splits, same, "left")
    return joined.withColumn(BUCKET, _place(F.col("_splits"), ordinal(levels, value))).select(*levels.columns, BUCKET)


def running_before(
    levels: DataFrame, keys: list[str], value: str, sums: list[str], rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Adds <name>_before: the sum of each column over smaller values of the same group.

    Rows must be unique per group and value (aggregate ties first).
    """
    bucketed = with_bucket(levels, keys, value, rows_per_bucket)
    inside = Window.partitionBy(*keys, BUCKET).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = bucketed.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_in_{c}") for c in sums])
    earlier = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        bucketed.groupBy(*keys, BUCKET)
        .agg(*[F.sum(c).alias(f"_sum_{c}") for c in sums])
        .select(
            *[F.col(k).alias(f"_of_{k}") for k in keys],
            F.col(BUCKET).alias("_of_bucket"),
            *[F.coalesce(F.sum(f"_sum_{c}").over(earlier), F.lit(0)).alias(f"_off_{c}") for c in sums],
        )
    )
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys] + [F.col(BUCKET) == F.col("_of_bucket")]
    return local.join(offsets, same).select(
        *levels.columns, *[(F.col(f"_in_{c}") + F.col(f"_off_{c}")).alias(f"{c}_before") for c in sums]
    )


def tie_counts(df: DataFrame, keys: list[str], value: str, **sums: Column) -> DataFrame:
    """One row per group and value with its number of rows and extra sums."""
    return df.groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("ties"), *[F.sum(c).alias(name) for name, c in sums.items()]
    )


EXACT_ORDINALS = ("double", "float", "integer", "short", "byte", "date")


def average_ranks(
    df: DataFrame, keys: list[str], ranks: dict[str, str], rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Adds the rank of each value column inside its group, ties sharing their mean rank.

    ranks maps value columns to rank columns. Rows are counted by the buckets of all their
    values first; then a row goes once to the bucket of each value, is sorted there and
    numbered from the rows of earlier buckets. A value that stands at a split point has a bucket of its
    own, where all rows share one rank that the counts alone give: such rows are dealt by the
    buckets of their other values, and rows with only such values need no sorting at all. The
    small tables (groups, bucket counts) are written when this is called.
    """
    values = list(ranks)
    bucket = {v: f"_bucket_{i}" for i, v in enumerate(values)}
    group = ["_group", "_twin"]
    sketched = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_rows"), *[_points(df, v).alias(f"_points_{i}") for i, v in enumerate(values)]
    )
    # Groups are known by a hash from here on; groups of one hash are told apart by their order.
    hashed = F.xxhash64(*keys) if keys else F.lit(0).cast("bigint")
    twins = Window.partitionBy("_group").orderBy(*(keys or ["_group"]))
    groups = written(
        sketched.select(
            *[F.col(k).alias(f"_of_{k}") for k in keys],
            hashed.alias("_group"),
            *[_chosen(f"_points_{i}", "_rows", rows_per_bucket).alias(f"_splits_{i}") for i in range(len(values))],
            *keys,
        ).select("*", F.row_number().over(twins).alias("_twin")).drop(*keys),
        "rank-groups",
    )
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys] or [F.lit(True)]
    placed = df.join(groups, same)
    for i, v in enumerate(values):
        place, at = f"_place_{i}", ordinal(df, v)
        placed = placed.withColumn(place, _place(F.col(f"_splits_{i}"), at))
        alone = F.lit(False)
        if df.schema[v].dataType.typeName() in EXACT_ORDINALS:
            alone = F.coalesce(F.get(f"_splits_{i}", F.col(place) - 1) == at, F.lit(False))
        placed = placed.withColumn(bucket[v], F.col(place) * 2 - alone.cast("int"))
    others = [c for c in df.columns if c not in keys]
    placed = placed.select(*group, *others, *bucket.values())
    cells = written(placed.groupBy(*group, *bucket.values()).agg(F.count(F.lit(1)).alias("_n")), "rank-cells")
    earlier = Window.partitionBy(*group).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    counts = {
        v: written(
            cells.groupBy(*group, F.col(bucket[v]).alias("_at"))
            .agg(F.sum("_n").alias("_total"))
            .select(
                F.col("_group").alias("_of_group"),
                F.col("_twin").alias("_of_twin"),
                "_at",
                "_total",
                F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before"),
            ),
            "rank-counts",
        )
        for v in values
    }

    def counted(rows: DataFrame, v: str) -> DataFrame:
        mine = [F.col(g) == F.col(f"_of{g}") for g in group] + [F.col(bucket[v]) == F.col("_at")]
        return rows.join(counts[v], mine).drop("_of_group", "_of_twin", "_at")

    def alone_in(v: str) -> Column:
        return F.col(bucket[v]) % 2 == 1

    shared = F.col("_before") + (F.col("_total") + 1) / 2
    all_alone = reduce(lambda a, b: a & b, [alone_in(v) for v in values])
    tied, sorted_ = placed.filter(all_alone), placed.filter(~all_alone)
    for v, rank in ranks.items():
        tied = counted(tied, v).withColumn(rank, shared).drop("_total", "_before")
        rest = [bucket[o] for o in values if o != v]
        dealt = F.when(alone_in(v), F.xxhash64(*rest) if rest else F.lit(0).cast("bigint")).otherwise(0)
        inside = Window.partitionBy(*group, bucket[v], "_dealt").orderBy(v)
        # Of a run of ties, rank() is the first place and the rows up to its end are the last.
        last = F.count(F.lit(1)).over(inside.rangeBetween(Window.unboundedPreceding, Window.currentRow))
        numbered = sorted_.withColumn("_dealt", dealt).withColumn("_inside", (F.rank().over(inside) + last) / 2)
        own = F.when(alone_in(v), shared).otherwise(F.col("_before") + F.col("_inside"))
        sorted_ = counted(numbered, v).withColumn(rank, own).drop("_total", "_before", "_dealt", "_inside")
    ranked = tied.unionByName(sorted_)
    names = groups.select(
        F.col("_group").alias("_of_group"), F.col("_twin").alias("_of_twin"), *[F.col(f"_of_{k}").alias(k) for k in keys]
    )
    return ranked.join(names, [F.col(g) == F.col(f"_of{g}") for g in group]).select(*df.columns, *ranks.values())


def exact_percentiles(
    df: DataFrame, keys: list[str], value: str, shares: list[float], rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Count and exact percentiles with linear interpolation per group, as an array column."""
    if not keys:
        raise ValueError("exact_percentiles needs at least one key column")
    levels = tie_counts(df.filter(F.col(value).isNotNull()), keys, value)
    placed = running_before(levels, keys, value, ["ties"], rows_per_bucket)
    totals = levels.groupBy(*keys).agg(F.sum("ties").alias("value_count"))
    wanted = F.array(*[F.lit(float(s)) for s in shares])
    positions = totals.select(
        *[F.col(k).alias(f"_of_{k}") for k in keys],
        "value_count",
        F.transform(wanted, lambda s: s * (F.col("value_count") - 1)).alias("_positions"),
    )
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    # A value stands at the ranks ties_before to ties_before + ties - 1; it weighs in a
    # percentile by how much of [position, position + 1) around its ranks is asked for.
    first, last = F.col("ties_before"), F.col("ties_before") + F.col("ties") - 1

    def weight(position: Column) -> Column:
        low = F.floor(position)
        upper = position - low
        at_low = F.when((low >= first) & (low <= last), 1 - upper).otherwise(F.lit(0.0))
        at_high = F.when((low + 1 >= first) & (low + 1 <= last), upper).otherwise(F.lit(0.0))
        return at_low + at_high

    weighed = placed.join(positions, same).withColumn("_weights", F.transform("_positions", weight))
    near = weighed.filter(F.exists("_weights", lambda w: w > 0))
    parts = [F.sum(F.col("_weights")[i] * F.col(value)).alias(f"_p{i}") for i in range(len(shares))]
    return (
        near.groupBy(*keys, "value_count")
        .agg(*parts)
        .select(*keys, "value_count", F.array(*[F.col(f"_p{i}") for i in range(len(shares))]).alias("percentiles"))
    )


def lowest_by_hash(df: DataFrame, keys: list[str], digest: str, cap: int) -> DataFrame:
    """The cap rows of each group with the smallest hex digests.

    A histogram of the first four digits finds the boundary; rows below it are kept where
    they lie and only the boundary slice, a 65,536th of a group, is ranked.
    """
    prefixed = df.withColumn("_prefix", F.substring(digest, 1, 4))
    order = Window.partitionBy(*keys).orderBy("_prefix")
    slices = (
        prefixed.groupBy(*keys, "_prefix")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("*", (F.sum("_n").over(order) - F.col("_n")).alias("_earlier"))
        .filter(F.col("_earlier") < cap)
    )
    near = prefixed.join(slices, [*keys, "_prefix"])
    whole = F.col("_earlier") + F.col("_n") <= cap
    ranked = near.filter(~whole).select(
        "*", F.row_number().over(Window.partitionBy(*keys, "_prefix").orderBy(digest)).alias("_rank")
    )
    return (
        near.filter(whole).select(*df.columns)
        .unionByName(ranked.filter(F.col("_rank") <= cap - F.col("_earlier")).select(*df.columns))
    )


def with_positions(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with each row's place, from 0 and gapless, in the order of columns of any sortable type.

    Rows are dealt by ranges and numbered inside theirs. The ranges are written once, so that
    a repeated task cannot deal them anew; of each only its size is combined across them and
    broadcast.
    """
    part, at = "_part", "_at"
    ranged = df.repartitionByRange(*order).withColumn(part, F.spark_partition_id())
    dealt = written(ranged, "positions")
    sizes = dealt.groupBy(part).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(part, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(part).orderBy(*order)) - 1
    placed = dealt.withColumn(at, inside).join(F.broadcast(starts), part)
    return placed.withColumn(name, F.col("_start") + F.col(at)).drop(part, at, "_start")
