"""Correlation of average ranks over groups of any size, exact, on packed rows.

A row holds one value and a list of others; each place of the list is ranked against the value
over the rows where both are finite. Rows go to the buckets of their value, many in one packed
block, are sorted there and go on to the buckets of their other values with the rank inside
the bucket, so the value is sorted once for all places. What two buckets share is a handful of
sums; they and the buckets' sizes alone give the correlation.

Split points between buckets decide the work of a task, never the result. A value that stands at a
split point has a bucket of its own, whose rows share one rank: they need no sorting and are dealt
over many tasks or summed where they are. The driver sees split points alone, a few hundred at most
for each million rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeweave.functions.ordered import MOST_BUCKETS, ROWS_PER_BUCKET
from tapeweave.session import written

#: Bytes of values that a task holds, before its working copies.
TASK_BYTES = 32_000_000
#: Points of the sketch for each bucket.
POINTS_PER_BUCKET = 256
#: Buckets of a group have ids below this: even ones lie between split points, odd ones at them.
CELLS = 2 * MOST_BUCKETS + 1
HASH_SEEDS = 8

POINTS = "_group long, _place int, _points binary"
BLOCKS = "_part int, _place int, _summed boolean, _cells binary, _groups binary, _values binary, _others binary"
SUMS = "_group long, _place int, _a int, _b int, _n long, _sa double, _sb double, _saa double, _sbb double, _sab double"


def _hash(keys: list[str], seed: int) -> Column:
    """Known NULLs count, or ('a', NULL) and (NULL, 'a') would be one group."""
    return F.xxhash64(F.lit(seed), *[c for k in keys for c in (F.col(k), F.col(k).isNull())])


def named_groups(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, Column]:
    """One row per group with its keys, number of rows and _group, a hash that no other group has; and that hash."""
    for seed in range(HASH_SEEDS):
        code = _hash(keys, seed)
        groups = written(
            rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).withColumn("_group", code), "rank-groups"
        )
        if groups.groupBy("_group").count().filter("count > 1").isEmpty():
            return groups, code
    raise ValueError(f"groups of {', '.join(keys)} share hashes under {HASH_SEEDS} seeds")


class Layout(NamedTuple):
    """Where rows go: split points of the groups with more than one bucket, by group and place (-1: the value)."""

    parts: int
    bases: dict[tuple[int, int], int]
    splits: dict[tuple[int, int], np.ndarray]

    def cells(self, group: int, place: int, values: np.ndarray) -> np.ndarray:
        splits = self.splits.get((group, place))
        if splits is None:
            return np.zeros(len(values), np.int32)
        at = np.searchsorted(splits, values, side="right").astype(np.int32)
        return 2 * at - (splits[np.maximum(at, 1) - 1] == values)

    def parts_of(self, group: int, place: int, cells: np.ndarray) -> np.ndarray:
        base = self.bases.get((group, place), hash((group, place)))
        return ((base % self.parts + (cells + 1) // 2) % self.parts).astype(np.int32)


def _drawn() -> np.random.Generator:
    """A task's own draws, the same whenever it is repeated."""
    return np.random.default_rng((1729, TaskContext.get().partitionId()))


def _segments(*columns: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal rows, with the end of the last."""
    n = len(columns[0])
    if n == 0:
        return np.zeros(1, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), n)


def _order(groups: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Order by group and value."""
    order = np.argsort(values)
    names = np.unique(groups)
    if len(names) == 1:
        return order
    codes = np.searchsorted(names, groups).astype(np.uint16 if len(names) < 65_536 else np.int64)
    return order[np.argsort(codes[order], kind="stable")]


def _spans(groups: np.ndarray) -> list[tuple[int, int, int]]:
    """Group, start and end of each run of rows of one group."""
    edges = _segments(groups)
    return [(int(groups[s]), int(s), int(e)) for s, e in zip(edges[:-1], edges[1:], strict=True)]


def _placed(layout: Layout, groups: np.ndarray, place: int, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and part of values whose groups lie together."""
    cells, parts = np.zeros(len(values), np.int32), np.empty(len(values), np.int32)
    for group, start, end in _spans(groups):
        cells[start:end] = layout.cells(group, place, values[start:end])
        parts[start:end] = layout.parts_of(group, place, cells[start:end])
    return cells, parts


def _centred(edges: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Average rank inside the bucket less the bucket's mean rank: 0 where all values are one.

    edges: where the buckets of the sorted values begin, with the end of the last.
    """
    new = np.append(True, values[1:] != values[:-1])
    new[edges[:-1]] = True
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(values)))
    bucket_sizes = np.diff(edges)
    return np.repeat(starts + (sizes - 1) / 2, sizes) - np.repeat(edges[:-1] + (bucket_sizes - 1) / 2, bucket_sizes)


def _pack(values: np.ndarray) -> bytes:
    """The bytes of the values, or of the first if all are equal."""
    return (values[:1] if (values[1:] == values[0]).all() else values).tobytes()


def _unpack(data: bytes, kind: type, size: int) -> np.ndarray:
    found = np.frombuffer(data, kind)
    return found if len(found) == size else np.repeat(found, size)


def _chunks(batches: Iterator[pa.RecordBatch], places: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Groups, values and lists of other values of many batches together, rows of a group beside each other.

    Rows without a pair of finite values are left out; of the others, what is not finite is NaN.
    """
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def together() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        groups, values, others = (np.concatenate(c) for c in zip(*held, strict=True))
        names, codes = np.unique(groups, return_inverse=True)
        order = np.argsort(codes.astype(np.uint16) if len(names) < 65_536 else codes, kind="stable")
        return groups[order], values[order], others[order]

    for batch in batches:
        values = batch.column(1).to_numpy(zero_copy_only=False)
        others = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(values), places)
        known = np.isfinite(others)
        if not known.all():
            others = np.where(known, others, np.nan)
        kept = np.isfinite(values) & known.any(axis=1)
        if not kept.any():
            continue
        held.append((batch.column(0).to_numpy()[kept], values[kept], others[kept]))
        size += kept.sum() * 8 * (2 + places)
        if size >= TASK_BYTES:
            yield together()
            held, size = [], 0
    if held:
        yield together()


def _split_points(packed: DataFrame, places: int, rows_per_bucket: int) -> dict[tuple[int, int], np.ndarray]:
    """Split points of each group and place (-1: the value) with more than one bucket.

    Each task hands on the values at every step-th place of its sorted rows, over all its groups
    in a row and from a drawn first place, so a point stands for step rows.
    """
    step = max(1, rows_per_bucket // POINTS_PER_BUCKET)

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn = _drawn()
        for groups, values, others in _chunks(batches, places):
            for place in range(-1, places):
                column = values if place < 0 else others[:, place]
                known = groups
                if place >= 0 and np.isnan(column).any():
                    known, column = groups[~np.isnan(column)], column[~np.isnan(column)]
                taken = drawn.integers(step)
                for group, start, end in _spans(known):
                    wanted = np.arange(taken, end - start, step)
                    taken = (taken - (end - start)) % step
                    if len(wanted):
                        found = np.sort(column[start:end])[wanted]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([group], pa.int64()), pa.array([place], pa.int32()), pa.array([found.tobytes()])],
                            names=["_group", "_place", "_points"],
                        )

    def chosen(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        found = np.sort(np.concatenate([np.frombuffer(p, float) for p in frame["_points"]]))
        buckets = min(MOST_BUCKETS, len(found) * step // rows_per_bucket + 1)
        at = np.arange(1, buckets) * len(found) // buckets
        return pd.DataFrame({"_group": [key[0]], "_place": [key[1]], "_points": [np.unique(found[at]).tobytes()]})

    merged = packed.mapInArrow(points, POINTS).groupBy("_group", "_place").applyInPandas(chosen, POINTS)
    large = merged.filter(F.length("_points") > 0).collect()
    return {(r["_group"], r["_place"]): np.frombuffer(r["_points"], float) for r in large}


def _dealt(blocks: DataFrame, parts: int) -> DataFrame:
    return blocks.repartitionById(parts, F.col("_part"))


def _layout(splits: dict[tuple[int, int], np.ndarray], parts: int, of_value: bool) -> Layout:
    """Buckets of the value or of the other values, numbered one after the other over the parts."""
    own = {key: s for key, s in splits.items() if (key[1] < 0) == of_value}
    bases, base = {}, 0
    for key, found in sorted(own.items()):
        bases[key] = base
        base += len(found) + 1
    return Layout(parts, bases, own)


def _emitted(rows: list[tuple]) -> pa.RecordBatch:
    part, place, summed, *data = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(part, pa.int32()), pa.array(place, pa.int32()), pa.array(summed), *[pa.array(d, pa.binary()) for d in data]],
        names=["_part", "_place", "_summed", "_cells", "_groups", "_values", "_others"],
    )


def rank_sums(
    rows: DataFrame, keys: list[str], value: str, others: str, places: int, rows_per_bucket: int = ROWS_PER_BUCKET
) -> tuple[DataFrame, DataFrame]:
    """Groups, and per group, place and pair of buckets: rows, and sums, squares and product of the centred ranks.

    others: an array column of as many doubles as places.
    """
    groups, code = named_groups(rows, keys)
    packed = rows.select(code.alias("_group"), F.col(value).cast("double").alias("_value"), F.col(others).alias("_others"))
    splits = _split_points(packed, places, rows_per_bucket)
    total = groups.agg(F.sum("_rows")).first()[0] or 0
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A row weighs its group, value and others, and on the second way group, bucket, value and rank for each place.
    first = _layout(splits, max(least, total * 8 * (2 + places) // TASK_BYTES + 1), True)
    second = _layout(splits, max(least, total * 24 * places // TASK_BYTES + 1), False)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn = _drawn()
        for groups, values, others in _chunks(batches, places):
            cells, parts = _placed(first, groups, -1, values)
            # Rows of one shared rank need not meet.
            alone = cells % 2 == 1
            parts[alone] = (parts[alone] + drawn.integers(first.parts)) % first.parts
            order = np.argsort(parts.astype(np.uint16) if first.parts < 65_536 else parts, kind="stable")
            groups, values, others, parts = groups[order], values[order], others[order], parts[order]
            edges = _segments(parts)
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                yield _emitted([(parts[s], -1, False, b"", _pack(groups[s:e]), values[s:e].tobytes(), others[s:e].tobytes())])

    def rank_value(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            for _, _, _, _, group, value, other in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = len(value) // 8
                held.append((_unpack(group, np.int64, n), np.frombuffer(value, float), np.frombuffer(other, float).reshape(n, places)))
        if not held:
            return
        groups, values, others = (np.concatenate(c) for c in zip(*held, strict=True))
        held.clear()
        order = _order(groups, values)
        groups, values, others = groups[order], values[order], others[order]
        cells, _ = _placed(first, groups, -1, values)
        whole = None
        for place in range(places):
            column = others[:, place]
            known = ~np.isnan(column)
            if known.all():
                if whole is None:
                    whole = np.where(cells % 2 == 1, 0.0, _centred(_segments(groups, cells), values))
                g, c, b, rank = groups, cells, np.ascontiguousarray(column), whole
            else:
                g, c, b = groups[known], cells[known], column[known]
                if not len(b):
                    continue
                rank = np.where(c % 2 == 1, 0.0, _centred(_segments(g, c), values[known]))
            yield from pass_on(place, g, c, b, rank)

    def pass_on(place: int, groups, cells, values, rank) -> Iterator[pa.RecordBatch]:
        """Rows to the buckets of their other value; those of a value of one shared rank as sums."""
        to, parts = _placed(second, groups, place, values)
        alone = to % 2 == 1
        if alone.any():
            pairs = _segments(groups[alone], cells[alone])
            run = np.repeat(np.arange(len(pairs) - 1), np.diff(pairs))
            found, at = np.unique(run * CELLS + to[alone], return_inverse=True)
            firsts = np.flatnonzero(alone)[pairs[found // CELLS]]
            n = np.bincount(at)
            s, ss = np.bincount(at, rank[alone]), np.bincount(at, rank[alone] ** 2)
            both = np.stack([cells[firsts], (found % CELLS).astype(np.int32)]).tobytes()
            sums = np.stack([n.astype(float), s, ss]).tobytes()
            # They are added up wherever they arrive.
            part = (int(parts[alone][0]) + int(cells[0])) % second.parts
            yield _emitted([(part, place, True, both, groups[firsts].tobytes(), sums, b"")])
            if alone.all():
                return
            groups, cells, values, rank, parts = (c[~alone] for c in (groups, cells, values, rank, parts))
        order = np.argsort(parts.astype(np.uint16) if second.parts < 65_536 else parts, kind="stable")
        groups, cells, values, rank, parts = (c[order] for c in (groups, cells, values, rank, parts))
        edges = _segments(parts)
        out, size = [], 0
        for s, e in zip(edges[:-1], edges[1:], strict=True):
            out.append((parts[s], place, False, _pack(cells[s:e]), _pack(groups[s:e]), values[s:e].tobytes(), rank[s:e].tobytes()))
            size += 28 * (e - s)
            if size >= 4_000_000:
                yield _emitted(out)
                out, size = [], 0
        if out:
            yield _emitted(out)

    def rank_others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for _, place, summed, cell, group, value, rank in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if summed:
                    n, s, ss = np.frombuffer(value, float).reshape(3, -1)
                    a, b = np.frombuffer(cell, np.int32).reshape(2, -1)
                    zero = np.zeros(len(n))
                    yield sums(np.frombuffer(group, np.int64), place, a, b, n, s, zero, ss, zero, zero)
                else:
                    n = len(value) // 8
                    held.setdefault(place, []).append(
                        (_unpack(group, np.int64, n), _unpack(cell, np.int32, n), np.frombuffer(value, float), np.frombuffer(rank, float))
                    )
        for place in sorted(held):
            groups, cells, values, rank = (np.concatenate(c) for c in zip(*held.pop(place), strict=True))
            order = _order(groups, values)
            groups, cells, values, rank = groups[order], cells[order], values[order], rank[order]
            to, _ = _placed(second, groups, place, values)
            edges = _segments(groups, to)
            own = _centred(edges, values)
            run = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
            found, at = np.unique(run * CELLS + cells, return_inverse=True)
            firsts = edges[found // CELLS]
            measured = [np.bincount(at, w) for w in (rank, own, rank * rank, own * own, rank * own)]
            yield sums(groups[firsts], place, (found % CELLS).astype(np.int32), to[firsts], np.bincount(at), *measured)

    def sums(groups, place, a, b, n, *measured) -> pa.RecordBatch:
        arrays = [groups, np.full(len(groups), place, np.int32), a, b, n.astype(np.int64), *measured]
        names = ["_group", "_place", "_a", "_b", "_n", "_sa", "_sb", "_saa", "_sbb", "_sab"]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=names)

    by_value = _dealt(packed.mapInArrow(deal, BLOCKS), first.parts).mapInArrow(rank_value, BLOCKS)
    return groups, _dealt(by_value, second.parts).mapInArrow(rank_others, SUMS)


def rank_correlations(
    rows: DataFrame, keys: list[str], value: str, others: str, places: int, rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Per group and place (of the array column others) the correlation of average ranks; 0 where a side is constant.

    Groups and places without a finite pair have no row. The work up to the buckets' sums is done when
    this is called.
    """
    groups, found = rank_sums(rows, keys, value, others, places, rows_per_bucket)
    of = ["_group", "_place"]
    sums = [F.sum(c).alias(c) for c in ("_n", "_sa", "_sb", "_saa", "_sbb", "_sab")]
    sized = written(found.groupBy(*of, "_a", "_b").agg(*sums), "rank-sums")

    def means(cell: str, name: str) -> DataFrame:
        """Each bucket's mean rank less the group's."""
        before = Window.partitionBy(*of).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
        mean = F.coalesce(F.sum("_n").over(before), F.lit(0)) + (F.col("_n") + 1) / 2
        centre = (F.sum("_n").over(Window.partitionBy(*of)) + 1) / 2
        return sized.groupBy(*of, cell).agg(F.sum("_n").alias("_n")).select(*of, cell, (mean - centre).alias(name))

    n, a, b = F.col("_n"), F.col("_ma"), F.col("_mb")
    moments = (
        sized.join(means("_a", "_ma"), [*of, "_a"])
        .join(means("_b", "_mb"), [*of, "_b"])
        .groupBy(*of)
        .agg(
            F.sum(n * a * b + a * F.col("_sb") + b * F.col("_sa") + F.col("_sab")).alias("_cov"),
            F.sum(n * a * a + F.col("_saa")).alias("_va"),
            F.sum(n * b * b + F.col("_sbb")).alias("_vb"),
        )
    )
    level = F.when((F.col("_va") > 0) & (F.col("_vb") > 0), F.col("_cov") / (F.sqrt("_va") * F.sqrt("_vb"))).otherwise(0.0)
    return moments.select("_group", F.col("_place").alias("place"), level.alias("rank_correlation")).join(
        groups, "_group"
    ).select(*keys, "place", "rank_correlation")
