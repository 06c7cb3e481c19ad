"""Expressions over vector columns and mergeable vector moments."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeweave.functions.expr import EPSILON, col

SMALL_NORM = 1e-12


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(col(a), F.lit(0.0), lambda s, x: s + x * x))


def minus(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(col(a), col(b), lambda x, y: x - y)


def cosine(a: Column | str, b: Column | str, least: float = 0.0) -> Column:
    """Cosine similarity, 0 where the product of the norms does not exceed least."""
    scale = norm(a) * norm(b)
    return F.when(scale > least, dot(a, b) / scale).otherwise(F.lit(0.0))


def unit(a: Column | str) -> Column:
    """Vector over its norm as a neural normalizer does it: tiny norms count as 1e-12."""
    size = F.greatest(norm(a), F.lit(EPSILON))
    return F.transform(col(a), lambda x: x / size)


def field(structs: Column | str, name: str) -> Column:
    """One field of every struct of an array."""
    return F.transform(col(structs), lambda s: s[name])


def slots(vector: Column | str, size: int, prefix: str) -> list[Column]:
    """One column per element."""
    return [F.get(col(vector), i).alias(f"{prefix}{i + 1}") for i in range(size)]


def stacked(column: pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64, copy=False)


# --- moments ---------------------------------------------------------------------------

FLUSH_VALUES = 4_000_000


def _scaled_rows(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.linalg.norm(x, axis=1)
    return sizes, np.divide(x, sizes[:, None], out=np.zeros_like(x), where=sizes[:, None] > 0)


def _summary(x: np.ndarray, geometry: bool) -> np.ndarray:
    upper = np.triu_indices(x.shape[1])
    parts = [np.array([float(len(x))]), x.sum(axis=0), (x.T @ x)[upper]]
    if geometry:
        sizes, u = _scaled_rows(x)
        heads = [sizes.sum(), (sizes > 0).sum(), (sizes <= SMALL_NORM).sum()]
        parts += [np.array(heads, dtype=np.float64), u.sum(axis=0), (u.T @ u)[upper]]
    return np.concatenate(parts)


def moments(df: DataFrame, keys: list[str], vector: str, geometry: bool = False) -> DataFrame:
    """Count, sum and Gram matrix of a vector column per key as one packed array.

    Every partition adds its rows up first, so a hot key costs each task one matrix and
    the shuffle moves matrices, not rows. Vectors of one key have one length.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for key, packed in sums.items():
                frame = pd.DataFrame({"slot": np.arange(packed.size, dtype=np.int32), "value": packed})
                for name, part in zip(keys, key):
                    frame[name] = part
                yield pa.RecordBatch.from_pandas(frame[[*keys, "slot", "value"]], schema=arrow, preserve_index=False)
            sums.clear()

        held = 0
        for batch in batches:
            table = pa.table(batch.columns, names=batch.schema.names)
            column = table.column(vector).combine_chunks()
            groups = table.select(keys).to_pandas().groupby(keys, dropna=False).indices if keys else {(): None}
            for key, rows in groups.items():
                part = column if rows is None else column.take(pa.array(rows))
                key = key if isinstance(key, tuple) else (key,)
                packed = _summary(stacked(part), geometry)
                if key in sums:
                    sums[key] += packed
                else:
                    sums[key] = packed
                    held += packed.size
            if held > FLUSH_VALUES:
                yield from flush()
                held = 0
        yield from flush()

    schema = T.StructType(
        [*[df.schema[k] for k in keys], T.StructField("slot", T.IntegerType()), T.StructField("value", T.DoubleType())]
    )
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    rows = df.select(*keys, vector).mapInArrow(partial, schema)
    summed = rows.groupBy(*keys, "slot").agg(F.sum("value").alias("value"))
    ordered = F.array_sort(F.collect_list(F.struct("slot", "value")))
    return summed.groupBy(*keys).agg(F.transform(ordered, lambda s: s["value"]).alias("moments"))


@dataclass
class Moments:
    """Unpacked moments of one key."""

    n: float
    total: np.ndarray
    gram: np.ndarray
    norm_sum: float = 0.0
    nonzero: float = 0.0
    near_zero: float = 0.0
    unit_total: np.ndarray | None = None
    unit_gram: np.ndarray | None = None

    @property
    def mean(self) -> np.ndarray:
        return self.total / self.n

    @property
    def covariance(self) -> np.ndarray:
        if self.n < 2:
            return np.zeros_like(self.gram)
        return (self.gram - self.n * np.outer(self.mean, self.mean)) / (self.n - 1)


def unpack(packed, size: int, geometry: bool = False) -> Moments:
    values = np.asarray(packed, dtype=np.float64)
    triangle = size * (size + 1) // 2

    def square(part: np.ndarray) -> np.ndarray:
        full = np.zeros((size, size))
        full[np.triu_indices(size)] = part
        return full + np.triu(full, 1).T

    out = Moments(values[0], values[1 : size + 1], square(values[size + 1 : size + 1 + triangle]))
    if geometry:
        rest = values[size + 1 + triangle :]
        out.norm_sum, out.nonzero, out.near_zero = rest[:3]
        out.unit_total = rest[3 : 3 + size]
        out.unit_gram = square(rest[3 + size :])
    return out


def vector_size(packed_length: int, geometry: bool = False) -> int:
    """Vector length behind a packed array."""
    size = 1
    while True:
        plain = 1 + size + size * (size + 1) // 2
        if (2 * plain + 2 if geometry else plain) >= packed_length:
            return size
        size += 1
