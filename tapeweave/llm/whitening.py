"""Whitening of embeddings along the leading eigenvectors of their covariance.

Three passes over the vectors: count and sums of the fixed-point entries (exact), covariance
centred before it is multiplied, covariance of the whitened values as the check. Every task
adds up its rows; what moves are matrices of the vectors' dimension. The driver divides the
covariance by spectral projectors (spectral.py) and the mean and the few components kept,
whose size is bound by the dimension alone, go to the tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeweave.llm.common import table
from tapeweave.llm.spectral import eigen

COMPONENTS = 8
# An entry c becomes floor(SCALE * c) + OFFSET.
SCALE = 1024
OFFSET = 100_000
#: Entries beyond this are no vectors' entries: sums of their fixed-point forms would not be exact.
LARGEST = float(1 << 40)


def usable(vector: str) -> Column:
    """Whether a vector column holds a vector whose entries are all there and finite."""
    within = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= LARGEST))
    return F.coalesce(F.col(vector).isNotNull() & (F.size(vector) > 0) & within, F.lit(False))


def fixed_point(column: pa.Array) -> np.ndarray:
    """Rows of vectors as a matrix of x = floor(1024 c) + 100000."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return (np.floor(SCALE * flat) + OFFSET).astype(np.int64).reshape(len(column), -1)


def _total(vectors: DataFrame, size: int, summed: Callable[[np.ndarray], np.ndarray], kind: str) -> np.ndarray:
    """Sum over all rows of summed(x), an array of size entries. One array a task, added entry by entry.

    kind: long or double. Sums of longs are exact.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            if batch.num_rows:
                part = summed(fixed_point(batch.column(0)))
                out = part if out is None else out + part
        if out is not None:
            slot = pa.array(np.arange(len(out), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([slot, pa.array(out)], names=["slot", "value"])

    rows = vectors.select("v").mapInArrow(partial, f"slot int, value {kind}")
    total = np.zeros(size, dtype=np.int64 if kind == "long" else np.float64)
    for row in rows.groupBy("slot").agg(F.sum("value").alias("value")).collect():
        total[row["slot"]] = row["value"]
    return total


@dataclass
class Whitening:
    """A fitted whitening: n vectors with sums S of x, the components kept, and how well they whiten."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def explained(self) -> np.ndarray:
        return self.values / self.trace if self.trace > 0 else np.zeros_like(self.values)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n: the whole part of the mean goes before any rounding."""
        whole = self.sums // self.n
        return (x - whole).astype(np.float64) - (self.sums - whole * self.n) / self.n

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows; 0 along components without variance."""
        scale = np.divide(1.0, np.sqrt(self.values), out=np.zeros_like(self.values), where=self.values > 0)
        return np.einsum("ij,jk->ik", self.centred(x), self.vectors) * scale

    def deviation(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n x - S)^2, exact at any size."""
        reach = int(np.abs(x).max(initial=0)) * self.n + int(np.abs(self.sums).max(initial=0))
        if reach < 1 << 62:
            moved = self.n * x - self.sums
            top = int(np.abs(moved).max(initial=0))
            if top * top * max(1, x.shape[1]) < 1 << 63:
                return (moved * moved).sum(axis=1).tolist()
        exact = self.n * x.astype(object) - self.sums.astype(object)
        return [int(d) for d in (exact * exact).sum(axis=1)]


def fit(vectors: DataFrame, components: int) -> Whitening | None:
    """The whitening of vectors(v), all of one length; None for an empty table."""
    head = vectors.select(F.size("v").alias("d")).first()
    if head is None:
        return None
    d = head["d"]
    totals = _total(vectors, d + 1, lambda x: np.append(x.sum(axis=0), len(x)), "long")
    n, sums = int(totals[d]), totals[:d]
    model = Whitening(n, sums, np.zeros((d, 0)), np.zeros(0), 0.0)

    def outer(x: np.ndarray) -> np.ndarray:
        centred = model.centred(x)
        return (centred.T @ centred).ravel()

    covariance = _total(vectors, d * d, outer, "double").reshape(d, d) / n
    values, directions = eigen(covariance)
    # An eigenvalue that rounding alone explains is none.
    least = 64 * d * np.finfo(np.float64).eps * max(0.0, float(values[0]))
    kept = min(components, d)
    model.values = np.where(values[:kept] > least, values[:kept], 0.0)
    model.vectors, model.trace = directions[:, :kept], float(np.trace(covariance))

    def whitened_outer(x: np.ndarray) -> np.ndarray:
        w = model.project(x)
        return (w.T @ w).ravel()

    real = np.flatnonzero(model.values)
    found = (_total(vectors, kept * kept, whitened_outer, "double").reshape(kept, kept) / n)[np.ix_(real, real)]
    model.identity_error = float(np.abs(found - np.eye(len(real))).max(initial=0.0))
    return model


def whiten(rows: DataFrame, id_column: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable row: its id, n, deviation decimal(38,0), whitened, explained array<double>, identity_error.

    Rows whose vector is null, empty or holds entries that are null, not finite or beyond
    LARGEST are left out, and so are vectors that are shorter than the longest: covariance
    needs one length. Entry k of whitened and explained belongs to component k + 1, by
    falling eigenvalue; there are `components` or as many as dimensions. Components without
    variance (one vector, equal vectors, lower rank) whiten to 0 and don't count for
    identity_error, the largest absolute entry of the whitened values' covariance minus the
    identity. Repeated rows count each; null ids stay. An empty table gives an empty result.
    Other columns are left out.
    """
    schema = f"id {rows.schema[id_column].dataType.simpleString()}, n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double"
    named = rows.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    good = named.filter(usable("v"))
    longest = good.agg(F.max(F.size("v")).alias("d")).first()["d"]
    if longest is None:
        return rows.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_column)
    good = good.filter(F.size("v") == longest)
    model = fit(good, components)

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        explained = model.explained
        for batch in batches:
            m = batch.num_rows
            x = fixed_point(batch.column(1)).reshape(m, -1)
            flat = model.project(x) if m else np.zeros((0, len(explained)))
            offsets = pa.array(np.arange(m + 1, dtype=np.int32) * len(explained))
            columns = [
                batch.column(0),
                pa.array(np.full(m, model.n, dtype=np.int64)),
                pa.array([str(v) for v in model.deviation(x)] if m else [], type=pa.string()),
                pa.ListArray.from_arrays(offsets, pa.array(flat.ravel())),
                pa.ListArray.from_arrays(offsets, pa.array(np.tile(explained, m))),
                pa.array(np.full(m, model.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "deviation", "whitened", "explained", "identity_error"])

    out = good.mapInArrow(transform, schema.replace("deviation decimal(38,0)", "deviation string"))
    return out.withColumn("deviation", F.col("deviation").cast("decimal(38,0)")).withColumnRenamed("id", id_column)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whiten(table(spark, sf_dir, "embeddings"))
    each = F.posexplode(F.arrays_zip("whitened", "explained"))
    return found.select("vec_id", "n", "deviation", "identity_error", each.alias("k", "part")).select(
        "vec_id",
        (F.col("k") + 1).alias("component"),
        "n",
        F.expr("try_cast(deviation AS bigint)").alias("deviation"),
        F.col("part.whitened").alias("whitened"),
        F.col("part.explained").alias("explained"),
        "identity_error",
    )
