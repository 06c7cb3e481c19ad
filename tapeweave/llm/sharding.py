"""Sharding by a Feistel permutation over global row numbers.

Rows get global numbers from hash buckets (a fixed number of buckets, so the numbers do not
depend on the cluster). A keyed permutation of 0..N-1 shuffles the numbers: a Feistel network
over two digits i = left * b + right, where a * b is the least such product that covers N,
with cycle walking past N. Shard and slot follow from the permuted number by division, and
the inverse permutation tells which row number sits in a given shard and slot.

Everything is column arithmetic; only narrow columns are shuffled, never texts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeweave.llm.common import table
from tapeweave.session import written

BUCKETS = 4096
ROUNDS = 6
SEED = 20_260_101
SHARDS = 16
#: Beyond it a walk is an error: for N over 256 its probability is below 16 ** -16 a row.
MOST_WALKS = 16


@dataclass(frozen=True)
class Permutation:
    """A keyed permutation of 0..size-1 and its inverse, as column expressions."""

    size: int
    seed: int = SEED
    rounds: int = ROUNDS

    @property
    def digits(self) -> tuple[int, int]:
        left = max(1, math.isqrt(max(0, self.size - 1)) + 1)
        return left, max(1, -(-self.size // left))

    @property
    def walks(self) -> int:
        """A run of numbers past size has at most as many members as there are such numbers."""
        left, right = self.digits
        return min(left * right - self.size, MOST_WALKS)

    def _noise(self, turn: Column, half: Column) -> Column:
        return F.xxhash64(F.lit(self.seed).cast("long"), turn.cast("long"), half.cast("long"))

    def _step(self, number: Column, back: bool) -> Column:
        """One pass through the network. Even turns change the left digit, odd ones the right."""
        left, right = self.digits
        sign = -1 if back else 1

        def turn(state: Column, i: Column) -> Column:
            old_left, old_right = state["left"], state["right"]
            new_left = F.pmod(old_left + sign * F.pmod(self._noise(i, old_right), F.lit(left)), F.lit(left))
            new_right = F.pmod(old_right + sign * F.pmod(self._noise(i, old_left), F.lit(right)), F.lit(right))
            even = i % 2 == 0
            return F.struct(
                F.when(even, new_left).otherwise(old_left).cast("long").alias("left"),
                F.when(even, old_right).otherwise(new_right).cast("long").alias("right"),
            )

        start = F.struct(
            F.floor(number / F.lit(right)).cast("long").alias("left"),
            F.pmod(number, F.lit(right)).cast("long").alias("right"),
        )
        turns = [F.lit(i).cast("long") for i in range(self.rounds)]
        order = F.array(*(reversed(turns) if back else turns))
        return F.aggregate(order, start, turn, lambda s: s["left"] * F.lit(right).cast("long") + s["right"])

    def _walked(self, number: Column, back: bool) -> Column:
        first = self._step(number, back)
        if not self.walks:
            return first
        inside = F.lit(self.size).cast("long")
        walk = F.aggregate(
            F.sequence(F.lit(1), F.lit(self.walks)),
            first,
            lambda x, _: F.when(x < inside, x).otherwise(self._step(x, back)),
        )
        return F.when(walk < inside, walk).otherwise(
            F.raise_error(F.lit("a walk did not end; choose another seed")).cast("long")
        )

    def forward(self, number: Column) -> Column:
        return self._walked(number, back=False)

    def backward(self, number: Column) -> Column:
        return self._walked(number, back=True)


def numbered(rows: DataFrame, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """rows with row_number from 0, gapless, the same for the same rows in any partitioning.

    rows should be a written table, as it is read twice. Equal rows get neighbouring numbers
    in any order. A bucket holds 1/buckets of the rows unless many rows are equal in all keys;
    its sort can spill. The offsets are one row per bucket and so may be broadcast.
    """
    placed = rows.withColumn("__bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    counts = placed.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy("__bucket").orderBy(*keys)
    return (
        placed.withColumn("__rank", F.row_number().over(within) - 1)
        .join(F.broadcast(offsets), "__bucket")
        .withColumn("row_number", (F.col("__before") + F.col("__rank")).cast("long"))
        .drop("__bucket", "__rank", "__before")
    )


def shard_rows(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Law `rows`: shard counts differ by one at most, slots are gapless from 0. size is the
    UTF-8 bytes of the text (null: none) plus 1. Null and repeated doc_ids, empty and null
    texts are rows like any other; equal rows differ in shard or slot only. An empty table
    gives an empty result. Other columns are left out.
    """
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64("text").alias("text_hash"),
    )
    rows = written(narrow, "shard-rows")
    total = rows.count()
    number = Permutation(max(1, total), seed).forward(F.col("row_number"))
    return numbered(rows, ["doc_id", "text_hash", "size", "text_crc32"]).withColumn("__at", number).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.pmod("__at", F.lit(shards)).cast("int").alias("shard"),
        F.floor(F.col("__at") / F.lit(shards)).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED) -> None:
    """docs as Parquet folders shard=0.. in slot order, for rows that doc_id and text tell apart."""
    places = shard_rows(docs, shards, seed).select("doc_id", "text_crc32", "shard", "slot")
    keyed = docs.withColumn("text_crc32", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    placed = keyed.join(places, ["doc_id", "text_crc32"]).drop("text_crc32")
    (
        placed.repartitionByRange("shard", "slot")
        .sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard")
        .parquet(path)
    )


def op7_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"))
