"""Helpers shared by the operators of this folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Characters that contracts call white space: space and \x09 to \x0D.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text with null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def fold(column: str, parts: int) -> Column:
    """crc32 of the id written as text, modulo parts: the fold that contracts name."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(parts))


def take_rows(docs: DataFrame, key: Column, keep: DataFrame) -> DataFrame:
    """Rows of docs whose key is in keep(row_key): one row per key, all columns as they were.

    Of repeated rows with one key the first stays. The numbering uses the partitioning of
    the join, so whole rows are shuffled once.
    """
    name = "__row_key"
    marked = docs.withColumn(name, key)
    joined = marked.join(keep.select(F.col("row_key").alias(name)), name, "left_semi")
    first = Window.partitionBy(name).orderBy(F.lit(0))
    return (
        joined.withColumn("__row_number", F.row_number().over(first))
        .filter("__row_number = 1")
        .select(*[F.col(f"`{c}`") for c in docs.columns])
    )


def bounded_sample(labelled: DataFrame, label: str, keys: list[str], rows: int) -> DataFrame:
    """About `rows` rows of labelled at most, the same number from each label where it has them.

    Rows are chosen by a hash of their keys, so the choice does not depend on partitioning;
    the hard limit of twice as many rows only matters if many rows share one key. Adds
    `__rate`, the share of the label's rows that are taken.
    """
    counts = {row[label]: row["count"] for row in labelled.groupBy(label).count().collect()}
    if not counts:
        return labelled.withColumn("__rate", F.lit(1.0)).limit(0)
    each = max(1, rows // len(counts))
    rate = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, each / n))])[F.col(label)]
    spot = F.pmod(F.xxhash64(*keys), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return labelled.withColumn("__rate", rate).filter(spot < F.col("__rate")).limit(2 * rows)
