"""Connected components of a graph of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeweave.session import written

MOST_ROUNDS = 60


def _lowest(pairs: DataFrame) -> DataFrame:
    """pairs(u, v) with m, the smallest of u and its v. Combined before the shuffle."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return pairs.join(least, "u")


def _mark(links: DataFrame) -> tuple:
    return tuple(
        links.agg(
            F.count(F.lit(1)),
            F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
        ).first()
    )


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of links(u, v): the smallest node that it reaches.

    Large star: every larger neighbour of a node is linked to the smallest one. Small star:
    so is every smaller one. Both keep the components; they end when each node is linked to
    its smallest alone, after a number of rounds that grows with the logarithm of a
    component's size. Each round is written to the shared folder.
    """
    forward = links.select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).filter("u > v").distinct()
    forward = written(forward, "links")
    mark = _mark(forward)
    for _ in range(MOST_ROUNDS):
        if not mark[0]:
            break
        both = forward.select("u", "v").unionByName(forward.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _lowest(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u > v").distinct()
        low = _lowest(large)
        small = low.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v"))
        )
        forward = written(small.filter("u > v").distinct(), "links")
        before, mark = mark, _mark(forward)
        if mark == before:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = forward.select(F.col("v").alias("node")).distinct()
    return forward.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
