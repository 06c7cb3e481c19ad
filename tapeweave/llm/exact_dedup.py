"""Exact deduplication by skew-safe combining.

Every stage groups by the full normalised text next to its digest, so a digest alone never
makes two texts equal:

1. each task combines its own copies of a text (map-side aggregation),
2. what the tasks found is merged within (digest, salt), where the salt is taken from the
   task, so a text that holds a third of all rows arrives at many reducers, one row a task,
3. the salts' winners are combined to one row per text.

The classes are written without their texts. Rows find their class by digest; stage 3 has
shown that a digest belongs to one text. Digests that belong to several texts keep their
texts in the class table, and their rows are matched by text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeweave.llm.common import SPACE_CLASS, table, take_rows, whole_text
from tapeweave.session import written

SALTS = 32


def normalised(column: str = "text") -> Column:
    return F.regexp_replace(whole_text(column), f"{SPACE_CLASS}+", "")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def text_rows(docs: DataFrame, digest=sha256) -> DataFrame:
    """doc_id, norm, digest and the original text's code points of every row."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.char_length(whole_text()).cast("long").alias("points"),
        normalised().alias("norm"),
    ).withColumn("digest", digest(F.col("norm")))


def text_classes(rows: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row per distinct norm: digest, keep_id, keep_points, group_size, texts, norm.

    texts counts the distinct norms of the digest; norm is null where that is 1.
    """
    # Null ids come last, as in the order "most code points, then smallest doc_id".
    best = F.struct(
        (-F.col("points")).alias("minus_points"),
        F.col("doc_id").isNull().alias("no_id"),
        F.col("doc_id").alias("doc_id"),
    )
    salted = (
        rows.withColumn("salt", F.spark_partition_id() % salts)
        .groupBy("digest", "salt", "norm")
        .agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("n"))
    )
    combined = salted.groupBy("digest", "norm").agg(F.min("best").alias("best"), F.sum("n").alias("group_size"))
    # Different texts of one digest are no hot group: only a digest's collisions meet here.
    per_digest = Window.partitionBy("digest")
    return combined.select(
        "digest",
        F.col("best.doc_id").alias("keep_id"),
        (-F.col("best.minus_points")).alias("keep_points"),
        "group_size",
        F.count(F.lit(1)).over(per_digest).alias("texts"),
        "norm",
    ).withColumn("norm", F.when(F.col("texts") > 1, F.col("norm")))


def deduplicated(docs: DataFrame, salts: int = SALTS, digest=sha256) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without white space; null counts as empty, so null, empty
    and blank texts are one group. The row with the most code points in its original text,
    then the smallest doc_id (null last) stays; of rows that repeat its doc_id and length one
    stays. An empty table gives an empty result. Other columns are left out.
    """
    classes = written(text_classes(text_rows(docs, digest), salts), "text-classes")
    rows = text_rows(docs, digest)
    single = classes.filter("texts = 1").drop("norm", "texts")
    matched = rows.select("doc_id", "points", "digest", sha256(F.col("norm")).alias("text_sha256")).join(single, "digest")
    shared = classes.filter("texts > 1").drop("texts")
    if not shared.isEmpty():
        by_text = rows.join(shared, ["digest", "norm"]).withColumn("text_sha256", sha256(F.col("norm")))
        matched = matched.unionByName(by_text.select(*matched.columns))
    first = Window.partitionBy("text_sha256", "doc_id").orderBy(F.desc("points"))
    best = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("keep_points"))
    return matched.withColumn("place", F.row_number().over(first)).select(
        "doc_id",
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        (best & (F.col("place") == 1)).alias("kept"),
        "text_sha256",
        F.col("points").alias("n_points"),
    )


def row_key() -> Column:
    """Names a document's row for take_rows: rows with one key are equal but for white space."""
    return F.concat_ws(
        "|",
        sha256(normalised()),
        F.char_length(whole_text()).cast("string"),
        F.coalesce(F.col("doc_id").cast("string"), F.lit("none")),
    )


def keep_one_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the rows that deduplicated() keeps, with the columns of docs."""
    kept = deduplicated(docs).filter("kept")
    keys = kept.select(
        F.concat_ws(
            "|", "text_sha256", F.col("n_points").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))
        ).alias("row_key")
    )
    return take_rows(docs, row_key(), written(keys, "kept-rows"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH rows AS (
    SELECT doc_id, length(coalesce(text, '')) AS n_points,
           sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
    FROM documents
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id NULLS LAST) AS place,
           count(*) OVER (PARTITION BY text_sha256) AS group_size,
           first(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id NULLS LAST) AS keep_id
    FROM rows
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256, n_points FROM ranked
"""
