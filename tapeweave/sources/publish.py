"""Publishing tables as snapshots, fingerprints and content ids."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeweave.session import written

SNAPSHOT_ROWS = "name string, snapshot_id string, location string, published_at timestamp"


def write_parquet(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), mode: str = "errorifexists") -> None:
    writer = df.write.mode(mode).option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_report(df: DataFrame, path: str, form: str) -> None:
    """CSV or JSON report files; the CSV has a header."""
    if form == "csv":
        df.write.option("header", True).csv(path)
    elif form == "json":
        df.write.option("ignoreNullFields", False).json(path)
    else:
        raise ValueError(f"unknown report form {form!r}")


def failed_checks(checks: dict[str, DataFrame]) -> list[tuple[str, int]]:
    """Names and row counts of the checks that found offending rows, from one job."""
    counts = None
    for name, rows in checks.items():
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        counts = one if counts is None else counts.unionByName(one)
    return [] if counts is None else [(r.name, r.n) for r in counts.filter("n > 0").collect()]


def publish(
    spark: SparkSession,
    root: str,
    name: str,
    tables: dict[str, DataFrame],
    derived: dict[str, str] | None = None,
    views: dict[str, str] | None = None,
    drop: tuple[str, ...] = (),
    validations: dict[str, str] | None = None,
) -> str:
    """Write tables and SQL-derived tables, run the validations, then make them visible.

    A snapshot exists for readers once its one-row entry is committed to the snapshot
    list, which is the last step: a failed build leaves no entry.
    """
    snapshot_id = uuid.uuid4().hex
    location = f"{root}/{name}/{snapshot_id}"
    prefix = f"s{snapshot_id[:8]}_"
    created: list[str] = []

    def show(table: str) -> None:
        spark.read.parquet(f"{location}/{table}").createOrReplaceTempView(table)
        created.append(table)

    try:
        for table, df in tables.items():
            folder = prefix + table if table in drop else table
            write_parquet(df, f"{location}/{folder}")
            spark.read.parquet(f"{location}/{folder}").createOrReplaceTempView(table)
            created.append(table)
        for table, sql in (derived or {}).items():
            write_parquet(spark.sql(sql), f"{location}/{table}")
            show(table)
        for view, sql in (views or {}).items():
            spark.sql(sql).createOrReplaceTempView(view)
            created.append(view)
        failures = failed_checks({k: spark.sql(v) for k, v in (validations or {}).items()})
        if failures:
            raise ValueError(f"validation found rows: {failures}")
    finally:
        for view in created:
            spark.catalog.dropTempView(view)
    entry = spark.createDataFrame([(name, snapshot_id, location)], "name string, snapshot_id string, location string")
    entry.withColumn("published_at", F.current_timestamp()).coalesce(1).write.mode("append").json(
        f"{root}/_snapshots"
    )
    return location


def latest_snapshot(spark: SparkSession, root: str, name: str) -> str:
    entries = spark.read.schema(SNAPSHOT_ROWS).json(f"{root}/_snapshots").filter(F.col("name") == name)
    row = entries.agg(F.max_by("location", F.struct("published_at", "snapshot_id")).alias("location")).first()
    if row.location is None:
        raise ValueError(f"no published snapshot of {name}")
    return row.location


def read_table(spark: SparkSession, root: str, name: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{latest_snapshot(spark, root, name)}/{table}")


def fingerprint(df: DataFrame) -> DataFrame:
    """Row count and an order-free content hash; the sum is exact decimal, so it merges anywhere."""
    row_hash = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)])
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.coalesce(F.sum(row_hash.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("hash_sum"),
    )


def row_text(df: DataFrame) -> Column:
    """A row as text that other rows cannot have: by column name, each value behind its length."""

    def text(column: str) -> Column:
        kind, value = df.schema[column].dataType, F.col(f"`{column}`")
        if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            shown = F.to_json(F.struct(value))
            return F.when(value.isNotNull(), shown)
        if isinstance(kind, T.BinaryType):
            return F.hex(value)
        if isinstance(kind, T.TimestampType):
            return F.unix_micros(value).cast("string")
        return value.cast("string")

    parts = [text(c) for c in sorted(df.columns)]
    return F.concat(*[F.coalesce(F.concat(F.length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts])


def multiset_hash(text: Column) -> list[Column]:
    """row_count, hash_a and hash_b: sums of two 60-bit pieces of SHA-256, so any parts of a table add up."""
    digest = F.sha2(text.cast("binary"), 256)
    pieces = [F.conv(F.substring(digest, start, 15), 16, 10).cast("decimal(20,0)") for start in (1, 16)]
    none = F.lit(0).cast("decimal(30,0)")
    return [
        F.count(F.lit(1)).alias("row_count"),
        *[F.coalesce(F.sum(p).cast("decimal(30,0)"), none).alias(n) for p, n in zip(pieces, HASHES, strict=True)],
    ]


HASHES = ("hash_a", "hash_b")
FILE = ["path", "modified", "size"]
FILE_ROWS = "path string, modified timestamp, size long, row_count long, hash_a decimal(30,0), hash_b decimal(30,0)"


def file_fingerprints(spark: SparkSession, location: str, record: str) -> DataFrame:
    """(path, modified, size, row_count, hash_a, hash_b) of each Parquet file at location.

    A file that the record folder knows with its time and size is not read again; the others
    are, all in one job, and enter the record. Files without rows count as such. The record
    only grows: a file that is gone has no row in the result, one entered twice has one.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
    listed = files.load(location).select(
        _plain_path("path").alias("path"), F.col("modificationTime").alias("modified"), F.col("length").alias("size")
    )
    store = spark._jvm.org.apache.hadoop.fs.Path(record)
    if store.getFileSystem(spark._jsc.hadoopConfiguration()).exists(store):
        known = spark.read.schema(FILE_ROWS).parquet(record)
        fresh = listed.join(known, FILE, "left_anti")
    else:
        fresh = listed
    rows = fresh.collect()  # names of new files, which the reader takes from the driver
    if rows:
        paths = [r.path for r in rows]
        reader = spark.read.schema(spark.read.parquet(location).schema)
        if not paths[0].endswith(location.rstrip("/")):
            reader = reader.option("basePath", location)
        data = reader.parquet(*paths)
        # The path is a URI: blanks and other characters of a name come escaped, a plus sign does not.
        source = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
        marked = data.select(row_text(data).alias("_text"), _plain_path(source).alias("path"))
        sums = marked.groupBy("path").agg(*multiset_hash(F.col("_text")))
        new = spark.createDataFrame(rows, listed.schema).join(sums, "path", "left")
        found = [F.coalesce(c, F.lit(0).cast(new.schema[c].dataType)).alias(c) for c in ("row_count", *HASHES)]
        new.select(*FILE, *found).write.mode("append").parquet(record)
    known = spark.read.schema(FILE_ROWS).parquet(record).dropDuplicates(FILE)
    # Written: two scans of a folder that has grown between them count as equal in one plan.
    return written(listed.join(known, FILE), "file-fingerprints")


def _plain_path(path: Column | str) -> Column:
    """Local paths are written with one slash or three."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def combined(files: DataFrame) -> DataFrame:
    """The fingerprint of a table from those of its files."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("decimal(38,0)").alias(c) for c in HASHES]
    return files.agg(F.coalesce(F.sum("row_count"), F.lit(0)).alias("row_count"), *sums)


def publish_once(
    spark: SparkSession, root: str, name: str, content: str, tables: Callable[[], dict[str, DataFrame]]
) -> str:
    """The snapshot of name with this content id; built and published only if there is none."""
    label = f"{name}-{content}"
    try:
        return latest_snapshot(spark, root, label)
    except (ValueError, AnalysisException):  # none of this content, or no list yet
        publish(spark, root, label, tables())
        return latest_snapshot(spark, root, label)


def content_id(fingerprints: dict[str, DataFrame], config: dict) -> str:
    """First 16 hex digits of SHA-256 over the source fingerprints and the canonical configuration."""
    sources = {
        name: [int(v) for v in df.first()] for name, df in sorted(fingerprints.items())
    }
    source_hash = hashlib.sha256(json.dumps(sources, sort_keys=True).encode()).hexdigest()
    canonical = json.dumps(config, sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(f"{source_hash}{canonical}".encode()).hexdigest()[:16]


def require_same_source(left: str, right: str) -> None:
    if left != right:
        raise ValueError(f"datasets come from different sources: {left} and {right}")


def build_metadata(
    prices: DataFrame, features: DataFrame, targets: DataFrame, macro: DataFrame, unavailable: DataFrame
) -> DataFrame:
    """One row of counts and date bounds, each from a single aggregate per table."""
    counts = [
        frame.agg(F.count(F.lit(1))).scalar().alias(f"{name}_row_count")
        for name, frame in (("feature", features), ("target", targets), ("macro_observation", macro))
    ]
    missing = unavailable.agg(F.to_json(F.array_sort(F.collect_set("source_symbol"))))
    return prices.agg(
        F.count(F.lit(1)).alias("price_row_count"),
        F.countDistinct("symbol").alias("symbol_count"),
        F.min("date").alias("raw_price_first_date"),
        F.max("date").alias("raw_price_last_date"),
    ).select("*", *counts, missing.scalar().alias("unavailable_source_symbols"))
