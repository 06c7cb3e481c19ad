"""Readers for price text, zipped price archives, macro JSON and universe lists."""

from __future__ import annotations

from collections.abc import Iterator
from zipfile import ZipFile

import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeweave.functions.expr import finite_or_null, require_columns
from tapeweave.operators.dims import feed_symbol

# Header of the bulk daily text format and the columns a price file must have.
BULK_HEADER = (
    "<TICKER>", "<PER>", "<DATE>", "<TIME>", "<OPEN>", "<HIGH>", "<LOW>", "<CLOSE>", "<VOL>", "<OPENINT>",
)
REQUIRED_PRICE_COLUMNS = ("date", "open", "high", "low", "close", "volume")
PRICE_COLUMNS = (
    "date", "symbol", "source_symbol", "open", "high", "low", "close", "volume", "source",
    "adjusted_flag", "currency", "exchange", "asset_type", "download_timestamp", "raw_file", "quality_flag",
)
MEMBER_ROWS = 50_000


def local_file(path: str) -> str:
    """Path of a mounted file as Python opens it."""
    return path.removeprefix("file://").removeprefix("file:")


def open_archive(path: str) -> ZipFile:
    """A ZIP opened for random access, on a mounted path or any filesystem Arrow can reach."""
    if "://" in path and not path.startswith("file:"):
        filesystem, inner = FileSystem.from_uri(path)
        return ZipFile(filesystem.open_input_file(inner))
    return ZipFile(local_file(path))


def _clean_header(df: DataFrame) -> DataFrame:
    names = [c.strip().strip("<>").lower() for c in df.columns]
    return df.toDF(*["volume" if n == "vol" else n for n in names])


def normalize_prices(
    raw: DataFrame, symbols: DataFrame, day: Column, source: str, adjusted: bool = False
) -> DataFrame:
    """Canonical price rows of the requested symbols, matched on the feed symbol."""
    numbers = ("open", "high", "low", "close", "volume")
    request = symbols.select(
        "source_symbol", "symbol", "currency", "exchange", "asset_type"
    )
    return raw.join(request, "source_symbol").select(
        day.alias("date"),
        "symbol",
        "source_symbol",
        *[finite_or_null(F.col(c).cast("double")).alias(c) for c in numbers],
        F.lit(source).alias("source"),
        F.lit(adjusted).alias("adjusted_flag"),
        "currency",
        "exchange",
        "asset_type",
        F.col("download_timestamp").cast("timestamp").alias("download_timestamp"),
        "raw_file",
        F.lit("ok").alias("quality_flag"),
    )


def read_bulk_text(spark: SparkSession, path: str, symbols: DataFrame, source: str = "bulk_text") -> DataFrame:
    """Bulk daily text: bracketed header, compact dates, one or many symbols per file."""
    columns = _clean_header(spark.read.option("header", True).option("recursiveFileLookup", True).csv(path))
    require_columns(columns, REQUIRED_PRICE_COLUMNS, path)
    raw = columns.select(
        *columns.columns,
        F.lower("ticker").alias("source_symbol"),
        F.col("_metadata.file_path").alias("raw_file"),
        F.col("_metadata.file_modification_time").alias("download_timestamp"),
    )
    return normalize_prices(raw, symbols, F.to_date("date", "yyyyMMdd"), source)


def read_symbol_csv(
    spark: SparkSession,
    path: str,
    symbols: DataFrame,
    source_symbol: str | None = None,
    source: str = "csv",
    adjusted: bool = False,
) -> DataFrame:
    """Single-instrument CSV files with ISO dates; header names are trimmed and lower-cased.

    The feed symbol is given for one file, or is the source_symbol=... folder of each file.
    """
    columns = _clean_header(spark.read.option("header", True).csv(path))
    require_columns(columns, REQUIRED_PRICE_COLUMNS, path)
    raw = columns.select(
        *[c for c in columns.columns if c != "source_symbol"],
        (F.col("source_symbol") if source_symbol is None else F.lit(source_symbol)).alias("source_symbol"),
        F.col("_metadata.file_path").alias("raw_file"),
        F.current_timestamp().alias("download_timestamp"),
    )
    return normalize_prices(raw, symbols, F.to_date("date"), source, adjusted)


def _list_members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, modified in zip(batch["path"], batch["modificationTime"]):
            with open_archive(path) as archive:
                members = [
                    (path, modified, info.filename, info.compress_size, info.file_size)
                    for info in archive.infolist()
                    if not info.is_dir() and info.filename.lower().endswith(".txt")
                ]
            yield pd.DataFrame(
                members,
                columns=["archive_path", "archive_time", "member_path", "compressed_size", "uncompressed_size"],
            )


def archive_inventory(spark: SparkSession, path: str) -> DataFrame:
    """One row per daily text member of every archive, read from the archive directories."""
    archives = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.zip")
        .load(path)
        .select("path", "modificationTime")
    )
    listed = archives.repartition("path").mapInPandas(
        _list_members,
        "archive_path string, archive_time timestamp, member_path string, compressed_size long, uncompressed_size long",
    )
    parts = F.split("member_path", "/")
    return listed.select(
        F.element_at(F.split("archive_path", "/"), -1).alias("archive"),
        "archive_path",
        "archive_time",
        "member_path",
        F.lower(F.regexp_extract("member_path", r"([^/]+)\.[^./]+$", 1)).alias("source_symbol"),
        F.try_element_at(parts, F.lit(3)).alias("market"),
        F.try_element_at(parts, F.lit(4)).alias("category"),
        "compressed_size",
        "uncompressed_size",
    )


def resolve_members(inventory: DataFrame, requested: DataFrame) -> DataFrame:
    """How many members each requested feed symbol has; exactly one is needed to load it."""
    counts = inventory.groupBy("source_symbol").agg(F.count(F.lit(1)).alias("member_count"))
    found = F.coalesce(F.col("member_count"), F.lit(0))
    return (
        requested.select("source_symbol")
        .distinct()
        .join(counts, "source_symbol", "left")
        .select(
            "source_symbol",
            found.alias("member_count"),
            F.when(found == 0, "unavailable").when(found == 1, "found").otherwise("ambiguous").alias("status"),
        )
    )


def unavailable_symbols(resolution: DataFrame) -> DataFrame:
    ambiguous = resolution.filter(F.col("status") == "ambiguous").limit(5).collect()
    if ambiguous:
        names = ", ".join(row.source_symbol for row in ambiguous)
        raise ValueError(f"more than one archive member for: {names}")
    return resolution.filter(F.col("status") == "unavailable").select("source_symbol")


def _read_members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["date", "open", "high", "low", "close", "volume"]
    for batch in batches:
        for row in batch.itertuples(index=False):
            with open_archive(row.archive_path) as archive, archive.open(row.member_path) as member:
                for chunk in pd.read_csv(member, chunksize=MEMBER_ROWS, dtype=str):
                    chunk.columns = [c.strip().strip("<>").lower() for c in chunk.columns]
                    chunk = chunk.rename(columns={"vol": "volume"})
                    missing = sorted(set(names) - set(chunk.columns))
                    if missing:
                        raise ValueError(f"{row.archive}:{row.member_path} lacks columns: {missing}")
                    yield chunk[names].assign(
                        source_symbol=row.source_symbol,
                        raw_file=f"{row.archive}:{row.member_path}",
                        download_timestamp=row.archive_time,
                    )


def read_archives(spark: SparkSession, path: str, symbols: DataFrame, source: str = "archive") -> DataFrame:
    """Price rows of the requested symbols straight from the archives.

    The unit of work is one member: only names and sizes are shuffled, each task opens
    the archive where it lies and streams its own members.
    """
    inventory = archive_inventory(spark, path)
    wanted = inventory.join(symbols.select("source_symbol").distinct(), "source_symbol", "left_semi")
    raw = wanted.repartition("archive_path", "member_path").mapInPandas(
        _read_members,
        "date string, open string, high string, low string, close string, volume string, "
        "source_symbol string, raw_file string, download_timestamp timestamp",
    )
    return normalize_prices(raw, symbols, F.to_date("date", "yyyyMMdd"), source)


OBSERVATIONS = T.StructType(
    [
        T.StructField("series_id", T.StringType()),
        T.StructField(
            "observations",
            T.ArrayType(
                T.StructType([T.StructField("date", T.StringType()), T.StructField("value", T.StringType())])
            ),
        ),
    ]
)


def read_macro_json(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Observations per series; a '.' or an unreadable value is NULL.

    The series id is the document's own field or, as in raw downloads, the file's name.
    """
    documents = (
        spark.read.schema(OBSERVATIONS)
        .option("multiLine", multi_line)
        .option("recursiveFileLookup", True)
        .json(path)
        .select(
            F.coalesce(
                F.col("series_id"), F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1)
            ).alias("series_id"),
            F.explode("observations").alias("observation"),
        )
    )
    return documents.select(
        "series_id",
        F.to_date("observation.date").alias("date"),
        finite_or_null(F.col("observation.value").try_cast("double")).alias("value"),
    )


#: Column by which lists of several universes are written at once; readers skip it in names.
UNIVERSE_FILE = "universe_file"


def write_universes(rows: DataFrame, root: str, kind: str) -> None:
    """One list per universe_name of the rows, all in one write; kind is current or changes."""
    named = rows.withColumn(UNIVERSE_FILE, F.concat("universe_name", F.lit(f"_{kind}.csv"))).drop("universe_name")
    named.write.partitionBy(UNIVERSE_FILE).option("header", True).csv(root)


def _universe_files(spark: SparkSession, root: str, kind: str, columns: list[str]) -> DataFrame:
    schema = ", ".join(f"{c} string" for c in columns)
    files = spark.read.schema(schema).option("header", True).csv(f"{root}/*_{kind}.csv")
    # The path is a URI: blanks and other characters of a name come escaped, a plus sign does not.
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return files.select(
        *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in columns],
        F.regexp_extract(path, rf"(?:{UNIVERSE_FILE}=)?([^/]+)_{kind}\.csv", 1).alias("universe_name"),
        F.col("_metadata.file_path").alias("source_file"),
    )


def read_current_universes(spark: SparkSession, root: str) -> DataFrame:
    """Current members of every universe, marked as a survivorship-biased backfill."""
    current = _universe_files(spark, root, "current", ["symbol", "name"])
    return current.select(
        "*",
        feed_symbol("symbol").alias("source_symbol"),
        F.lit("current_constituents_backfilled").alias("universe_type"),
        F.lit("high").alias("survivorship_bias"),
        F.lit(False).alias("point_in_time_membership"),
    )


def read_universe_changes(spark: SparkSession, root: str) -> DataFrame:
    """Membership changes; an unreadable effective date is NULL."""
    changes = _universe_files(
        spark,
        root,
        "changes",
        ["effective_date", "added_symbol", "added_name", "removed_symbol", "removed_name"],
    )
    text = F.trim("effective_date")
    day = F.coalesce(
        F.try_to_timestamp(text, F.lit("MMMM d, yyyy")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))
    )
    return changes.withColumn("effective_date", day.cast("date"))
