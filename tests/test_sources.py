"""Readers, publishing and the registry."""

import json
from zipfile import ZipFile

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from tapeweave.operators import macro
from tapeweave.sources import driver_tables, publish, text

SYMBOLS = [("S_A", "aa.us", "USD", "X", "stock"), ("S_B", "bb.us", "USD", "X", "stock")]
SYMBOL_SCHEMA = "symbol string, source_symbol string, currency string, exchange string, asset_type string"


@pytest.fixture()
def symbols(spark):
    return spark.createDataFrame(SYMBOLS, SYMBOL_SCHEMA)


def test_archives_stream_only_requested_members(spark, symbols, tmp_path):
    header = ",".join(text.BULK_HEADER)
    with ZipFile(tmp_path / "daily.zip", "w") as archive:
        archive.writestr("data/daily/us/big stocks/1/AA.us.txt", f"{header}\nAA.US,D,20200102,000000,1,2,0.5,1.5,100,0\n")
        archive.writestr("data/daily/us/big stocks/1/zz.us.txt", f"{header}\nZZ.US,D,20200102,000000,1,2,0.5,1.5,100,0\n")
        archive.writestr("readme.md", "no")
    inventory = text.archive_inventory(spark, str(tmp_path)).collect()
    assert {(r.source_symbol, r.market, r.category) for r in inventory} == {
        ("aa.us", "us", "big stocks"), ("zz.us", "us", "big stocks"),
    }
    rows = text.read_archives(spark, str(tmp_path), symbols).collect()
    assert len(rows) == 1 and rows[0].symbol == "S_A" and rows[0].close == 1.5 and str(rows[0].date) == "2020-01-02"
    assert tuple(text.read_archives(spark, str(tmp_path), symbols).columns) == text.PRICE_COLUMNS
    resolution = text.resolve_members(text.archive_inventory(spark, str(tmp_path)), symbols)
    assert [r.source_symbol for r in text.unavailable_symbols(resolution).collect()] == ["bb.us"]


def test_ambiguous_member_is_an_error(spark, symbols, tmp_path):
    for name in ("one", "two"):
        with ZipFile(tmp_path / f"{name}.zip", "w") as archive:
            archive.writestr("a/b/c/d/aa.us.txt", "x")
    with pytest.raises(ValueError):
        text.unavailable_symbols(text.resolve_members(text.archive_inventory(spark, str(tmp_path)), symbols))


def test_csv_header_is_trimmed_and_checked(spark, symbols, tmp_path):
    (tmp_path / "aa.csv").write_text(" Date,Open ,HIGH,low,Close,Volume\n2020-01-02,1,2,0.5,1.5,NaN\n")
    row = text.read_symbol_csv(spark, str(tmp_path / "aa.csv"), symbols, "aa.us").first()
    assert row.close == 1.5 and row.volume is None and row.quality_flag == "ok"
    (tmp_path / "bad.csv").write_text("Date,Open\n2020-01-02,1\n")
    with pytest.raises(ValueError):
        text.read_symbol_csv(spark, str(tmp_path / "bad.csv"), symbols, "aa.us")


def test_macro_json_values(spark, tmp_path):
    document = {"observations": [{"date": "2020-01-03", "value": "1.5"}, {"date": "2020-01-04", "value": "."}]}
    (tmp_path / "VIXCLS.json").write_text(json.dumps(document, indent=2))
    rows = {str(r.date): r for r in text.read_macro_json(spark, str(tmp_path)).collect()}
    assert rows["2020-01-03"].value == 1.5 and rows["2020-01-04"].value is None
    assert rows["2020-01-03"].series_id == "VIXCLS"
    definitions = spark.createDataFrame(
        [("VIXCLS", "vix", 5, None)], "series_id string, series_name string, lag_business_days int, revised_data_flag boolean"
    )
    loaded = macro.with_availability(text.read_macro_json(spark, str(tmp_path)), definitions)
    assert [str(r.asof_date) for r in loaded.orderBy("date").collect()] == ["2020-01-10", "2020-01-10"]
    assert loaded.first().revised_data_flag


def test_universe_lists(spark, tmp_path):
    (tmp_path / "sp500_current.csv").write_text("symbol,name\nBRK.B,Berkshire\n")
    (tmp_path / "sp500_changes.csv").write_text(
        'effective_date,added_symbol,added_name,removed_symbol,removed_name\n"April 9, 2026",A,B,,\nsoon,C,D,E,F\n'
    )
    current = text.read_current_universes(spark, str(tmp_path)).first()
    assert (current.universe_name, current.source_symbol, current.survivorship_bias) == ("sp500", "brk-b.us", "high")
    changes = {r.added_symbol: r for r in text.read_universe_changes(spark, str(tmp_path)).collect()}
    assert str(changes["A"].effective_date) == "2026-04-09" and changes["A"].removed_symbol == ""
    assert changes["C"].effective_date is None


def test_failed_validation_publishes_nothing(spark, tmp_path):
    root, good = str(tmp_path / "db"), spark.range(3)
    first = publish.publish(spark, root, "t", {"ids": good}, derived={"total": "SELECT sum(id) AS s FROM ids"})
    with pytest.raises(ValueError):
        publish.publish(spark, root, "t", {"ids": good}, validations={"none": "SELECT * FROM ids"})
    assert publish.latest_snapshot(spark, root, "t") == first
    assert publish.read_table(spark, root, "t", "total").first().s == 3


def test_content_id_follows_content_not_order(spark):
    df = spark.range(100).select("id", F.col("id").cast("string").alias("name"))
    ids = [publish.content_id({"t": publish.fingerprint(d)}, {"a": 1}) for d in (df, df.orderBy(F.desc("id")).repartition(5))]
    assert ids[0] == ids[1] and len(ids[0]) == 16
    assert publish.content_id({"t": publish.fingerprint(df.limit(99))}, {"a": 1}) != ids[0]
    assert publish.content_id({"t": publish.fingerprint(df)}, {"a": 2}) != ids[0]
    with pytest.raises(ValueError):
        publish.require_same_source("a", "b")


def test_entry_and_registry(spark, sf):
    queries, oracles = entry_point.queries(), entry_point.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 150
    out = entry_point.entry(spark)
    assert out.columns == ["date", "xs_dispersion_1d", "xs_iqr_1d", "breadth_1d", "pct_above_ma_63d", "n_assets"]
    assert out.count() > 2000


def test_universes_of_one_write_are_read_by_name(spark, tmp_path):
    root = str(tmp_path / "lists")
    rows = [("A", "Alpha, Inc", "large cap"), ("B", "Beta", "small_cap"), ("C", "", "large cap")]
    text.write_universes(spark.createDataFrame(rows, "symbol string, name string, universe_name string"), root, "current")
    got = {(r.symbol, r.name, r.universe_name) for r in text.read_current_universes(spark, root).collect()}
    assert got == set(rows)


def test_unchanged_files_are_not_fingerprinted_again(spark, tmp_path):
    place, record = str(tmp_path / "a table"), str(tmp_path / "record")
    rows = [(i, None if i % 7 == 0 else f"n{i}", [i, None] if i % 2 else None, i / 3) for i in range(60)]
    frame = spark.createDataFrame(rows, "id long, name string, tags array<long>, share double")
    frame.filter("id < 40").repartition(3).write.parquet(place)

    def told():
        return publish.combined(publish.file_fingerprints(spark, place, record)).first()

    def entered():
        return spark.read.parquet(record).select("path").collect()

    first = told()
    assert first.row_count == 40 and told() == first
    known = len(entered())
    frame.filter("id >= 40").coalesce(1).write.mode("append").parquet(place)
    assert told().row_count == 60
    assert len(entered()) == known + 1 == len(set(entered()))
    # A result from before the table grew stays what it was beside a later one.
    small = str(tmp_path / "small")
    spark.range(5).write.parquet(small)
    before = publish.file_fingerprints(spark, small, record)
    spark.range(5).write.mode("append").parquet(small)
    both = publish.combined(before).unionByName(publish.combined(publish.file_fingerprints(spark, small, record)))
    assert [r.row_count for r in both.collect()] == [5, 10]
    # Other files with the same rows, and other rows.
    other = str(tmp_path / "other")
    frame.orderBy(F.desc("id")).repartition(5).write.parquet(other)
    whole = publish.combined(publish.file_fingerprints(spark, other, str(tmp_path / "record2"))).first()
    assert whole == told()
    changed = str(tmp_path / "changed")
    frame.withColumn("name", F.when(F.col("id") != 59, F.col("name"))).write.parquet(changed)
    assert publish.combined(publish.file_fingerprints(spark, changed, str(tmp_path / "record3"))).first() != whole
    twice = str(tmp_path / "twice")
    frame.unionByName(frame.limit(1)).write.parquet(twice)
    assert publish.combined(publish.file_fingerprints(spark, twice, str(tmp_path / "record4"))).first().row_count == 61


def test_row_text_keeps_values_apart(spark):
    rows = [("a", "b"), ("ab", ""), ("", "ab"), (None, "ab"), ("ab", None), ("-", "ab"), ("1:a", "b")]
    frame = spark.createDataFrame(rows, "x string, y string")
    assert frame.select(publish.row_text(frame).alias("t")).distinct().count() == len(rows)


def test_one_content_is_published_once(spark, tmp_path):
    root, built = str(tmp_path), []

    def tables():
        built.append(1)
        return {"ids": spark.range(3)}

    first = publish.publish_once(spark, root, "t", "c1", tables)
    assert publish.publish_once(spark, root, "t", "c1", tables) == first and len(built) == 1
    assert publish.publish_once(spark, root, "t", "c2", tables) != first and len(built) == 2


def test_daily_bars_without_ordering_all_rows(spark):
    """Odd rows: null and repeated keys, null prices, null symbols and days; no task sorts the rows of its days."""
    rows = [
        ("a", 1, 10, 1, 5.0, 2.0), ("a", 1, 10, 2, 7.0, 1.0), ("a", 1, 3, 1, 6.0, None), ("a", 1, 3, 1, 6.0, None),
        ("a", 1, 12, 1, None, 1.0), ("a", 2, None, 4, 1.5, 1.0), ("a", 2, None, 3, 2.5, 1.0), ("a", 2, 9, 1, 9.0, 1.0),
        (None, 1, 4, 1, 3.0, 1.0), ("b", None, 4, 2, 8.0, 1.0), ("b", 3, None, None, 4.0, 1.0),
    ]
    ticks = spark.createDataFrame(rows, "symbol string, day int, k long, line int, price double, quantity double").selectExpr(
        "symbol", "date_add(DATE'2020-01-01', day) AS date", "price", "quantity", "struct(k, line) AS seq"
    )
    totals = driver_tables.day_totals(ticks)
    plan = totals._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
    got = driver_tables.daily_bars(totals, ticks)
    want = ticks.groupBy("symbol", "date").agg(
        F.min_by("price", "seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", "seq").alias("close"), F.sum("quantity").alias("volume"),
    )
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.select(*got.columns).collect()} and got.count() == 5
