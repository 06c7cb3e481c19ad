"""Hand-computed panel, macro and target cases."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeweave.functions.expr import add_business_days
from tapeweave.operators import crosssec, dims, macro, panel, quality, targets


def day(i, start=dt.date(2020, 1, 1)):
    return start + dt.timedelta(days=i)


def price_rows(n=180, symbols=("A", "B")):
    return [
        (day(i), s, 100.0 + k + 0.25 * i, 101.0 + k + 0.25 * i, 99.0 + k + 0.25 * i, 100.0 + k + 0.25 * i, 10.0, "stock")
        for k, s in enumerate(symbols)
        for i in range(n)
    ]


SCHEMA = "date date, symbol string, open double, high double, low double, close double, volume double, asset_type string"


@pytest.fixture(scope="module")
def prices(spark):
    return spark.createDataFrame(price_rows(), SCHEMA)


def test_features_match_pandas(spark, prices):
    holed = prices.withColumn("close", F.when(F.dayofyear("date") % 7 != 0, F.col("close")))
    got = panel.asset_features(holed, (5, 21)).toPandas().sort_values(["symbol", "date"])
    want = holed.toPandas().sort_values(["symbol", "date"])
    for _, g in want.groupby("symbol"):
        mine = got[got.symbol == g.symbol.iloc[0]]
        log = np.log(g.close)
        one = log.diff()
        for h, least in ((5, 5), (21, 10)):
            vol = one.rolling(h, min_periods=least).std() * math.sqrt(252)
            fall = g.close / g.close.rolling(h, min_periods=least).max() - 1
            away = g.close / g.close.rolling(h, min_periods=least).mean() - 1
            path = one.abs().rolling(h, min_periods=least).apply(np.nansum, raw=True)
            for name, series in (
                ("realized_vol", vol),
                ("drawdown", fall),
                ("ma_distance", away),
                ("path_efficiency", log.diff(h).abs() / (path + 1e-12)),
                ("return", log.diff(h)),
            ):
                np.testing.assert_allclose(mine[f"{name}_{h}d"].astype(float), series, atol=1e-9, equal_nan=True)


def test_alignment_status(spark):
    rows = [(day(1), "A", 1.0), (day(3), "A", 1.0), (day(0), "B", 1.0), (day(4), "B", 1.0)]
    prices = spark.createDataFrame(rows, "date date, symbol string, close double")
    manifest = spark.createDataFrame(
        [("A", day(1), day(3), "confirmed_delisted"), ("B", day(0), day(3), "unknown")],
        "symbol string, first_available_date date, last_available_date date, survivorship_status string",
    )
    calendar = spark.createDataFrame([(day(i),) for i in range(5)], "date date")
    got = {(r.symbol, r.date): r.observation_status for r in panel.align(prices, calendar, manifest).collect()}
    assert [got["A", day(i)] for i in range(5)] == [
        "not_listed_yet", "ok", "missing_expected", "ok", "confirmed_delisted",
    ]
    assert got["B", day(4)] == "after_last_observed" and got["B", day(2)] == "missing_expected"
    assert len(got) == 10


def test_breadth_keeps_unknown_returns_in_denominator(spark):
    rows = spark.createDataFrame(
        [(day(0), "A", 0.1), (day(0), "B", None), (day(0), "C", -0.2), (day(1), "A", 0.3)],
        "date date, symbol string, return_1d double",
    )
    got = {r.date: r for r in crosssec.cross_section(rows).collect()}
    assert got[day(0)].breadth_1d == pytest.approx(1 / 3)
    assert got[day(1)].xs_dispersion_1d is None and got[day(0)].n_assets == 3


@pytest.mark.parametrize("lag", [0, 1, 2, 5, 7, 15])
def test_business_days_match_pandas(spark, lag):
    days = spark.createDataFrame([(day(i),) for i in range(40)], "date date")
    got = days.select("date", add_business_days("date", lag).alias("d")).collect()
    for row in got:
        assert row.d == (pd.Timestamp(row.date) + pd.offsets.BusinessDay(lag)).date()


def test_macro_waits_for_availability_and_skips_nulls(spark):
    observations = spark.createDataFrame(
        [("x", day(0), day(2), 1.0), ("x", day(1), day(4), None), ("x", day(3), day(6), 3.0), ("x", day(4), day(6), 4.0)],
        "series_name string, date date, asof_date date, value double",
    )
    calendar = spark.createDataFrame([(day(i),) for i in range(10)], "date date")
    wide = macro.macro_features(observations, calendar, ["x"], (1,))
    levels = [r.x_level for r in wide.orderBy("date").collect()]
    assert levels == [None, None, 1.0, 1.0, 1.0, 1.0, 4.0, 4.0, 4.0, 4.0]
    last = wide.orderBy(F.desc("date")).first()
    assert last.available_asof == day(6) and last.max_source_date_used == day(4)


def test_warmup_gives_first_day_its_change(spark):
    start = dt.date(2020, 3, 2)
    bdays = [d.date() for d in pd.bdate_range(end="2020-03-03", periods=70)]
    observations = spark.createDataFrame(
        [("x", d, d, float(i)) for i, d in enumerate(bdays)],
        "series_name string, date date, asof_date date, value double",
    )
    calendar = spark.createDataFrame([(start,), (dt.date(2020, 3, 3),)], "date date")
    first = macro.macro_features(observations, calendar, ["x"]).orderBy("date").first()
    assert first.date == start and first.x_change_63d == 63.0 and first.x_change_1d == 1.0


def test_targets_match_loops(spark, prices):
    wave = prices.withColumn("close", 100 + 10 * F.sin(F.datediff("date", F.lit("2020-01-01").cast("date")) / 9))
    feats = panel.asset_features(wave, (5,)).withColumn("valid_observation", F.lit(True))
    got = targets.future_targets(feats, "A", (21,)).toPandas().sort_values("date").reset_index(drop=True)
    close = wave.filter("symbol = 'A'").toPandas().sort_values("date").close.to_numpy()
    for i in (0, 50, len(close) - 22):
        path = close[i : i + 22]
        assert got.future_return_21d[i] == pytest.approx(math.log(path[-1] / path[0]))
        assert got.future_max_drawdown_21d[i] == pytest.approx((path / np.maximum.accumulate(path) - 1)[1:].min())
        assert got.future_realized_vol_21d[i] == pytest.approx(np.diff(np.log(path)).std(ddof=1) * math.sqrt(252))
    assert got.future_max_drawdown_21d.isna().sum() == 21


def test_checks_find_planted_rows(spark, prices):
    doubled = prices.unionByName(prices.limit(1))
    assert quality.duplicate_keys(doubled, ["date", "symbol"]).count() == 1
    broken = prices.withColumn("high", F.when(F.col("date") == day(3), 1.0).otherwise(F.col("high")))
    assert quality.bad_ohlc(broken).count() == 2
    leaking = prices.select(
        "date", F.date_add("date", 1).alias("max_source_date_used"), F.lit(None).cast("date").alias("available_asof"),
        F.lit(False).alias("uses_future_data"),
    )
    assert quality.leaking_rows(leaking).count() == prices.count()
    with pytest.raises(ValueError):
        quality.require_clean(quality.check_counts({"bad_ohlc": quality.bad_ohlc(broken)}))


def test_symbols_and_ids(spark):
    row = spark.createDataFrame([(" BRK.B ",)], "t string").select(
        dims.feed_symbol("t").alias("f"), dims.canonical_stock_id("t").alias("c"),
        dims.instrument_id(F.lit("s"), F.lit("brk-b.us"), F.lit("2020-01-01")).alias("i"),
    ).first()
    assert (row.f, row.c) == ("brk-b.us", "STOCK_US_BRK_B")
    import hashlib

    assert row.i == hashlib.sha1(b"s|brk-b.us|2020-01-01").hexdigest()[:16]
