"""A slice of the registered queries against their SQL on the small tables."""

import datetime as dt
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_point

CHECKED = [
    "a7_current_universes", "a10_parquet_sink", "a12_file_fingerprints", "b3_symbol_manifest", "c3_observation_status", "d4_event_bar_features", "e5_asof_join",
    "f_market_state", "i5_date_permissions", "j4_robust_scale", "m15_spread_statistics", "r1_regression_metrics",
    "r5_average_precision", "t3_regression_summary",
]


def plain(value):
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    return value + 0.0 if isinstance(value, float) else value


def order(row):
    return [f"{v:.4f}" if isinstance(v, float) else repr(v) for v in sorted(row, key=lambda v: isinstance(v, float))]


@pytest.fixture(scope="module")
def connection(sf):
    con = duckdb.connect()
    for path in sorted(Path(sf).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    yield con
    con.close()


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, sf, connection, name):
    frame = entry_point.queries()[name](spark, sf)
    columns = sorted(frame.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=order)
    result = connection.execute(entry_point.oracle_sql()[name])
    places = [[d[0] for d in result.description].index(c) for c in columns]
    want = sorted((tuple(plain(row[i]) for i in places) for row in result.fetchall()), key=order)
    assert len(got) == len(want)
    for mine, theirs in zip(got, want):
        for a, b in zip(mine, theirs):
            assert a == (pytest.approx(b, abs=2e-6) if isinstance(b, float) else b)
