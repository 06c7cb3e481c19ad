"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRADING_DAYS_PER_YEAR = 252
EPSILON = 1e-12


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def finite(value: Column | str) -> Column:
    """True for a number that is not NULL, NaN or infinite; never NULL."""
    c = col(value)
    return F.coalesce(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))


def finite_or_null(value: Column | str) -> Column:
    c = col(value)
    return F.when(finite(c), c)


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """NULL on a zero divisor."""
    return F.try_divide(col(numerator), col(denominator))


def ratio_or_zero(numerator: Column | str, denominator: Column | str) -> Column:
    n, d = col(numerator), col(denominator)
    return F.when(d > 0, n / d).otherwise(F.when(d.isNotNull() & n.isNotNull(), F.lit(0.0)))


def pearson(a: Column | str, b: Column | str) -> Column:
    """Correlation from mergeable moments, NULL where a side is constant."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def rounded(df: DataFrame, digits: int = 6, skip: Iterable[str] = ()) -> DataFrame:
    """Round every double column, without negative zeros; used where results meet other engines."""
    skipped = set(skip)
    return df.select(
        *[
            (F.round(F.col(f"`{name}`"), digits) + F.lit(0.0)).alias(name)
            if kind == "double" and name not in skipped
            else F.col(f"`{name}`")
            for name, kind in df.dtypes
        ]
    )


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def add_business_days(day: Column | str, lag: Column | str | int) -> Column:
    """Move a date by lag business days; with lag 0 a weekend still moves to Monday."""
    d = col(day)
    n = F.lit(lag) if isinstance(lag, int) else col(lag)
    weekday = F.weekday(d)
    rolled = F.when(weekday >= 5, F.date_add(d, 7 - weekday)).otherwise(d)
    base = F.when(weekday >= 5, F.date_sub(d, weekday - 4)).otherwise(d)
    weeks = F.floor((F.weekday(base) + n) / 5).cast("int")
    moved = F.date_add(base, (n + weeks * 2).cast("int"))
    return F.when(n == 0, rolled).otherwise(moved)


def rolling(value: Column, window, aggregate, min_count: int) -> Column:
    """aggregate(value) over the frame, NULL with fewer than min_count known values."""
    return F.when(F.count(value).over(window) >= min_count, aggregate(value).over(window))


def by_symbol(*keys: str, order: str = "date"):
    """History of one instrument: at most one row per calendar day, so it fits one task."""
    return Window.partitionBy(*(keys or ("symbol",))).orderBy(order)


def trailing(horizon: int, *keys: str, order: str = "date"):
    return by_symbol(*keys, order=order).rowsBetween(-(horizon - 1), 0)


def forward(horizon: int, *keys: str, order: str = "date"):
    return by_symbol(*keys, order=order).rowsBetween(1, horizon)


def require_columns(df: DataFrame, required: Iterable[str], what: str) -> None:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"{what} lacks columns: {', '.join(missing)}")
