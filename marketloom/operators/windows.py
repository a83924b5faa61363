"""Shared window specifications.

A series holds one row per (asset, date), so its length is bounded by the calendar, whatever the
number of raw ticks behind it. All specs below share the same partitioning and order: Spark plans
one exchange and one sort for any mix of them.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def series(date: str = "price_date", key: str = "asset_id"):
    return Window.partitionBy(key).orderBy(date)


def last_rows(n: int, date: str = "price_date", key: str = "asset_id"):
    return series(date, key).rowsBetween(-(n - 1), 0)


def history(date: str = "price_date", key: str = "asset_id"):
    return series(date, key).rowsBetween(Window.unboundedPreceding, 0)


def whole(date: str = "price_date", key: str = "asset_id"):
    return series(date, key).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def full_window(aggregate: Column, value: Column, n: int, frame, least: int | None = None) -> Column:
    """``aggregate`` over ``frame``, missing until ``least`` (default ``n``) values are present."""
    return F.when(F.count(value).over(frame) >= (least or n), aggregate.over(frame))
