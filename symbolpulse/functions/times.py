"""Days, hours and trading days (all timestamps are UTC)."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import as_col


def utc_day(ts: Column | str) -> Column:
    return F.to_date(as_col(ts))


def utc_hour(ts: Column | str) -> Column:
    return F.date_trunc("hour", as_col(ts))


def local_day(ts: Column | str, zone: str = "Europe/Berlin") -> Column:
    """Calendar day in a time zone."""
    return F.to_date(F.from_utc_timestamp(as_col(ts), zone))


def from_epoch(seconds: Column | str) -> Column:
    return F.timestamp_seconds(as_col(seconds))


def last_trading_day(day: Column | str) -> Column:
    """The day itself, or the Friday before a weekend (INC3)."""
    d = as_col(day)
    weekday = F.weekday(d)  # Monday is 0
    return F.date_sub(d, F.greatest(weekday - 4, F.lit(0)))


def last_trading_date(day: date) -> date:
    """:func:`last_trading_day` for a driver-side date."""
    return day - timedelta(days=max(day.weekday() - 4, 0))
