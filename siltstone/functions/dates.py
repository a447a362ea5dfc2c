"""Dates in a person's time zone, date spines and range checks."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.constants import DEFAULT_RANGE_DAYS, MAX_RANGE_DAYS


def local_day(ts: Column, zone: str | Column) -> Column:
    """The calendar day of an instant in a zone, as yyyy-MM-dd; each instant has its own offset."""
    return F.date_format(F.from_utc_timestamp(ts, zone), "yyyy-MM-dd")


def local_start(day: str | date, zone: str, plus_days: int = 0) -> Column:
    """The instant at which a calendar day begins in a zone: a constant that filters on the raw column can use."""
    start = date.fromisoformat(str(day)) + timedelta(plus_days)
    return F.to_utc_timestamp(F.lit(f"{start} 00:00:00").cast("timestamp"), zone)


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def today_in(now: Column, zone: str) -> Column:
    return F.to_date(F.from_utc_timestamp(now, zone))


def checked_range(start: str | None, end: str | None, today: date) -> tuple[date, date]:
    """First and last day of a range with its defaults; ValueError for a bad date, order or span."""
    last = date.fromisoformat(end) if end else today
    first = date.fromisoformat(start) if start else last - timedelta(DEFAULT_RANGE_DAYS - 1)
    if first > last:
        raise ValueError('"from" must not be after "to"')
    if (last - first).days >= MAX_RANGE_DAYS:
        raise ValueError(f"Pick at most {MAX_RANGE_DAYS} days")
    return first, last


def history_days(pairs: Column, min_rows: int, min_days: int = 365) -> Column:
    """Days of history that give min_rows rows for so many pairs; min_days at least, and where there are no pairs."""
    return F.when(pairs > 0, F.greatest(F.lit(min_days).cast("long"), F.ceil(F.lit(min_rows) / pairs))).otherwise(F.lit(min_days).cast("long"))


def snapshot_days(today: Column, days: Column | int) -> Column:
    """The last days up to today, oldest first, as an array."""
    n = days if isinstance(days, Column) else F.lit(days)
    return F.sequence(F.date_sub(today, n - 1), today)
