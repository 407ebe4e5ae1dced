"""Day ranges and time stamps as text."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_DAY = re.compile(r"\d{4}-\d{2}-\d{2}", re.ASCII)


def parse_day(text: str | None) -> dt.date | None:
    """Strict ``yyyy-MM-dd``; anything else, impossible days too, gives None."""
    if text is None or not _DAY.fullmatch(text):
        return None
    try:
        return dt.date.fromisoformat(text)
    except ValueError:
        return None


def _midnight(day: dt.date) -> Column:
    return F.lit(f"{day.isoformat()} 00:00:00").cast("timestamp_ntz")


def from_day(col: str, text: str) -> Column:
    """``col`` falls on the day or later; an unreadable day matches nothing."""
    day = parse_day(text)
    return F.lit(False) if day is None else F.col(col) >= _midnight(day)


def until_day(col: str, text: str) -> Column:
    """``col`` falls on the day or earlier; an unreadable day matches nothing."""
    day = parse_day(text)
    if day is None:
        return F.lit(False)
    if day == dt.date.max:
        return F.col(col).isNotNull()
    return F.col(col) < _midnight(day + dt.timedelta(days=1))


def day_range(col: str, first: str, last: str) -> Column:
    """Both days inclusive, as a plain range on the raw column, so Parquet can prune by it."""
    return from_day(col, first) & until_day(col, last)


def require_days(first: str | None, last: str | None) -> None:
    if not first or not last:
        raise ValueError("both the first and the last day are required")


def stamp_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd_HHmmss")


def day_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def file_stamp(moment: dt.datetime) -> str:
    return moment.strftime("%Y%m%d_%H%M%S")
