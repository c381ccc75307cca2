"""Calendar column functions.

All functions take a date (or timestamp) column and return a Column, so
they stay inside whole-stage codegen; no lookup join is needed because the
exception lists are a fixed, tiny parameter.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 2019 calendar exceptions as month-day text, unpadded.
# Days that fall on a workday but are holidays:
WORKDAY_HOLIDAYS = ["1-1", "2-4", "2-5", "2-6", "2-7", "2-8", "2-9", "2-10", "4-5", "5-1",
                    "6-7", "9-13", "10-1", "10-2", "10-3", "10-4", "10-5", "10-6", "10-7"]
# Days that fall on a weekend but are worked:
WEEKEND_WORKDAYS = ["2-2", "2-3", "9-29", "10-12"]


@dataclass(frozen=True)
class Calendar:
    """Holiday exceptions. Entries are ``'m-d'`` (every year) or
    ``'yyyy-m-d'`` (one date), both unpadded."""

    holidays: tuple = tuple(WORKDAY_HOLIDAYS)
    workdays: tuple = tuple(WEEKEND_WORKDAYS)
    weekend: tuple = field(default=(6, 7))


DEFAULT_CALENDAR = Calendar()


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def service_date(ts) -> Column:
    return F.to_date(_col(ts))


def iso_weekday(d) -> Column:
    """1 = Monday .. 7 = Sunday (``weekday`` is 0-based Monday)."""
    return (F.weekday(_col(d)) + 1).cast("int")


def day_of_month(d) -> Column:
    return F.dayofmonth(_col(d)).cast("int")


def month_day_key(d) -> Column:
    d = _col(d)
    return F.concat_ws("-", F.month(d), F.dayofmonth(d))


def year_month_day_key(d) -> Column:
    d = _col(d)
    return F.concat_ws("-", F.year(d), F.month(d), F.dayofmonth(d))


def is_holiday(d, calendar: Calendar = DEFAULT_CALENDAR) -> Column:
    """1 for a listed holiday, 0 for a listed workday, else 1 on weekend days."""
    d = _col(d)
    md, ymd = month_day_key(d), year_month_day_key(d)
    hol = list(calendar.holidays)
    work = list(calendar.workdays)
    return (F.when(md.isin(hol) | ymd.isin(hol), 1)
             .when(md.isin(work) | ymd.isin(work), 0)
             .when(iso_weekday(d).isin(list(calendar.weekend)), 1)
             .otherwise(0)).cast("int")


def rotate_weekday(w, days: int = 1) -> Column:
    """ISO weekday moved forward ``days`` (7 -> 1 for one day)."""
    return (((_col(w) - 1 + days) % 7) + 1).cast("int")
