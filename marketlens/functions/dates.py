"""Date column functions: period starts (day, Tuesday-start week, month) and
future month starts."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# Period codes accepted by ``period_start``.
FREQ_DAY = "D"
FREQ_WEEK_MON = "W-MON"
FREQ_MONTH = "M"
FREQS = (FREQ_DAY, FREQ_WEEK_MON, FREQ_MONTH)


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def period_start(col, freq: str) -> Column:
    """Start date of the period holding ``col``.

    ``W-MON`` weeks end on Monday, so they start on Tuesday: shift back one day,
    truncate to the ISO (Monday) week, shift forward one day."""
    d = F.to_date(_c(col))
    if freq == FREQ_DAY:
        return d
    if freq == FREQ_MONTH:
        return F.trunc(d, "MM")
    if freq == FREQ_WEEK_MON:
        return F.date_add(F.to_date(F.date_trunc("week", F.date_sub(d, 1))), 1)
    raise ValueError(f"unknown period code {freq!r}; use one of {FREQS}")


def first_day(day: date, freq: str) -> date:
    """B11 for one date on the driver."""
    if freq == FREQ_DAY:
        return day
    if freq == FREQ_MONTH:
        return day.replace(day=1)
    if freq == FREQ_WEEK_MON:
        return day - timedelta((day.weekday() - 1) % 7)
    raise ValueError(f"unknown period code {freq!r}; use one of {FREQS}")


def future_month_starts(last_month, horizon: int) -> Column:
    """Array of the ``horizon`` month starts after ``last_month``."""
    m = F.trunc(_c(last_month), "MM")
    return F.sequence(F.add_months(m, 1), F.add_months(m, horizon), F.expr("interval 1 month"))


def iso_date_prefix(col) -> Column:
    """A date from the first ten characters of a text or date value."""
    return F.try_to_date(F.substring(_c(col).cast("string"), 1, 10), "yyyy-MM-dd")
