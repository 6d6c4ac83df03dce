"""Date expressions. Periods are DATE columns: month starts or ISO Mondays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_start(c: Column) -> Column:
    return F.trunc(c, "MM")


def month_end(c: Column) -> Column:
    return F.last_day(c)


def week_start(c: Column) -> Column:
    """The Monday on or before a date."""
    return F.date_sub(c, F.weekday(c))


def following_months(last: Column, n: int) -> Column:
    """Array of the ``n`` month starts after ``last``."""
    return F.sequence(F.add_months(last, 1), F.add_months(last, n), F.expr("INTERVAL 1 MONTH"))


def days_of_month(start: Column) -> Column:
    """Array of all days of the month that starts at ``start``."""
    return F.sequence(start, F.last_day(start))


def months_between_inclusive(first: Column, last: Column) -> Column:
    """Array of month starts from ``first`` to ``last``."""
    return F.sequence(first, last, F.expr("INTERVAL 1 MONTH"))


def parse_month(c: Column) -> Column:
    """``YYYY-MM`` text to the month's first day; null when it is not of that form."""
    return F.when(c.rlike(r"^\d{4}-\d{2}$"), F.try_to_timestamp(c, F.lit("yyyy-MM")).cast("date"))


def parse_us_date(c: Column) -> Column:
    """``M/D/YYYY`` text to a date; null when it is not one."""
    return F.try_to_timestamp(c, F.lit("M/d/yyyy")).cast("date")
