"""Date expressions with the reference's MySQL meaning (all JVM-side Columns)."""

from __future__ import annotations

import datetime as _dt
from typing import Union

from pyspark.sql import Column
from pyspark.sql import functions as F

DateLike = Union[str, _dt.date]

# Default "today" for the driver's data, whose orders end in 2001-08.
DEFAULT_AS_OF = "2001-06-15"


def as_of_date(as_of: DateLike = DEFAULT_AS_OF) -> Column:
    """The job's explicit "today"; jobs never read the wall clock."""
    return F.lit(str(as_of)).cast("date")


def week_mode0(d: Column) -> Column:
    """MySQL ``WEEK(d)`` in its default mode 0: weeks start on Sunday, 0..53.

    Days before the year's first Sunday are week 0. Not ISO ``weekofyear``.
    """
    return ((F.dayofyear(d) + 7 - F.dayofweek(d)) / 7).cast("int")


def same_day(ts: Column, as_of: DateLike = DEFAULT_AS_OF) -> Column:
    """``DATE(ts) = CURDATE()``; Catalyst turns it into a pushed range."""
    return F.to_date(ts) == as_of_date(as_of)


def same_week_any_year(d: Column, as_of: DateLike = DEFAULT_AS_OF, same_year: bool = False) -> Column:
    """``WEEK(d) = WEEK(CURDATE())``: the year is ignored unless ``same_year``."""
    pred = week_mode0(d) == week_mode0(as_of_date(as_of))
    return pred & (F.year(d) == F.year(as_of_date(as_of))) if same_year else pred


def same_month_any_year(d: Column, as_of: DateLike = DEFAULT_AS_OF, same_year: bool = False) -> Column:
    """``MONTH(d) = MONTH(CURDATE())``: the year is ignored unless ``same_year``."""
    pred = F.month(d) == F.month(as_of_date(as_of))
    return pred & (F.year(d) == F.year(as_of_date(as_of))) if same_year else pred


def months_back(as_of: DateLike = DEFAULT_AS_OF, months: int = 6) -> Column:
    """``DATE_SUB(CURDATE(), INTERVAL n MONTH)``, month-end clamped."""
    return F.add_months(as_of_date(as_of), -months)
