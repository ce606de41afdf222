"""Display texts of the reference's pages, as Columns.

``format_number`` rounds half-even, PHP's ``number_format`` half away from
zero, so every helper rounds first with ``round`` (HALF_UP) and then formats.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def currency(x: Column) -> Column:
    """``$1,234.50``."""
    return F.concat(F.lit("$"), F.format_number(F.round(x, 2), 2))


def int_text(n: Column) -> Column:
    """Grouped integer ``12,345``."""
    return F.format_number(n, 0)


def pct_text(x: Column) -> Column:
    """Percent with one decimal, e.g. ``68.8``."""
    return F.format_number(F.round(x, 1), 1)


def date_text(d: Column) -> Column:
    """``Mar 05, 2024`` (NULL stays NULL instead of the epoch day)."""
    return F.date_format(d, "MMM dd, yyyy")


def datetime_text(ts: Column) -> Column:
    """``Mar 05, 2024 10:00``."""
    return F.date_format(ts, "MMM dd, yyyy HH:mm")


def month_key(d: Column) -> Column:
    """``%Y-%m``."""
    return F.date_format(d, "yyyy-MM")


def month_name(d: Column) -> Column:
    """``%M %Y``, e.g. ``January 2024``."""
    return F.date_format(d, "MMMM yyyy")


def status_label(s: Column) -> Column:
    """``ucfirst(str_replace('_', ' ', s))``: ``not_delivered`` → ``Not delivered``."""
    spaced = F.replace(s, F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.substring(spaced, 1, 1)), F.substring(spaced, 2, 1 << 30))


def status_badge(s: Column) -> Column:
    """Badge text of the list pages: first ``_`` replaced, upper-cased."""
    return F.upper(F.regexp_replace(s, "^([^_]*)_", "$1 "))


def payment_badge(payment_type: Column) -> Column:
    """Badge class of the payment type: ``Online Paid`` shows as paid, else pending."""
    return F.when(payment_type == "Online Paid", F.lit("paid")).otherwise(F.lit("pending"))
