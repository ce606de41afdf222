"""Search predicates, blank tests, text cleaning and field formats."""

from __future__ import annotations

import html
import re
from functools import reduce
from typing import Iterable, Optional

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters PHP's trim() removes, and the form-check patterns of
# the reference's browser code (e-mail, then phone).
PHP_TRIM_CHARS = " \t\n\r\x00\x0b"
EMAIL_PATTERN = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
PHONE_PATTERN = r"^[\+]?[\d\s\-\(\)]{10,}$"

# A tag: a comment, or "<" that no whitespace follows, up to the next ">"
# outside quotes; one that is never closed reaches to the end of the text.
_TAG = (r"""<!--[\s\S]*?(?:-->|\z)|<(?:(?:[^ \t\n\x0B\f\r"'>]|"[^"]*(?:"|\z)|'[^']*(?:'|\z))"""
        r"""(?:[^"'>]|"[^"]*(?:"|\z)|'[^']*(?:'|\z))*+)?(?:>|\z)""")
TAG_PATTERN = _TAG
_PYTHON_TAG = re.compile(_TAG.replace(r"\z", r"\Z"))


def is_set(value: Optional[str]) -> bool:
    """PHP truthiness of a request parameter: None, '' and '0' mean "no filter"."""
    return value is not None and value not in ("", "0")


def clean_param(value: Optional[str]) -> Optional[str]:
    """A request parameter cleaned like every form field (``clean_text`` on a
    plain string): trimmed, without tags, HTML-escaped."""
    if value is None:
        return None
    return html.escape(_PYTHON_TAG.sub("", value.strip(PHP_TRIM_CHARS)), quote=True).replace("&#x27;", "&#039;")


def is_blank(c: Column) -> Column:
    """PHP ``empty()`` on a string column: NULL, '' or '0'."""
    return c.isNull() | c.isin("", "0")


def php_trim(c: Column) -> Column:
    return F.trim(c, F.lit(PHP_TRIM_CHARS))


def like_contains(c: Column, search: str) -> Column:
    """``c LIKE '%search%'`` case-insensitively, with the user's ``%``/``_``
    still acting as wildcards (the reference does not escape them). A lone
    backslash is doubled so it matches itself."""
    pattern = "%" + search.replace("\\", "\\\\") + "%"
    return c.cast("string").ilike(pattern)


def any_contains(cols: Iterable[Column], search: str) -> Column:
    """OR of ``like_contains`` over several columns (a text search box)."""
    return reduce(lambda a, b: a | b, (like_contains(c, search) for c in cols))


def all_of(preds: Iterable[Column]) -> Column:
    """AND of the predicates present; TRUE when none (folded away by Catalyst)."""
    return reduce(lambda a, b: a & b, preds, F.lit(True))


def row_contains(cols: Iterable[Column], query: str) -> Column:
    """Whole-row text filter of the list pages: lower-cased substring test over
    all shown cells joined by spaces. ``%`` and ``_`` are literal here."""
    text = F.lower(F.concat_ws(" ", *[c.cast("string") for c in cols]))
    return F.contains(text, F.lit(query.lower()))


def html_escape(c: Column) -> Column:
    """Escape ``& < > " '`` (``&`` first)."""
    out = F.replace(c, F.lit("&"), F.lit("&amp;"))
    for raw, ent in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        out = F.replace(out, F.lit(raw), F.lit(ent))
    return out


def clean_text(c: Column) -> Column:
    """Input cleaning of every form field: trim, strip tags, HTML-escape."""
    return html_escape(F.regexp_replace(php_trim(c), TAG_PATTERN, ""))


def to_int(c: Column) -> Column:
    """Text to a whole number as a request id is read: the leading digits after
    blanks and a sign, else 0 (NULL, no digits, too large for BIGINT)."""
    digits = F.regexp_extract(c, r"^[ \t\n\r\x0B\f]*([+-]?[0-9]+)", 1)
    return F.coalesce(digits.try_cast("long"), F.lit(0).cast("long"))


def email_ok(c: Column) -> Column:
    return c.rlike(EMAIL_PATTERN)


def phone_ok(c: Column) -> Column:
    return php_trim(c).rlike(PHONE_PATTERN)


def required_ok(c: Column) -> Column:
    return F.coalesce(php_trim(c) != "", F.lit(False))
