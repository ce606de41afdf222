"""Search box semantics against a direct model: case-insensitive substring
LIKE where the user's % and _ stay wildcards and a backslash is literal."""

from __future__ import annotations

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orderdesk.functions import text as TX

ALPHABET = "aB%_\\ x"


def model(value: str, search: str) -> bool:
    rx = "".join(".*" if ch == "%" else "." if ch == "_" else re.escape(ch) for ch in search)
    return re.search(rx, value, re.IGNORECASE | re.DOTALL) is not None


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.text(ALPHABET, max_size=6), min_size=1, max_size=8),
       search=st.text(ALPHABET, min_size=1, max_size=3))
def test_like_contains_matches_model(spark, values, search):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = {r["i"] for r in df.filter(TX.like_contains(F.col("v"), search)).collect()}
    assert got == {i for i, v in enumerate(values) if model(v, search)}


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.one_of(st.none(), st.text("<>&\"' a1-0b/", max_size=12),
                                 st.sampled_from(["2024-02-03", "2024-02-30", " 2024-02-03", "0", ""])),
                       min_size=1, max_size=10),
       n=st.integers(min_value=1, max_value=20))
def test_shortcut_checks_equal_full_checks(spark, values, n):
    from orderdesk.operators import workflow as W
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    c = F.col("v")
    full_fit = F.coalesce(F.length(TX.clean_text(c)) <= n, F.lit(True))
    raw = F.when(~TX.is_blank(TX.clean_text(c)), TX.clean_text(c))
    full_date = raw.isNull() | raw.try_cast("date").isNotNull()
    rows = df.select((W._fits(c, n) == full_fit).alias("a"), (W._date_ok(c) == full_date).alias("b")).collect()
    assert all(r["a"] and r["b"] for r in rows)
