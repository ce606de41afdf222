
from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from orderdesk.functions import dates as D
from orderdesk.functions import formats as FM
from orderdesk.functions import text as TX


def _eval(spark, col, value, dtype):
    df = spark.createDataFrame([(value,)], f"v {dtype}")
    return df.select(col(F.col("v")).alias("x")).first()["x"]


def test_week_mode0(spark):
    cases = {"2023-01-01": 1, "2024-01-01": 0, "2022-12-31": 52, "2024-03-05": 9, "2023-03-01": 9}
    for day, week in cases.items():
        assert _eval(spark, D.week_mode0, dt.date.fromisoformat(day), "date") == week, day


def test_week_mode0_matches_strftime_u(spark):
    df = spark.range(0, 3000).select(F.date_add(F.lit("1995-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    rows = df.select("d", D.week_mode0(F.col("d")).alias("w")).collect()
    assert all(int(r["d"].strftime("%U")) == r["w"] for r in rows)


def test_currency_rounds_half_up(spark):
    assert _eval(spark, FM.currency, Decimal("2.345"), "decimal(10,3)") == "$2.35"
    assert _eval(spark, FM.currency, Decimal("1234567.50"), "decimal(10,2)") == "$1,234,567.50"


def test_status_texts(spark):
    assert _eval(spark, FM.status_label, "not_delivered", "string") == "Not delivered"
    assert _eval(spark, FM.status_badge, "not_delivered", "string") == "NOT DELIVERED"
    assert _eval(spark, FM.status_label, None, "string") is None


def test_date_texts(spark):
    assert _eval(spark, FM.date_text, dt.date(2024, 3, 5), "date") == "Mar 05, 2024"
    assert _eval(spark, FM.datetime_text, dt.datetime(2024, 3, 5, 10, 0), "timestamp_ntz") == "Mar 05, 2024 10:00"
    assert _eval(spark, FM.month_name, dt.date(2024, 1, 20), "date") == "January 2024"


def test_clean_text(spark):
    raw = "  <p>Tom & \"Jerry\" <b>it's</b></p>\n"
    assert _eval(spark, TX.clean_text, raw, "string") == "Tom &amp; &quot;Jerry&quot; it&#039;s"
    assert _eval(spark, TX.clean_text, "a < b", "string") == "a &lt; b"


def test_truthiness():
    assert not TX.is_set(None) and not TX.is_set("") and not TX.is_set("0")
    assert TX.is_set("00") and TX.is_set(" ")


def test_is_blank(spark):
    df = spark.createDataFrame([("",), ("0",), (None,), ("x",), ("00",)], "v string")
    got = [r["b"] for r in df.select(TX.is_blank(F.col("v")).alias("b")).collect()]
    assert got == [True, True, True, False, False]


def test_like_contains_keeps_wildcards(spark):
    df = spark.createDataFrame([("a%b",), ("axb",), ("a\\b",), ("AXB",)], "v string")

    def hits(s):
        return sorted(r["v"] for r in df.filter(TX.like_contains(F.col("v"), s)).collect())

    assert hits("a_b") == ["AXB", "a%b", "a\\b", "axb"]
    assert hits("x") == ["AXB", "axb"]
    assert hits("\\") == ["a\\b"]


def test_row_contains_is_literal(spark):
    df = spark.createDataFrame([("50% off",), ("500 off",)], "v string")
    assert df.filter(TX.row_contains([F.col("v")], "0%")).count() == 1


def test_form_patterns(spark):
    df = spark.createDataFrame([("+1 (555) 123-4567",), ("12345",), ("a@b",), ("a@b.co",)], "v string")
    rows = df.select("v", TX.phone_ok(F.col("v")).alias("p"), TX.email_ok(F.col("v")).alias("e")).collect()
    got = {r["v"]: (r["p"], r["e"]) for r in rows}
    assert got["+1 (555) 123-4567"][0] and not got["12345"][0]
    assert not got["a@b"][1] and got["a@b.co"][1]
