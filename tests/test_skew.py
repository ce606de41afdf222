"""Hot-key salting: identical results to plain joins, and the hot key is
actually split. Thresholds are lowered so the small fixtures have hot keys."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from orderdesk.operators import skew
from tools.check_oracle import TABLES, digest

from .conftest import SMOKE_DIR
from .test_bruteforce import test_workflow_matches_sequential_replay


@pytest.fixture
def low_thresholds(monkeypatch):
    monkeypatch.setattr(skew, "ROWS_PER_SALT", 50)


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, low_thresholds, how):
    big = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 100).alias("k"), F.col("id").alias("v"))
    small = spark.range(0, 30).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))
    assert [r["k"] for r in skew.hot_keys(big, "k").collect()] == [0]
    assert _rows(skew.salted_join(big, small, "k", how)) == _rows(big.join(small, "k", how))


def test_salts_follow_the_number_of_rows(spark, low_thresholds):
    big = spark.range(2600).select(F.when(F.col("id") < 2000, F.lit(7)).when(F.col("id") < 2500, F.lit(8))
                                   .otherwise(F.col("id")).alias("k"), F.lit("same").alias("v"))
    assert {r["k"]: r["__salts"] for r in skew.hot_keys(big, "k").collect()} == {7: 40, 8: 10}


def test_every_hot_key_is_split_and_equal_rows_spread(spark, low_thresholds):
    big = spark.range(0, 4000, 1, 8).select((F.col("id") % 20).alias("k"), F.lit("same").alias("v"))
    small = spark.range(20).select(F.col("id").alias("k"), F.col("id").alias("w"))
    assert skew.hot_keys(big, "k").count() == 20
    assert _rows(skew.salted_join(big, small, "k")) == _rows(big.join(small, "k"))
    one = big.filter("k = 3").withColumn("salt", F.pmod(F.xxhash64("k", "v", F.spark_partition_id()), F.lit(4)))
    assert one.select("salt").distinct().count() > 1


@pytest.mark.parametrize("how", ["inner", "left", "left_anti"])
def test_results_do_not_hang_on_exchange_reuse(spark, low_thresholds, how):
    big = spark.range(3000).select((F.col("id") % 7).alias("k"), F.col("id").alias("v"))
    small = spark.range(0, 5).select(F.col("id").alias("k"), F.lit(1).alias("w"))
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        assert _rows(skew.salted_join(big, small, "k", how)) == _rows(big.join(small, "k", how))
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")


def test_workflow_replay_with_salting(spark, low_thresholds):
    test_workflow_matches_sequential_replay(spark)


@pytest.mark.parametrize("name", ["workflow_state", "workflow_rejections", "delivery_upsert",
                                  "payment_update_rejections", "new_booking_items", "top_products",
                                  "cascade_delete"])
def test_salted_queries_match_oracle(spark, low_thresholds, name):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    df = E.queries()[name](spark, sf)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    assert digest(df.columns, rows)[0] == digest(ocols, res.fetchall())[0]


def test_workflow_joins_are_salted_in_the_plan(spark):
    import contextlib
    import io
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        E.queries()["workflow_rejections"](spark, SMOKE_DIR).explain(mode="formatted")
    text = buf.getvalue()
    # Both joins of commands with one-row-per-booking state use (booking_id, __salt).
    assert text.count("__salt") >= 4 and "xxhash64" in text


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_with_null_keys_and_given_list(spark, low_thresholds, how):
    big = spark.range(900).select(
        F.when(F.col("id") % 5 == 0, F.lit(None)).when(F.col("id") % 2 == 0, F.lit(3))
        .otherwise(F.col("id") % 7).cast("long").alias("k"), F.col("id").alias("v"))
    small = spark.range(0, 6).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))
    # A given list with duplicates and a cold key: the result must not change.
    hot = spark.createDataFrame([(3, 4), (3, 2), (5, 1), (None, 3)], "k long, __salts int")
    assert _rows(skew.salted_join(big, small, "k", how, hot=hot)) == _rows(big.join(small, "k", how))
    assert _rows(skew.salted_join(big, small, "k", how)) == _rows(big.join(small, "k", how))
