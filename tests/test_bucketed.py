"""Bucketed storage: same results for every query, and the per-booking
aggregate and joins of the booking-keyed tables plan without a shuffle."""

from __future__ import annotations

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from orderdesk.catalog import registry, tables_for
from orderdesk.plans import lists as L
from orderdesk.sources.bucketed import bucketed_tables, save_bucketed
from tools.check_oracle import digest

from .conftest import SMOKE_DIR


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    t = tables_for(spark, SMOKE_DIR)
    save_bucketed(spark, t, "orderdesk_test_bkt", 4, location=str(tmp_path_factory.mktemp("bkt") / "db"))
    return t, bucketed_tables(spark, "orderdesk_test_bkt", base=t)


def test_booking_list_plans_without_shuffle(spark, both):
    _, bt = both
    # As at scale: no size-based broadcast of the booking-keyed tables.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        staff = bt.replace(users=F.broadcast(bt.users))  # the staff table is small at any scale
        text = _plan(L.booking_list(staff).sortWithinPartitions("id"))  # leave out the page's global sort
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Only broadcasts remain: no hash-partitioning shuffle of the booking-keyed tables,
    # and the stored item texts are joined, not re-aggregated from the items.
    assert "hashpartitioning" not in text
    assert "SortMergeJoin" in text
    assert "ObjectHashAggregate" not in text and "booking_items" not in text


@pytest.mark.parametrize("name", sorted(registry()))
def test_same_results_on_bucketed_tables(both, name):
    t, bt = both
    a, b = registry()[name](t), registry()[name](bt)
    assert digest(a.columns, [tuple(r) for r in a.collect()])[0] == digest(b.columns, [tuple(r) for r in b.collect()])[0]
