"""
pushed filters, one scan of the items, no window over a booking group."""

from __future__ import annotations

import contextlib
import io

import pytest

from orderdesk import catalog

from .conftest import SMOKE_DIR

QUERIES = catalog.queries()


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_udf(spark, name):
    text = plan(QUERIES[name](spark, SMOKE_DIR))
    for node in ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "FlatMapGroupsInPandas",
                 "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in text, f"{name} plans {node}"


def test_paid_join_is_inner(golden):
    from orderdesk.plans import reports as R
    for df in (R.recent_transactions(golden), R.monthly_revenue(golden), R.payment_type_stats(golden)):
        text = plan(df)
        assert "LeftOuter" not in text and "Inner" in text


def test_top_k_is_take_ordered(spark):
    assert "TakeOrderedAndProject" in plan(QUERIES["top_products"](spark, SMOKE_DIR))


def test_category_filter_reaches_scan(spark):
    text = plan(QUERIES["product_search"](spark, SMOKE_DIR))
    assert "PushedFilters: [IsNotNull(p_type), EqualTo(p_type,ECONOMY)]" in text


def test_items_scanned_once_and_pruned(spark):
    text = plan(QUERIES["booking_list"](spark, SMOKE_DIR))
    assert text.count("lineitem.parquet") == 1
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_quantity:double>" in text


def test_workflow_uses_aggregates_not_windows(spark):
    text = plan(QUERIES["workflow_state"](spark, SMOKE_DIR))
    assert "Window" not in text and "HashAggregate" in text or "SortAggregate" in text


def test_dashboard_single_scan(spark):
    text = plan(QUERIES["dash_accountant"](spark, SMOKE_DIR))
    assert text.count("orders.parquet") == 1


def test_filters_reach_stored_tables(spark, golden, tmp_path):
    """On stored tables (not the driver-data mapping) the status and date
    filters of the revenue reports are pushed into the parquet scans."""
    from orderdesk.plans import lists as L
    from orderdesk.plans import reports as R
    from orderdesk.sources.seed import read_tables, write_tables

    root = str(tmp_path / "db")
    write_tables(golden, root)
    t = read_tables(spark, root)
    text = plan(R.monthly_revenue(t, "2024-03-05"))
    assert "EqualTo(payment_status,paid)" in text
    assert "GreaterThanOrEqual(payment_date,2023-09-05)" in text
    text = plan(L.delivery_list(t))
    assert "In(status, [approved,delivered,not_delivered])" in text or "EqualTo(status,approved)" in text
    assert R.monthly_revenue(t, "2024-03-05").count() == 2
