"""Golden results of FIXTURES.md §3 (hand-derived from the reference's SQL)."""

from __future__ import annotations

from orderdesk.plans import lists as L
from orderdesk.plans import reports as R

from .conftest import AS_OF


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0].asDict()


def test_revenue_overview_ignores_year_for_week_and_month(golden):
    r = one(R.revenue_overview(golden, AS_OF))
    # Booking 4 is a year old but shares week 9 and March; booking 3 has no date.
    assert r == {"total_revenue": 319.92, "today_revenue": 119.98,
                 "week_revenue": 219.97, "month_revenue": 219.97}


def test_revenue_overview_same_year_option(golden):
    r = one(R.revenue_overview(golden, AS_OF, same_year=True))
    assert r["week_revenue"] == 119.98 and r["month_revenue"] == 119.98


def test_monthly_revenue_lower_bound_only(golden):
    rows = [tuple(r) for r in R.monthly_revenue(golden, AS_OF).collect()]
    assert rows == [("2024-01", "January 2024", 59.97, 1, 59.97),
                    ("2024-03", "March 2024", 119.98, 1, 119.98)]


def test_top_products(golden):
    rows = {r["name"]: (r["total_quantity"], r["total_revenue"], r["order_count"])
            for r in R.top_products(golden).collect()}
    assert rows == {"Wireless Headphones": (2, 199.98, 2), "Smartphone Case": (6, 119.94, 3)}


def test_top_products_ranked(golden):
    ranks = [(r["rank"], r["name"]) for r in R.top_products(golden, ranked=True).orderBy("rank").collect()]
    assert ranks == [(1, "Wireless Headphones"), (2, "Smartphone Case")]


def test_payment_type_shares_use_all_paid_revenue(golden):
    rows = {r["payment_type"]: (r["count"], r["revenue"], r["pct"])
            for r in R.payment_type_stats(golden).collect()}
    assert rows == {"Online Paid": (2, 219.97, 68.8), "Cash on Delivery": (2, 99.95, 31.2)}


def test_status_counts_and_invariant(golden):
    r = one(R.booking_stats_full(golden))
    assert r == {"total_bookings": 7, "pending": 2, "approved": 1, "delivered": 2,
                 "not_delivered": 1, "rejected": 1}
    assert sum(v for k, v in r.items() if k != "total_bookings") == r["total_bookings"]


def test_payment_stats_keeps_left_join(golden):
    r = one(R.payment_stats(golden))
    assert r == {"total_payments": 7, "pending_payments": 1, "paid_payments": 4,
                 "failed_payments": 1, "total_revenue": 319.92}
    # Booking 7 has no payment row: it counts in the total, in no bucket.
    assert r["pending_payments"] + r["paid_payments"] + r["failed_payments"] == 6


def test_payment_type_revenue_sums_to_total(golden):
    total = one(R.revenue_overview(golden, AS_OF))["total_revenue"]
    by_type = sum(r["revenue"] for r in R.payment_type_stats(golden).collect())
    assert round(by_type, 2) == total


def test_dashboards(golden):
    assert one(R.dash_accountant(golden)) == {"total_bookings": 7, "pending_approval": 2,
                                              "delivered_orders": 2, "total_revenue": 219.97}
    assert one(R.dash_storeman(golden, AS_OF)) == {"ready_for_delivery": 1, "delivered_today": 1,
                                                   "total_delivered": 2, "not_delivered": 1}
    assert one(R.dash_moderator(golden, 1)) == {"total_products": 5, "low_stock": 0,
                                                "my_bookings": 6, "pending_bookings": 1}


def test_status_distribution_labels(golden):
    rows = [(r["status_label"], r["n"]) for r in R.status_distribution(golden).orderBy("position").collect()]
    assert rows == [("Pending", 2), ("Approved", 1), ("Delivered", 2), ("Not delivered", 1), ("Rejected", 1)]


def test_booking_list_products_text(golden):
    rows = {r["id"]: r["products"] for r in L.booking_list(golden).collect()}
    assert rows[1] == "Smartphone Case (1), Wireless Headphones (1)"
    assert rows[3] == "Smartphone Case (2)"
    assert rows[7] is None


def test_booking_list_sort_bucket_and_names(golden):
    rows = L.booking_list(golden).collect()
    assert [r["id"] for r in rows][:2] == [7, 2]  # pending first, newest first
    first = {r["id"]: r for r in rows}[1]
    assert (first["moderator_name"], first["accountant_name"], first["storeman_name"]) == (
        "Admin Moderator", "Admin Accountant", "Admin Storeman")
    assert first["payment_status"] == "paid"


def test_search_truthiness_and_wildcards(golden):
    assert L.booking_list(golden, search="0").count() == 7  # '0' means no filter
    assert L.booking_list(golden, search="").count() == 7
    assert L.booking_list(golden, search="customer _").count() == 7  # '_' is a wildcard
    assert L.booking_list(golden, search="CUSTOMER 3").count() == 1  # case-insensitive
    assert L.booking_list(golden, search="\\").count() == 0  # a backslash is literal


def test_delivery_list_defaults_to_approved(golden):
    assert [r["id"] for r in L.delivery_list(golden).collect()] == [3]
    assert L.delivery_list(golden, status="").count() == 4


def test_recent_and_pending(golden):
    assert [r["id"] for r in L.recent_bookings(golden, 1).collect()] == [1, 2, 3, 5, 6]
    pend = L.pending_approvals(golden).collect()
    assert [r["id"] for r in pend] == [7, 2]
    assert {r["id"]: r["products"] for r in pend} == {7: None, 2: "Bluetooth Speaker"}


def test_product_search(golden):
    names = [r["name"] for r in L.product_search(golden, search="b", category="Electronics").collect()]
    assert names == ["Bluetooth Speaker", "Power Bank"]
    assert L.product_search(golden, category="0").count() == 5
    assert [r["category"] for r in L.product_categories(golden).collect()] == ["Accessories", "Electronics"]
