"""Registry of named queries over a driver data folder.

Each entry takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
whole logical tables derived from that folder. Parameters are the defaults of
the reference's pages (``as_of`` replaces its clock).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import collation as C
from .functions import dates as D
from .operators import audit_counts as AC
from .operators import audits as A
from .operators import workflow as W
from .plans import documents as DOC
from .plans import lists as L
from .plans import maintained as M
from .plans import reports as R
from .sources.driver import Tables, driver_tables, read_driver_table

QueryFn = Callable[[SparkSession, str], DataFrame]


_TABLES: dict[tuple[int, str], tuple[SparkSession, Tables]] = {}


def tables_for(spark: SparkSession, sf_dir: str) -> Tables:
    """One lazy table bundle per (session, folder), shared by the queries, the
    way an application loads its tables once and runs many reports."""
    key = (id(spark), sf_dir)
    if key not in _TABLES or _TABLES[key][0] is not spark:
        _TABLES[key] = (spark, driver_tables(spark, sf_dir))
    return _TABLES[key][1]


def _on_tables(fn: Callable[[Tables], DataFrame]) -> QueryFn:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(tables_for(spark, sf_dir))
    run.__doc__ = fn.__doc__
    return run


def _counted_audit_unique(t: Tables) -> DataFrame:
    tables = A.all_tables(t)
    return AC.audit_unique(AC.counts(tables, AC.row_counts(tables)))


def _counted_audit_fk(t: Tables) -> DataFrame:
    tables = A.all_tables(t)
    rows = AC.row_counts(tables)
    return AC.audit_fk(AC.counts(tables, rows), rows)


def registry() -> dict[str, Callable[[Tables], DataFrame]]:
    return {
        # reports and stats strips
        "revenue_overview": R.revenue_overview,
        "monthly_revenue": R.monthly_revenue,
        "booking_stats": R.booking_stats,
        "booking_stats_full": R.booking_stats_full,
        "delivery_stats": R.delivery_stats,
        "payment_stats": R.payment_stats,
        "top_products": R.top_products,
        "top_products_ranked": lambda t: R.top_products(t, ranked=True),
        "recent_transactions": R.recent_transactions,
        "payment_type_stats": R.payment_type_stats,
        "status_distribution": R.status_distribution,
        "dash_moderator": R.dash_moderator,
        "dash_accountant": R.dash_accountant,
        "dash_storeman": R.dash_storeman,
        # catalogue, lookups, lists and searches
        "scan_products": L.scan_products,
        "orderable_products": L.orderable_products,
        "low_stock_products": L.low_stock_products,
        "product_categories": L.product_categories,
        "product_search": lambda t: L.product_search(t, search="ring", category="ECONOMY"),
        "user_lookup": L.user_lookup,
        "bookings_by_moderator": L.bookings_by_moderator,
        "delivered_today": L.delivered_today,
        "recent_bookings": L.recent_bookings,
        "pending_approvals": L.pending_approvals,
        "ready_orders": L.ready_orders,
        "booking_list": L.booking_list,
        "booking_search": lambda t: L.booking_list(t, search="7_3"),
        "filtered_bookings": lambda t: L.booking_list(t, search=" <b>77</b> ", status=" approved\n"),
        "delivery_list": L.delivery_list,
        "delivery_list_all": lambda t: L.delivery_list(t, status=""),
        "payment_list": L.payment_list,
        "payment_list_filtered": lambda t: L.payment_list(t, search="12", payment_status="pending",
                                                          booking_status="approved"),
        "row_text_search": lambda t: L.row_text_search(t, "widget (3"),
        "booking_details": L.booking_details,
        # bulk forms of the write requests
        "workflow_state": lambda t: W.workflow_state(t.booking_core, t.workflow_commands),
        "workflow_rejections": lambda t: W.workflow_rejections(t.booking_core, t.workflow_commands),
        "payment_updates_applied": lambda t: W.payment_updates_applied(t.payments, t.payment_updates),
        "payment_update_rejections": lambda t: W.payment_update_rejections(t.payments, t.payment_updates),
        "delivery_upsert": lambda t: W.delivery_upsert(t.delivery_details, t.booking_core, t.workflow_commands),
        "price_requests": lambda t: W.price_requests(t.booking_requests, t.booking_request_items, t.products),
        "request_rejections": lambda t: W.request_rejections(t.booking_requests, t.booking_request_items,
                                                             t.products),
        "new_booking_items": lambda t: W.new_booking_items(t.booking_requests, t.booking_request_items,
                                                           t.products),
        "new_bookings": lambda t: DOC.money_out(W.new_bookings(t.booking_requests, t.booking_request_items, t.products,
                                                               D.DEFAULT_AS_OF)),
        "initial_payments": lambda t: W.initial_payments(t.booking_requests, t.booking_request_items,
                                                         t.products, D.DEFAULT_AS_OF),
        # under a collation that ignores case
        "user_lookup_any_case": lambda t: C.collated_frame(L.user_lookup(C.collated(t), "FRANCE"), "UTF8_BINARY"),
        "category_spellings": lambda t: L.category_spellings(C.collated(M.mixed_case_categories(t))),
        "audit_unique_any_case": lambda t: A.audit_unique(C.collated(M.mixed_case_categories(t))),
        # the same by maintained state: indexes, batches of commands, rollups
        "indexed_booking_search": lambda t: L.indexed_booking_list(t, L.booking_index(t, "mer#%077"), "mer#%077"),
        "indexed_row_search": lambda t: L.indexed_row_search(t, L.row_index(t, "widget (3"), "widget (3"),
        "workflow_state_in_batches": M.workflow_state_in_batches,
        "rolled_revenue_overview": M.rolled_revenue_overview,
        "rolled_payment_type_stats": M.rolled_payment_type_stats,
        "rolled_top_products": M.rolled_top_products,
        "top_products_after_jobs": M.top_products_after_jobs,
        "dash_accountant_after_jobs": M.dash_accountant_after_jobs,
        "delivery_stats_after_jobs": M.delivery_stats_after_jobs,
        "payment_stats_after_jobs": M.payment_stats_after_jobs,
        "monthly_revenue_after_jobs": M.monthly_revenue_after_jobs,
        # documents, chart data, export rows, display texts, carts
        "booking_document": DOC.booking_document,
        "chart_points": DOC.chart_points,
        "chart_series": DOC.chart_json,
        "monthly_csv_rows": DOC.monthly_csv_rows,
        "display_formats": DOC.display_formats,
        "payment_weeks": DOC.payment_weeks,
        "phone_numbers": DOC.phone_numbers,
        "merged_cart_lines": lambda t: DOC.merged_cart_lines(t.cart_lines),
        "cart_totals": DOC.cart_totals,
        # integrity audits
        "counted_audit_unique": _counted_audit_unique,
        "counted_audit_fk": _counted_audit_fk,
        "counted_audit_stock": lambda t: AC.audit_stock(AC.counts(A.all_tables(t)), t.products),
        "audit_unique": A.audit_unique,
        "audit_fk": A.audit_fk,
        "audit_enum": A.audit_enum,
        "audit_not_null": A.audit_not_null,
        "audit_length": A.audit_length,
        "audit_formats": A.audit_formats,
        "audit_amounts": A.audit_amounts,
        "audit_stock": A.audit_stock,
        "cascade_delete": lambda t: A.cascade_delete_summary(
            t, t.booking_core.filter(F.col("status") == "rejected").select("id")),
    }


def _text_queries() -> dict[str, QueryFn]:
    """Input cleaning over the driver's raw texts (whole documents and pages)."""
    return {
        "clean_documents": lambda spark, d: DOC.clean_documents(read_driver_table(spark, d, "documents"), "doc_id", "text"),
        "document_numbers": lambda spark, d: DOC.leading_numbers(read_driver_table(spark, d, "documents"), "doc_id", "text"),
        "clean_pages": lambda spark, d: DOC.clean_documents(read_driver_table(spark, d, "pages"), "page_id", "html"),
    }


def queries() -> dict[str, QueryFn]:
    out = {name: _on_tables(fn) for name, fn in registry().items()}
    out.update(_text_queries())
    return out
