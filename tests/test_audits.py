"""Audits on tables with planted faults (the driver's data has none)."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from orderdesk.operators import audits as A
from orderdesk.sources import schemas as S

from .conftest import ts


def _faulty(spark, golden):
    extra_products = spark.createDataFrame(
        [(6, "Dup", None, None, Decimal("1.00"), 5, "WH001", None, None),
         (7, "NoSku", None, None, Decimal("1.00"), 5, None, None, None),
         (8, "NoSku2", None, None, Decimal("1.00"), 5, None, None, None)], S.PRODUCTS)
    extra_bookings = spark.createDataFrame(
        [(8, "X" * 101, "12345", " ", "Card", Decimal("5.00"), "lost", 77, None, None,
          ts("2024-01-01 00:00:00"), ts("2024-01-01 00:00:00"))], S.BOOKINGS)
    orphan_items = spark.createDataFrame([(8001, 1000, 1, 1, Decimal("99.99")), (65, 8, 555, 1, Decimal("5.00"))],
                                         S.BOOKING_ITEMS)
    return golden.replace(products=golden.products.unionByName(extra_products),
                          bookings=golden.bookings.unionByName(extra_bookings),
                          booking_items=golden.booking_items.unionByName(orphan_items))


def test_unique_ignores_nulls(spark, golden):
    rows = [(r["table_name"], r["key_column"], r["key_value"], r["n"])
            for r in A.audit_unique(_faulty(spark, golden)).collect()]
    assert rows == [("products", "sku", "WH001", 2)]


def test_foreign_keys(spark, golden):
    rows = {(r["table_name"], r["fk_column"], r["missing_id"]) for r in A.audit_fk(_faulty(spark, golden)).collect()}
    assert rows == {("bookings", "moderator_id", 77), ("booking_items", "booking_id", 1000),
                    ("booking_items", "product_id", 555)}


def test_enums(spark, golden):
    rows = {(r["column_name"], r["value"]) for r in A.audit_enum(_faulty(spark, golden)).collect()}
    assert rows == {("payment_type", "Card"), ("status", "lost")}


def test_lengths_and_formats(spark, golden):
    t = _faulty(spark, golden)
    ln = {(r["table_name"], r["column_name"]): r["n_too_long"] for r in A.audit_length(t).collect()}
    assert ln[("bookings", "customer_name")] == 1 and ln[("products", "name")] == 0
    fm = {(r["column_name"], r["rule"]): r["n_bad"] for r in A.audit_formats(t).collect()}
    assert fm[("customer_phone", "phone")] == 1 and fm[("customer_address", "required")] == 1


def test_not_null_counts(spark, golden):
    rows = {(r["table_name"], r["column_name"]): r["n_null"] for r in A.audit_not_null(golden).collect()}
    assert set(rows.values()) == {0} and ("bookings", "amount") in rows


def test_amounts(golden):
    rows = {r["id"]: r["difference"] for r in A.audit_amounts(golden).collect()}
    # Booking 6 is 3 x 19.99 = 59.97 as stated, booking 3 is 2 x 19.99: all amounts agree.
    assert rows == {}


def test_cascade_delete(spark, golden):
    gone = golden.bookings.filter(F.col("id").isin(1, 7)).select("id")
    after = A.cascade_delete(golden, gone)
    assert sorted(r["id"] for r in after.bookings.collect()) == [2, 3, 4, 5, 6]
    assert after.booking_items.filter("booking_id = 1").count() == 0
    assert after.payments.filter("booking_id = 1").count() == 0
    summary = {r["table_name"]: (r["rows_before"], r["rows_after"])
               for r in A.cascade_delete_summary(golden, gone).collect()}
    assert summary == {"bookings": (7, 5), "booking_items": (7, 5), "payments": (6, 5),
                       "delivery_details": (0, 0)}
