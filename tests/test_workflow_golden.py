"""Golden cases of FIXTURES.md §4 for the bulk write jobs."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest

from orderdesk.operators import audits as A
from orderdesk.operators import workflow as W
from orderdesk.sources import schemas as S

from .conftest import d, ts

T0 = dt.datetime(2024, 3, 1, 9, 0, 0)


def _bookings(spark, statuses: dict[int, str]):
    return spark.createDataFrame(
        [(i, f"C{i}", "+1 555 0000000", "Street", "Cash on Delivery", Decimal("1.00"), s, 1, None, None,
          T0, T0) for i, s in statuses.items()], S.BOOKINGS)


def _commands(spark, per_booking: dict[int, list[str]]):
    rows, cmd = [], 0
    for b, actions in per_booking.items():
        for k, a in enumerate(actions):
            cmd += 1
            payload = ("Carrier", f"TRK{cmd}", "2024-03-09", "left at door") if a in W.DELIVERY_ACTIONS else (
                None, None, None, None)
            rows.append((cmd, T0 + dt.timedelta(minutes=10 * k), b, 7, a, *payload))
    return spark.createDataFrame(rows, S.WORKFLOW_COMMANDS)


CASES = {11: ["approve", "delivered"], 12: ["reject", "approve", "delivered"],
         13: ["delivered", "approve"], 14: ["delivered", "approve", "not_delivered", "delivered"],
         15: ["approve", "reject"], 16: [], 99: ["approve"]}


@pytest.fixture(scope="module")
def wf(spark):
    bookings = _bookings(spark, {i: "pending" for i in range(11, 17)})
    return bookings, _commands(spark, CASES)


def test_workflow_state(wf):
    bookings, commands = wf
    got = {r["id"]: r["status"] for r in W.workflow_state(bookings, commands).collect()}
    assert got == {11: "delivered", 12: "rejected", 13: "approved", 14: "not_delivered",
                   15: "approved", 16: "pending"}


def test_workflow_actor_and_time(wf):
    bookings, commands = wf
    r = {x["id"]: x for x in W.workflow_state(bookings, commands).collect()}
    assert r[11]["accountant_id"] == 7 and r[11]["storeman_id"] == 7
    assert r[11]["updated_at"] == T0 + dt.timedelta(minutes=10)
    assert r[16]["updated_at"] == T0 and r[16]["accountant_id"] is None


def test_workflow_rejections(wf):
    bookings, commands = wf
    got = {}
    for r in W.workflow_rejections(bookings, commands).collect():
        got[r["booking_id"]] = got.get(r["booking_id"], 0) + 1
    assert got == {12: 2, 13: 1, 14: 2, 15: 1, 99: 1}


def test_delivery_from_approved_start(spark):
    bookings = _bookings(spark, {21: "approved", 22: "delivered", 23: "rejected"})
    commands = _commands(spark, {21: ["approve", "not_delivered", "delivered"], 22: ["delivered"],
                                 23: ["approve"]})
    got = {r["id"]: r["status"] for r in W.workflow_state(bookings, commands).collect()}
    assert got == {21: "not_delivered", 22: "delivered", 23: "rejected"}


def test_delivery_upsert(spark):
    bookings = _bookings(spark, {31: "approved", 32: "approved", 33: "pending"})
    commands = _commands(spark, {31: ["delivered"], 32: ["not_delivered"], 33: ["delivered"]})
    dd = spark.createDataFrame(
        [(500, 31, "OldCo", "OLD1", d("2024-02-01"), "old", 3, ts("2024-02-01 08:00:00"),
          ts("2024-02-01 08:00:00"))], S.DELIVERY_DETAILS)
    rows = {r["booking_id"]: r for r in W.delivery_upsert(dd, bookings, commands).collect()}
    assert set(rows) == {31, 32}  # 33 was not approved: no upsert
    assert rows[31]["id"] == 500 and rows[31]["delivery_company"] == "Carrier"
    assert rows[31]["created_at"] == ts("2024-02-01 08:00:00")  # kept
    assert rows[31]["delivery_date"] == d("2024-03-09") and rows[31]["updated_by"] == 7
    assert rows[32]["tracking_number"].startswith("TRK")


def _payments(spark, ids):
    return spark.createDataFrame(
        [(i, i, "pending", None, None, None, None, None, ts("2024-01-01 00:00:00"), None) for i in ids],
        S.PAYMENTS)


def test_payment_updates_last_valid_wins(spark):
    payments = _payments(spark, [41, 42])
    upd = spark.createDataFrame([
        (1, T0, 41, 2, "paid", "Card", "T1", "2024-03-01", "first"),
        (2, T0 + dt.timedelta(minutes=5), 41, 2, "failed", "Cash", "T2", "", "<b>second</b> & more"),
        (3, T0 + dt.timedelta(minutes=9), 41, 2, "refunded", "Cash", "T3", "", "invalid status"),
        (4, T0, 43, 2, "paid", "Card", "T4", "", "no payment row"),
    ], S.PAYMENT_UPDATES)
    rows = {r["booking_id"]: r for r in W.payment_updates_applied(payments, upd).collect()}
    r = rows[41]
    assert (r["payment_status"], r["payment_method"], r["transaction_id"], r["payment_date"]) == (
        "failed", "Cash", "T2", None)
    assert r["notes"] == "second &amp; more"  # tags stripped, & escaped
    assert rows[42]["payment_status"] == "pending" and rows[42]["updated_at"] is None
    rej = {r["cmd_id"]: r["reason"] for r in W.payment_update_rejections(payments, upd).collect()}
    assert rej == {3: W.MSG_BAD_PAYMENT_STATUS, 4: W.MSG_NO_PAYMENT}


@pytest.fixture(scope="module")
def requests(spark, golden):
    heads = {"complete": "1234567890", "blank_phone": "   ", "no_lines": "1", "bad_line": "1",
             "unknown": "1", "only_empty": "1", "skip_empty": "1", "same_twice": "1"}
    ids = {k: i for i, k in enumerate(heads, start=1)}
    req = spark.createDataFrame(
        [(ids[k], "Test Customer", ph, "Test Address", "Cash on Delivery", 1) for k, ph in heads.items()],
        S.BOOKING_REQUESTS)
    lines = [("complete", 1, 1, 2), ("complete", 2, 4, 3), ("blank_phone", 1, 1, 1),
             ("bad_line", 1, 4, 1), ("bad_line", 2, 3, 31), ("unknown", 1, 99, 1),
             ("only_empty", 1, None, 1), ("only_empty", 2, 2, 0), ("skip_empty", 1, None, 1),
             ("skip_empty", 2, 2, 1), ("same_twice", 1, 3, 20), ("same_twice", 2, 3, 20)]
    items = spark.createDataFrame([(ids[k], ln, p, q) for k, ln, p, q in lines], S.BOOKING_REQUEST_ITEMS)
    return ids, req, items


def test_price_requests(requests, golden):
    ids, req, items = requests
    out = {r["request_id"]: r for r in W.price_requests(req, items, golden.products).collect()}
    by = {k: out[i] for k, i in ids.items()}
    assert (by["complete"]["outcome"], by["complete"]["amount"]) == ("accepted", 229.95)
    assert by["blank_phone"]["message"] == W.MSG_MISSING_CUSTOMER
    assert by["no_lines"]["message"] == W.MSG_NO_ITEMS
    assert by["bad_line"]["message"] == "Insufficient stock for Bluetooth Speaker. Available: 30, Requested: 31"
    assert by["unknown"]["message"] == W.MSG_INVALID_PRODUCT
    assert by["only_empty"]["message"] == W.MSG_NO_VALID_ITEMS
    assert (by["skip_empty"]["outcome"], by["skip_empty"]["amount"]) == ("accepted", 19.99)
    assert (by["same_twice"]["outcome"], by["same_twice"]["amount"]) == ("accepted", 3199.6)


def test_accepted_request_rows(requests, golden):
    ids, req, items = requests
    nb = W.new_bookings(req, items, golden.products).collect()
    assert {r["id"] for r in nb} == {ids["complete"], ids["skip_empty"], ids["same_twice"]}
    assert all(r["status"] == "pending" for r in nb)
    pays = W.initial_payments(req, items, golden.products).collect()
    assert {(r["payment_status"], r["payment_date"]) for r in pays} == {("pending", None)}
    lines = W.new_booking_items(req, items, golden.products).filter(f"booking_id = {ids['bad_line']}")
    assert lines.count() == 0  # all or nothing


def test_stock_audit_sums_lines(spark, golden):
    # Two accepted lines of product 3 (20 + 20) exceed its stock of 30 together.
    b = golden.bookings.limit(0).unionByName(_bookings(spark, {900: "pending"}))
    items = spark.createDataFrame([(7201, 900, 3, 20, Decimal("79.99")), (7202, 900, 3, 20, Decimal("79.99"))],
                                  S.BOOKING_ITEMS)
    t = golden.replace(bookings=b, booking_items=items)
    rows = {r["product_id"]: r for r in A.audit_stock(t).collect()}
    assert (rows[3]["demand"], rows[3]["shortfall"]) == (40, 10)
    assert rows[1]["demand"] == 0


def test_request_refused_by_columns(spark, golden):
    req = spark.createDataFrame(
        [(1, "Test Customer", "+1 (555) 000-0000 ext 12", "Addr", "Cash on Delivery", 1),
         (2, "Test Customer", "1234567890", "Addr", "Card", 1),
         (3, "T & C", "1234567890", "Addr", "Online Paid", 1)], S.BOOKING_REQUESTS)
    items = spark.createDataFrame([(1, 1, 1, 1), (2, 1, 1, 1), (3, 1, 1, 1)], S.BOOKING_REQUEST_ITEMS)
    out = {r["request_id"]: (r["outcome"], r["message"])
           for r in W.price_requests(req, items, golden.products).collect()}
    assert out[1] == ("rejected", W.MSG_DB_PHONE)
    assert out[2] == ("rejected", W.MSG_DB_PAYMENT_TYPE)
    assert out[3] == ("accepted", None)
    assert W.new_bookings(req, items, golden.products).first()["customer_name"] == "T &amp; C"


def test_refused_delivery_details_roll_back(spark):
    bookings = _bookings(spark, {51: "approved"})
    rows = [(1, T0, 51, 7, "delivered", "Co", "T" * 101, "2024-03-09", None),
            (2, T0 + dt.timedelta(minutes=1), 51, 8, "not_delivered", "Co", "T2", "2024-03-10", None)]
    commands = spark.createDataFrame(rows, S.WORKFLOW_COMMANDS)
    state = W.workflow_state(bookings, commands).first()
    assert (state["status"], state["storeman_id"]) == ("not_delivered", 8)
    rej = {r["cmd_id"]: r["reason"] for r in W.workflow_rejections(bookings, commands).collect()}
    assert rej == {1: W.MSG_DB_DELIVERY}


def test_refused_payment_update(spark):
    payments = _payments(spark, [61])
    upd = spark.createDataFrame([(1, T0, 61, 2, "paid", "M" * 51, "T1", "", "x"),
                                 (2, T0, 61, 2, "paid", "Card", "T2", "2024-02-30", "x")], S.PAYMENT_UPDATES)
    assert W.payment_updates_applied(payments, upd).first()["payment_status"] == "pending"
    rej = {r["cmd_id"]: r["reason"] for r in W.payment_update_rejections(payments, upd).collect()}
    assert rej == {1: W.MSG_PAYMENT_FAILED, 2: W.MSG_PAYMENT_FAILED}
