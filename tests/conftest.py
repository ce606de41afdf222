"""Shared fixtures: one local Spark session and the golden table set G."""

from __future__ import annotations

import datetime as dt
import os
import sys
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from orderdesk.session import build_session  # noqa: E402
from orderdesk.sources import schemas as S  # noqa: E402
from orderdesk.sources.seed import seed_tables  # noqa: E402

AS_OF = "2024-03-05"
SMOKE_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = build_session(master="local[4]", shuffle_partitions=8, driver_memory="4g")
    yield s
    s.stop()


def ts(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s)


def d(s: str) -> dt.date:
    return dt.date.fromisoformat(s)


@pytest.fixture(scope="session")
def golden(spark):
    """FIXTURES.md §3: seven bookings over the seed catalogue, as_of 2024-03-05."""
    seed = seed_tables(spark)
    price = {1: Decimal("99.99"), 2: Decimal("19.99"), 3: Decimal("79.99"), 4: Decimal("9.99")}
    rows = [  # id, type, amount, status, mod, acc, store, updated_at
        (1, "Online Paid", "119.98", "delivered", 1, 2, 3, "2024-03-05 10:00:00"),
        (2, "Cash on Delivery", "79.99", "pending", 1, None, None, "2024-03-04 00:00:00"),
        (3, "Cash on Delivery", "39.98", "approved", 1, 2, None, "2024-03-02 00:00:00"),
        (4, "Online Paid", "99.99", "delivered", 1, 2, 3, "2023-03-08 00:00:00"),
        (5, "Cash on Delivery", "9.99", "rejected", 1, 2, None, "2024-02-10 00:00:00"),
        (6, "Cash on Delivery", "59.97", "not_delivered", 1, 2, 3, "2024-01-18 00:00:00"),
        (7, "Cash on Delivery", "0.00", "pending", None, None, None, "2024-03-05 00:00:00"),
    ]
    bookings = spark.createDataFrame(
        [(i, f"Customer {i}", "+1 555 0000000", f"Street {i}", pt, Decimal(a), st, m, ac, sm,
          ts(u), ts(u)) for i, pt, a, st, m, ac, sm, u in rows], S.BOOKINGS)
    items = [(1, 1, 1, 1), (1, 2, 2, 1), (2, 1, 3, 1), (3, 1, 2, 2), (4, 1, 1, 1), (5, 1, 4, 1), (6, 1, 2, 3)]
    booking_items = spark.createDataFrame(
        [(b * 8 + ln, b, p, q, price[p]) for b, ln, p, q in items], S.BOOKING_ITEMS)
    pays = [(1, "paid", "2024-03-05"), (2, "pending", None), (3, "paid", None), (4, "paid", "2023-03-01"),
            (5, "failed", None), (6, "paid", "2024-01-20")]
    payments = spark.createDataFrame(
        [(b, b, st, d(pd) if pd else None, None, None, None, None, None, None) for b, st, pd in pays],
        S.PAYMENTS)
    return seed.replace(bookings=bookings, booking_items=booking_items, payments=payments)
