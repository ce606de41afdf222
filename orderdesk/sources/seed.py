"""Declared schema plus the reference's seed rows (its setup step).

``seed_tables`` gives the three staff users and five products of a fresh
install, with empty bookings, items, payments and delivery details, all
under the declared schemas. ``write_tables``/``read_tables`` store and load a
table bundle as parquet with those schemas (no inference).
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

from . import schemas as S
from .driver import Tables

# The seed rows of a fresh install (users without password hash; e-mail domain neutralised).
SEED_USERS = [
    (1, "admin_mod", "moderator", "Admin Moderator", "mod@example.com", None),
    (2, "admin_acc", "accountant", "Admin Accountant", "acc@example.com", None),
    (3, "admin_store", "storeman", "Admin Storeman", "store@example.com", None),
]
SEED_PRODUCTS = [
    (1, "Wireless Headphones", "High-quality wireless headphones with noise cancellation", "Electronics",
     Decimal("99.99"), 50, "WH001", None, None),
    (2, "Smartphone Case", "Protective case for smartphones", "Accessories", Decimal("19.99"), 100, "SC001",
     None, None),
    (3, "Bluetooth Speaker", "Portable bluetooth speaker with premium sound", "Electronics",
     Decimal("79.99"), 30, "BS001", None, None),
    (4, "USB Cable", "High-speed USB charging cable", "Accessories", Decimal("9.99"), 200, "UC001", None, None),
    (5, "Power Bank", "10000mAh portable power bank", "Electronics", Decimal("39.99"), 75, "PB001", None, None),
]


def seed_tables(spark: SparkSession) -> Tables:
    """A fresh install: seed users and products, every other table empty."""
    def frame(rows, schema) -> DataFrame:
        return spark.createDataFrame(rows, schema=schema)

    return Tables(users=frame(SEED_USERS, S.USERS), products=frame(SEED_PRODUCTS, S.PRODUCTS),
                  bookings=frame([], S.BOOKINGS), booking_items=frame([], S.BOOKING_ITEMS),
                  payments=frame([], S.PAYMENTS), delivery_details=frame([], S.DELIVERY_DETAILS))


def write_tables(t: Tables, root: str, mode: str = "errorifexists") -> None:
    """Write the six database tables as parquet folders under ``root``."""
    for name in S.LOGICAL:
        getattr(t, name).write.mode(mode).parquet(f"{root}/{name}")


def read_tables(spark: SparkSession, root: str) -> Tables:
    """Read the six database tables from ``root`` with their declared schemas."""
    return Tables(**{name: (lambda n=name, s=schema: spark.read.schema(s).parquet(f"{root}/{n}"))
                     for name, schema in S.LOGICAL.items()})
