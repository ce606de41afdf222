"""Booking-keyed tables stored bucketed on the booking id.

Bookings, their items, payments, delivery details and the per-booking item
texts (``booking_labels``) are all joined and grouped by the booking id.
Written once as catalog tables bucketed (and sorted) on that key with the
same bucket count, the joins between them read co-partitioned buckets and
need no shuffle of the large tables; with the stored item texts the list
pages do not aggregate the items at all. Only the small dimensions are
broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formats as FM
from ..operators.items import booking_labels
from .driver import Tables

BOOKING_KEYED = {"bookings": "id", "booking_items": "booking_id", "payments": "booking_id",
                 "delivery_details": "booking_id", "booking_labels": "booking_id"}
OTHER = ("users", "products")
# Partition column of a table and the date it is the month of.
MONTHS = {"payments": ("payment_month", "payment_date"), "bookings": ("updated_month", "updated_at")}


def with_month(df: DataFrame, name: str) -> DataFrame:
    month, date = MONTHS[name]
    return df.withColumn(month, FM.month_key(F.col(date)))


def save_bucketed(spark: SparkSession, t: Tables, database: str, buckets: int,
                  location: str | None = None, months: bool = False) -> None:
    """Write the six tables and the item texts into ``database``: booking-keyed
    ones bucketed and sorted by the booking id into ``buckets`` buckets (with
    ``months`` inside month partitions, where a table has them), the others plain."""
    where = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}{where}")
    for name, key in BOOKING_KEYED.items():
        df = booking_labels(t.booking_items, t.products) if name == "booking_labels" else getattr(t, name)
        if months and name in MONTHS:
            # A task writes whole buckets, one file per month and bucket.
            writer = with_month(df, name).repartition(buckets, key).write.partitionBy(MONTHS[name][0])
        else:
            writer = df.write
        (writer.mode("overwrite").bucketBy(buckets, key).sortBy(key)
         .format("parquet").saveAsTable(f"{database}.{name}"))
    for name in OTHER:
        getattr(t, name).write.mode("overwrite").format("parquet").saveAsTable(f"{database}.{name}")


def bucketed_tables(spark: SparkSession, database: str, base: Tables | None = None) -> Tables:
    """Tables read from ``database``; job inputs are taken from ``base``."""
    stored = {name: (lambda n=name: spark.table(f"{database}.{n}")) for name in (*BOOKING_KEYED, *OTHER)}
    return base.replace(**stored) if base is not None else Tables(**stored)
