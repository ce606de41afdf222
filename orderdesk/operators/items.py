"""Per-booking item aggregates (the fan-out join + ``GROUP_CONCAT`` of the lists).

The reference joins bookings to items and products, then groups by booking.
Here items are aggregated per booking first and the one-row-per-booking result
is joined, so the wide booking rows are never fanned out. The aggregate is
hash-partitioned on ``booking_id``; a later join on the same key reuses it.
"""

from __future__ import annotations

from typing import Optional

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import product_dim

def ordered_listagg(label: Column, sep: str = ", ") -> Column:
    """``GROUP_CONCAT`` with a fixed order: NULL parts skipped, NULL when none
    are left, elements sorted by their text (the reference leaves order open)."""
    parts = F.sort_array(F.collect_list(label))
    return F.when(F.size(parts) > 0, F.array_join(parts, sep))


def item_labels(items: DataFrame, products: DataFrame, with_quantity: bool = True,
                bookings: Optional[DataFrame] = None, bookings_bound: Optional[int] = None) -> DataFrame:
    """``booking_id, products``: ``"name (qty), ..."`` or ``"name, ..."``.

    ``bookings`` (one ``id`` column) restricts the work to those bookings with
    a semi join before any aggregation. ``bookings_bound`` is the ``n`` of a
    top-n: then the ids are broadcast, so the items are filtered in place
    instead of being shuffled for the semi join. A booking's text is one
    output value; a booking with millions of lines is bounded by that value.
    """
    li = items.select("booking_id", "product_id", "quantity")
    if bookings is not None:
        ids = bookings.select(F.col("id").alias("booking_id"))
        if bookings_bound is not None:
            ids = F.broadcast(ids)
        li = li.join(ids, "booking_id", "left_semi")
    j = li.join(product_dim(products, "name"), "product_id", "left")
    label = (F.concat(F.col("name"), F.lit(" ("), F.col("quantity").cast("string"), F.lit(")"))
             if with_quantity else F.col("name"))
    return j.groupBy("booking_id").agg(ordered_listagg(label).alias("products"))


def booking_labels(items: DataFrame, products: DataFrame) -> DataFrame:
    """Both item texts of every booking in one pass: ``booking_id,
    products_qty`` (``"name (qty), ..."``) and ``products_names``. Items and
    product names are never edited once a booking is written, so this table
    only grows: store it next to the bookings (``sources.bucketed``) and
    append the labels of new bookings."""
    li = items.select("booking_id", "product_id", "quantity").join(product_dim(products, "name"),
                                                                    "product_id", "left")
    qty = F.concat(F.col("name"), F.lit(" ("), F.col("quantity").cast("string"), F.lit(")"))
    return li.groupBy("booking_id").agg(ordered_listagg(qty).alias("products_qty"),
                                        ordered_listagg(F.col("name")).alias("products_names"))


def with_item_labels(b: DataFrame, items: DataFrame, products: DataFrame,
                     with_quantity: bool = True, restrict: Optional[DataFrame] = None,
                     bound: Optional[int] = None, stored: Optional[DataFrame] = None) -> DataFrame:
    """``b`` plus a ``products`` column. ``restrict`` (bookings with an ``id``,
    best taken before names are joined) semi-joins the items to those bookings
    first (use it when a filter or top-k narrows ``b``); ``bound`` is the ``n``
    of a top-n behind it. ``stored`` is a
    ``booking_labels`` table: then nothing is aggregated, it is only joined."""
    if stored is not None:
        labels = stored.select("booking_id", F.col("products_qty" if with_quantity else "products_names")
                               .alias("products"))
        if bound is not None and restrict is not None:
            # A top-n: filter the stored texts in place with its broadcast ids
            # instead of shuffling them.
            ids = F.broadcast(restrict.select(F.col("id").alias("booking_id")))
            labels = labels.join(ids, "booking_id", "left_semi")
        return b.join(labels, b["id"] == labels["booking_id"], "left").drop("booking_id")
    labels = item_labels(items, products, with_quantity,
                         bookings=None if restrict is None else restrict.select("id"), bookings_bound=bound)
    return b.join(labels, b["id"] == labels["booking_id"], "left").drop("booking_id")
