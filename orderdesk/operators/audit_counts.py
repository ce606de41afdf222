"""Audits of a new version from stored counts, without reading old rows.

Key, reference and stock audits are questions about counts: how often each key
value occurs, how often each parent is referred to, how many pieces of a
product are in open bookings. The counts add up over rows, so a job adds those
of its new rows and subtracts those of the rows they replace; the audits read
the counts alone. Stored by a hash of the value, a job's change touches the
buckets of its own values.
"""

from __future__ import annotations

from functools import reduce
from typing import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .audits import FOREIGN_KEYS, UNIQUE_KEYS
from .spread import spread

OPEN = ("pending", "approved")
_BY = ("value_hash", "kind", "table_name", "column_name", "value")


def _row(kind: str, table: str, column: Column, value: Column, n: Column) -> list[Column]:
    name = (F.lit(kind).alias("kind"), F.lit(table).alias("table_name"), column.alias("column_name"), value.cast("string").alias("value"))
    return [F.xxhash64(F.lit(kind), F.lit(table), column, value.cast("string")).alias("value_hash"), *name, n.cast("long").alias("n")]


def row_counts(tables: Mapping[str, DataFrame]) -> dict[str, int]:
    """Rows of whole tables, for ``counts`` and ``audit_fk`` to deal large tables into partitions by them."""
    return {name: df.count() for name, df in tables.items()}


def counts(tables: Mapping[str, DataFrame], rows: Mapping[str, int] | None = None) -> DataFrame:
    """``value_hash, kind, table_name, column_name, value, n`` of some rows of some tables: occurrences of every
    declared key (``key``) and reference (``ref``), and pieces of every product in open bookings (``demand``; needs
    the bookings and their items). All columns of a table are stacked and counted in one pass. With ``rows``
    (``row_counts``), keys are dealt into partitions by their number, since they hardly repeat; references do, and
    are combined map-side."""
    parts = []
    for kind, declared in (("key", [(t, c) for t, c in UNIQUE_KEYS]), ("ref", [(t, c) for t, c, _ in FOREIGN_KEYS])):
        for table in dict.fromkeys(t for t, _ in declared):
            if table not in tables:
                continue
            columns = [c for t, c in declared if t == table]
            stacked = (tables[table].select(*[F.col(c).cast("string").alias(c) for c in columns])
                       .unpivot([], columns, "__column", "__value").filter(F.col("__value").isNotNull()))
            if kind == "key" and rows is not None:
                stacked = spread(stacked, "__column", "__value", rows=rows[table] * len(columns))
            g = stacked.groupBy("__column", "__value").agg(F.count(F.lit(1)).alias("__n"))
            parts.append(g.select(*_row(kind, table, F.col("__column"), F.col("__value"), F.col("__n"))))
    if "bookings" in tables and "booking_items" in tables:
        open_ids = tables["bookings"].filter(F.col("status").isin(*OPEN)).select(F.col("id").alias("booking_id"))
        g = (tables["booking_items"].join(open_ids, "booking_id", "left_semi")
             .groupBy("product_id").agg(F.sum("quantity").alias("__n")).filter(F.col("product_id").isNotNull()))
        parts.append(g.select(*_row("demand", "booking_items", F.lit("product_id"), F.col("product_id"), F.col("__n"))))
    return reduce(DataFrame.unionByName, parts)


def change(old: Mapping[str, DataFrame], new: Mapping[str, DataFrame]) -> DataFrame:
    """What to add to the counts when the rows ``old`` of some tables become ``new``; values that stay are not in it."""
    rows = counts(new).unionByName(counts(old).withColumn("n", -F.col("n")))
    return rows.groupBy(*_BY).agg(F.sum("n").alias("n")).filter(F.col("n") != 0)


def added(stored: DataFrame, *changes: DataFrame) -> DataFrame:
    rows = reduce(DataFrame.unionByName, changes, stored)
    return rows.groupBy(*_BY).agg(F.sum("n").alias("n")).filter(F.col("n") != 0)


# ---------------------------------------------------------------- audits

def audit_unique(c: DataFrame) -> DataFrame:
    """``audits.audit_unique`` from the counts."""
    return c.filter((F.col("kind") == "key") & (F.col("n") > 1)).select(
        "table_name", F.col("column_name").alias("key_column"), F.col("value").alias("key_value"), "n")


def audit_fk(c: DataFrame, rows: Mapping[str, int] | None = None) -> DataFrame:
    """``audits.audit_fk`` from the counts: references to values that no parent has as its id. Of the keys only the
    ids of tables that are referred to are asked for; ``rows`` (``row_counts``) as in ``counts``."""
    parent = F.create_map(*[F.lit(x) for t, col, p in FOREIGN_KEYS for x in (f"{t}.{col}", p)])
    parents = sorted({p for _, _, p in FOREIGN_KEYS})
    refs = c.filter(F.col("kind") == "ref").select(
        "table_name", "column_name", "value", "n", parent[F.concat_ws(".", "table_name", "column_name")].alias("__parent"))
    ids = c.filter((F.col("kind") == "key") & (F.col("column_name") == "id") & F.col("table_name").isin(parents)).select(
        F.col("table_name").alias("__parent"), "value")
    if rows is not None:  # one row per value on either side, so no key is hot
        refs, ids = (spread(side, "__parent", "value", rows=sum(rows.values())) for side in (refs, ids))
    return refs.join(ids, ["__parent", "value"], "left_anti").select(
        "table_name", F.col("column_name").alias("fk_column"), F.col("value").cast("long").alias("missing_id"), "n")


def audit_stock(c: DataFrame, products: DataFrame) -> DataFrame:
    """``audits.audit_stock`` from the counts and the catalogue."""
    demand = c.filter(F.col("kind") == "demand").select(F.col("value").cast("long").alias("product_id"), F.col("n").alias("__n"))
    d = F.coalesce(F.col("__n"), F.lit(0))
    return products.select(F.col("id").alias("product_id"), "name", "stock_quantity").join(demand, "product_id", "left").select(
        "product_id", "name", "stock_quantity", d.alias("demand"), F.greatest(d - F.col("stock_quantity"), F.lit(0)).alias("shortfall"))
