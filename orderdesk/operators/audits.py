"""Integrity audits: the DDL's constraints and the form rules checked as jobs.

The database enforced keys, references, enum domains, NOT NULL and lengths
on every write; on files nothing does, so each rule becomes a job that lists
the violations. Every audit is one grouped aggregate or one anti join per
rule, unioned; no rule collects a group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as TX
from ..sources import schemas as S
from ..sources.driver import Tables
from .skew import salted_join
from .spread import spread


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def all_tables(t: Tables) -> dict[str, DataFrame]:
    return {"users": t.users, "products": t.products, "bookings": t.bookings,
            "booking_items": t.booking_items, "delivery_details": t.delivery_details,
            "payments": t.payments}


# The declared keys, references, domains, NOT NULL columns and
# text lengths of the reference's schema.
UNIQUE_KEYS = [("users", "id"), ("users", "username"), ("products", "id"), ("products", "sku"),
               ("bookings", "id"), ("booking_items", "id"), ("delivery_details", "id"), ("delivery_details", "booking_id"),
               ("payments", "id"), ("payments", "booking_id")]

FOREIGN_KEYS = [("bookings", "moderator_id", "users"), ("bookings", "accountant_id", "users"),
                ("bookings", "storeman_id", "users"), ("booking_items", "booking_id", "bookings"),
                ("booking_items", "product_id", "products"), ("delivery_details", "booking_id", "bookings"),
                ("delivery_details", "updated_by", "users"), ("payments", "booking_id", "bookings"),
                ("payments", "updated_by", "users")]

ENUMS = [("users", "role", S.ROLES), ("bookings", "payment_type", S.PAYMENT_TYPES),
         ("bookings", "status", S.BOOKING_STATUSES), ("payments", "payment_status", S.PAYMENT_STATUSES)]

NOT_NULL = {"users": ["username", "role", "full_name"],
            "products": ["name", "price", "stock_quantity"],
            "bookings": ["customer_name", "customer_phone", "customer_address", "payment_type", "amount"],
            "booking_items": ["booking_id", "product_id", "quantity", "unit_price"],
            "delivery_details": ["booking_id"],
            "payments": ["booking_id"]}

MAX_LENGTH = [("users", "username", 50), ("users", "full_name", 100), ("users", "email", 100),
              ("products", "name", 200), ("products", "category", 100), ("products", "sku", 50),
              ("bookings", "customer_name", 100), ("bookings", "customer_phone", 20),
              ("delivery_details", "delivery_company", 100), ("delivery_details", "tracking_number", 100),
              ("payments", "payment_method", 50), ("payments", "transaction_id", 100)]


BINARY = "UTF8_BINARY"


def _collation(df: DataFrame, cols: list[str]) -> str:
    """The collation of a table's text columns; values that collide under it are one key."""
    found = {df.schema[c].dataType.collation for c in cols if isinstance(df.schema[c].dataType, T.StringType)} - {BINARY}
    return found.pop() if found else BINARY


def audit_unique(t: Tables) -> DataFrame:
    """Duplicated values of declared unique keys (NULLs never collide):
    ``table_name, key_column, key_value, n``. Under a collation
    (``functions.collation``) texts that it holds equal collide; the first
    spelling is named. Number keys hardly repeat, so they are dealt into
    partitions by the number of rows; texts are combined map-side."""
    tabs = all_tables(t) | {"bookings": t.booking_core}
    parts = []
    for table in dict.fromkeys(name for name, _ in UNIQUE_KEYS):
        # The number keys of a table are stacked and counted in one pass, and so are its text keys.
        cols = [c for name, c in UNIQUE_KEYS if name == table]
        texts = [c for c in cols if isinstance(tabs[table].schema[c].dataType, T.StringType)]
        for some, kind in (([c for c in cols if c not in texts], "long"), (texts, "string")):
            if not some:
                continue
            collation = _collation(tabs[table], some)
            key = F.collate("__value", BINARY)
            values = tabs[table].select(*[F.col(c).cast(kind).alias(c) if kind == "long" else F.col(c) for c in some])
            if len(some) > 1:
                values = values.unpivot([], some, "key_column", "__value")
            else:
                values = values.select(F.lit(some[0]).alias("key_column"), F.col(some[0]).alias("__value"))
            values = values.filter(F.col("__value").isNotNull())
            if kind == "long":
                values = spread(values, *(["key_column"] if len(some) > 1 else []), "__value", rows=tabs[table].count() * len(some))
            first = [] if collation == BINARY else [F.min(key).alias("key_value")]  # one spelling is the value itself
            g = (values.groupBy("key_column", "__value")
                 .agg(F.count(F.lit(1)).alias("n"), *first).filter(F.col("n") > 1))
            value = F.col("key_value") if first else F.col("__value").cast("string")
            parts.append(g.select(F.lit(table).alias("table_name"), "key_column", value.alias("key_value"), "n"))
    return _union(parts)


def audit_fk(t: Tables) -> DataFrame:
    """Child rows whose non-NULL reference has no parent, per missing value:
    ``table_name, fk_column, missing_id, n``. All reference columns of a child
    are stacked and counted per value in one pass; the anti joins with the
    parents' keys then see each value once, so a hot key is one row."""
    tabs = all_tables(t)
    parents = tabs | {"bookings": t.booking_core}
    references: dict[str, list[tuple[str, str]]] = {}
    for child, col, parent in FOREIGN_KEYS:
        references.setdefault(child, []).append((col, parent))
    parts = []
    for child, keys in references.items():
        cols = [col for col, _ in keys]
        stacked = (tabs[child].select(*[F.col(c).cast("long").alias(c) for c in cols])
                   .unpivot([], cols, "fk_column", "missing_id").filter(F.col("missing_id").isNotNull()))
        counts = stacked.groupBy("fk_column", "missing_id").agg(F.count(F.lit(1)).alias("n"))
        for parent in dict.fromkeys(p for _, p in keys):
            known = parents[parent].select(F.col("id").alias("__parent_id"))
            asked = counts.filter(F.col("fk_column").isin(*[c for c, p in keys if p == parent]))
            parts.append(asked.join(known, asked["missing_id"] == known["__parent_id"], "left_anti")
                         .select(F.lit(child).alias("table_name"), "fk_column", "missing_id", "n"))
    return _union(parts)


def audit_enum(t: Tables) -> DataFrame:
    """Values outside an enum's domain: ``table_name, column_name, value, n``; one scan per table."""
    tabs = all_tables(t)
    parts = []
    for table in dict.fromkeys(name for name, _, _ in ENUMS):
        outside = {c: F.when(~F.col(c).isin(*domain), F.col(c)).alias(c) for name, c, domain in ENUMS if name == table}
        some = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in outside])
        stacked = tabs[table].select(*outside.values()).filter(some).unpivot([], list(outside), "column_name", "value")
        g = stacked.filter(F.col("value").isNotNull()).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
        parts.append(g.select(F.lit(table).alias("table_name"), "column_name", "value", "n"))
    return _union(parts)


def audit_not_null(t: Tables) -> DataFrame:
    """NULL count of every NOT NULL column, one scan per table:
    ``table_name, column_name, n_null``."""
    tabs = all_tables(t)
    parts = []
    for table, cols in NOT_NULL.items():
        wide = tabs[table].agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
        long = wide.unpivot([], cols, "column_name", "n_null")
        parts.append(long.select(F.lit(table).alias("table_name"), "column_name", "n_null"))
    return _union(parts)


def _rows_per_table(df: DataFrame, rows: list[dict], aggs: list) -> DataFrame:
    """One scan of ``df`` computing ``aggs``; ``rows`` (dicts of output
    columns, values may reference the aggregates by name) become one row
    each via ``inline`` over the single aggregated row."""
    one = df.agg(*aggs)
    structs = [F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k)
                          for k, v in r.items()]) for r in rows]
    return one.select(F.inline(F.array(*structs)))


def audit_length(t: Tables) -> DataFrame:
    """Texts longer than their declared ``VARCHAR(n)``, counted per column with
    one scan per table: ``table_name, column_name, max_length, n_too_long, longest``."""
    tabs = all_tables(t)
    parts = []
    for table in dict.fromkeys(tbl for tbl, _, _ in MAX_LENGTH):
        specs = [(c, n) for tbl, c, n in MAX_LENGTH if tbl == table]
        aggs, rows = [], []
        for i, (c, n) in enumerate(specs):
            aggs += [F.count_if(F.length(c) > n).alias(f"long{i}"), F.max(F.length(c)).alias(f"max{i}")]
            rows.append({"table_name": table, "column_name": c, "max_length": n,
                         "n_too_long": F.col(f"long{i}"), "longest": F.col(f"max{i}")})
        parts.append(_rows_per_table(tabs[table], rows, aggs))
    return _union(parts)


def audit_formats(t: Tables) -> DataFrame:
    """Form rules over stored rows, one scan per table: required customer
    fields non-blank after trim, phone and e-mail patterns (patterns only
    apply to non-empty values, like the browser checks):
    ``table_name, column_name, rule, n_checked, n_bad``."""
    checks = {
        "bookings": [("customer_name", "required", TX.required_ok),
                     ("customer_phone", "required", TX.required_ok),
                     ("customer_address", "required", TX.required_ok),
                     ("customer_phone", "phone", TX.phone_ok)],
        "users": [("email", "email", TX.email_ok)],
    }
    tabs = all_tables(t)
    parts = []
    for table, specs in checks.items():
        aggs, rows = [], []
        for i, (c, rule, ok) in enumerate(specs):
            applies = F.lit(True) if rule == "required" else F.coalesce(F.col(c) != "", F.lit(False))
            aggs += [F.count_if(applies).alias(f"chk{i}"),
                     F.count_if(applies & ~F.coalesce(ok(F.col(c)), F.lit(False))).alias(f"bad{i}")]
            rows.append({"table_name": table, "column_name": c, "rule": rule,
                         "n_checked": F.col(f"chk{i}"), "n_bad": F.col(f"bad{i}")})
        parts.append(_rows_per_table(tabs[table], rows, aggs))
    return _union(parts)


def audit_amounts(t: Tables) -> DataFrame:
    """Bookings whose amount differs from the sum of their lines:
    ``id, amount, items_total, difference`` (no lines counts as 0)."""
    tot = (t.booking_items.groupBy("booking_id")
           .agg(F.sum(F.col("quantity") * F.col("unit_price")).alias("items_total")))
    b = t.booking_core.select("id", "amount")
    j = b.join(tot, b["id"] == tot["booking_id"], "left")
    items_total = F.coalesce(F.col("items_total"), F.lit(0))
    return (j.filter(F.col("amount") != items_total)
            .select("id", F.col("amount").cast("double").alias("amount"),
                    items_total.cast("double").alias("items_total"),
                    (F.col("amount") - items_total).cast("double").alias("difference")))


def audit_stock(t: Tables, open_statuses=("pending", "approved")) -> DataFrame:
    """Stock against summed open demand per product (bookings not yet
    delivered or refused). Lines are checked one by one when booked, so two
    lines of one product can pass while their sum exceeds stock:
    ``product_id, name, stock_quantity, demand, shortfall``."""
    open_ids = t.booking_core.filter(F.col("status").isin(*open_statuses)).select(F.col("id").alias("booking_id"))
    demand = (t.booking_items.join(open_ids, "booking_id", "left_semi")
              .groupBy("product_id").agg(F.sum("quantity").alias("demand")))
    p = t.products.select(F.col("id").alias("product_id"), "name", "stock_quantity")
    j = p.join(demand, "product_id", "left")
    d = F.coalesce(F.col("demand"), F.lit(0))
    return j.select("product_id", "name", "stock_quantity", d.alias("demand"),
                    F.greatest(d - F.col("stock_quantity"), F.lit(0)).alias("shortfall"))


def cascade_delete(t: Tables, deleted_ids: DataFrame) -> Tables:
    """Tables after deleting the bookings in ``deleted_ids`` (one ``id``
    column): items, payments and delivery details of those bookings go too
    (``ON DELETE CASCADE``)."""
    gone = deleted_ids.select("id").distinct()

    def keep(df: DataFrame, key: str) -> DataFrame:
        ids = gone.withColumnRenamed("id", key)
        return salted_join(df, ids, key, "left_anti")

    return t.replace(bookings=keep(t.bookings, "id"),
                     booking_items=keep(t.booking_items, "booking_id"),
                     payments=keep(t.payments, "booking_id"),
                     delivery_details=keep(t.delivery_details, "booking_id"))


def cascade_delete_summary(t: Tables, deleted_ids: DataFrame) -> DataFrame:
    """Rows per table before and after the cascade: ``table_name, rows_before,
    rows_after``. Rows are counted per booking first (partial aggregation),
    so the join with the deleted ids sees one row per booking."""
    gone = deleted_ids.select("id").distinct().withColumn("__hit", F.lit(True))
    parts = []
    for name, key in (("bookings", "id"), ("booking_items", "booking_id"),
                      ("payments", "booking_id"), ("delivery_details", "booking_id")):
        per_key = getattr(t, "booking_core" if name == "bookings" else name).groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
        j = per_key.join(gone.withColumnRenamed("id", key), key, "left")
        parts.append(j.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("rows_before"),
                           F.coalesce(F.sum(F.when(F.col("__hit").isNull(), F.col("__n"))), F.lit(0))
                           .alias("rows_after"))
                     .select(F.lit(name).alias("table_name"), "rows_before", "rows_after"))
    return _union(parts)
