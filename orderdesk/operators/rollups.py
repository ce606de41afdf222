"""Daily rollups of the dashboards, kept up to date by adding and retracting.

A rollup holds a count and a sum per group of bookings. Both are sums of what
single bookings contribute, so a job that changes some bookings adds the
contributions of their new rows and subtracts those of their old rows
(``change``); nothing else is read. A group that comes to nothing is dropped.
The dashboards then read the rollups alone: a row per status and day, per
moderator and status, per payment type, payment status and payment day, and
per product and payment month, whatever the number of bookings.

Distinct orders of a product add up too: a booking counts once per product and
is paid in one month, so the orders of several months are the sum of theirs.
Unknown products are one line; their bookings are counted under no product.
"""

from __future__ import annotations

from typing import Optional, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import formats as FM
from .joins import product_dim, with_known_products
from .spread import Dealing, spread_join
from .stats import one_row

_AMOUNT = "decimal(28,2)"
GROUPS = {"status_days": ("status", "day"), "moderator_statuses": ("moderator_id", "status"),
          "payment_days": ("payment_type", "payment_status", "payment_date"),
          "product_months": ("product_id", "month")}
_MEASURES = {"n": "long", "quantity": "long", "amount": _AMOUNT}


def _summed(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy(*GROUPS[name]).agg(*[F.sum(m).cast(kind).alias(m) for m, kind in _MEASURES.items()])


def _counted(df: DataFrame, name: str) -> DataFrame:
    return _summed(df.select(*GROUPS[name], F.lit(1).alias("n"), F.lit(0).alias("quantity"), "amount"), name)


def product_months(bookings: DataFrame, payments: DataFrame, items: DataFrame, products: DataFrame,
                   dealt: Optional[Dealing] = None) -> DataFrame:
    """Pieces, revenue and orders of paid bookings per product (null: unknown) and month of payment.

    With ``dealt`` (``spread.dealing`` of the items by booking) items are dealt into partitions by their number."""
    paid = (payments.filter(F.col("payment_status") == "paid").select("booking_id", FM.month_key(F.col("payment_date")).alias("month"))
            .distinct().join(bookings.select(F.col("id").alias("booking_id")), "booking_id", "left_semi"))
    lines = items.select("booking_id", "product_id", "quantity", "unit_price")
    lines = lines.join(paid, "booking_id") if dealt is None else spread_join(lines, paid, "booking_id", "product_id", dealt=dealt)
    # A booking with several unknown products is one order of that line.
    orders = (with_known_products(lines, products).groupBy("booking_id", "product_id", "month")
              .agg(F.sum("quantity").alias("quantity"), F.sum(F.col("quantity") * F.col("unit_price")).alias("amount"))
              .withColumn("n", F.lit(1)))
    return _summed(orders, "product_months")


def rollups(bookings: DataFrame, payments: DataFrame, items: DataFrame, products: DataFrame,
            dealt: Optional[Dealing] = None) -> dict[str, DataFrame]:
    """All rollups of some bookings, their payment rows and their items, under a catalogue; ``dealt`` as in ``product_months``."""
    b = bookings.select("id", "status", F.to_date("updated_at").alias("day"), "moderator_id", "payment_type", "amount")
    paid = payments.select("booking_id", "payment_status", "payment_date")
    # A booking without a payment row counts under no payment status.
    j = b.join(paid, b["id"] == paid["booking_id"], "left")
    return {"status_days": _counted(b, "status_days"), "moderator_statuses": _counted(b, "moderator_statuses"),
            "payment_days": _counted(j, "payment_days"), "product_months": product_months(bookings, payments, items, products, dealt)}


def change(old: dict[str, DataFrame], new: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """What to add to the rollups when bookings with the rollups ``old`` become those of ``new``."""
    return {name: new[name].unionByName(old[name].withColumns({m: -F.col(m) for m in _MEASURES})) for name in GROUPS}


def added(stored: dict[str, DataFrame], *changes: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The rollups after some changes, in any order."""
    out = {}
    for name in GROUPS:
        rows = stored[name]
        for c in changes:
            rows = rows.unionByName(c[name])
        out[name] = _summed(rows, name).filter((F.col("n") != 0) | (F.col("amount") != 0) | (F.col("quantity") != 0))
    return out


# ---------------------------------------------------------------- dashboards

def _n(where: Column) -> Column:
    return F.coalesce(F.sum(F.when(where, F.col("n"))), F.lit(0))


def _sum(where: Column) -> Column:
    return F.coalesce(F.sum(F.when(where, F.col("amount"))), F.lit(0)).cast("double")


def _status(value: str) -> Column:
    return F.col("status") == value


def booking_stats(r: dict[str, DataFrame]) -> DataFrame:
    return r["status_days"].agg(_n(F.lit(True)).alias("total"), *[_n(_status(s)).alias(s) for s in ("pending", "approved", "delivered", "rejected")])


def booking_stats_full(r: dict[str, DataFrame]) -> DataFrame:
    return r["status_days"].agg(_n(F.lit(True)).alias("total_bookings"), *[
        _n(_status(s)).alias(s) for s in ("pending", "approved", "delivered", "not_delivered", "rejected")])


def delivery_stats(r: dict[str, DataFrame], as_of=D.DEFAULT_AS_OF) -> DataFrame:
    return r["status_days"].agg(
        _n(_status("approved")).alias("ready_for_delivery"),
        _n(_status("delivered") & D.same_day(F.col("day"), as_of)).alias("delivered_today"),
        _n(_status("delivered")).alias("total_delivered"), _n(_status("not_delivered")).alias("not_delivered"))


def dash_accountant(r: dict[str, DataFrame]) -> DataFrame:
    return r["status_days"].agg(
        _n(F.lit(True)).alias("total_bookings"), _n(_status("pending")).alias("pending_approval"),
        _n(_status("delivered")).alias("delivered_orders"), _sum(_status("delivered")).alias("total_revenue"))


def dash_moderator(r: dict[str, DataFrame], products: DataFrame, moderator_id: int = 1) -> DataFrame:
    """The catalogue's two figures come from the products; their number does not grow with the bookings."""
    p = products.select("stock_quantity").agg(F.count(F.lit(1)).alias("total_products"),
                                              F.count_if(F.col("stock_quantity") < 10).alias("low_stock"))
    b = r["moderator_statuses"].filter(F.col("moderator_id") == moderator_id).agg(
        _n(F.lit(True)).alias("my_bookings"), _n(_status("pending")).alias("pending_bookings"))
    return one_row(p, b)


def payment_stats(r: dict[str, DataFrame]) -> DataFrame:
    s = F.col("payment_status")
    return r["payment_days"].agg(
        _n(F.lit(True)).alias("total_payments"),
        *[_n(s == v).alias(f"{v}_payments") for v in ("pending", "paid", "failed")], _sum(s == "paid").alias("total_revenue"))


def revenue_overview(r: dict[str, DataFrame], as_of=D.DEFAULT_AS_OF, same_year: bool = False) -> DataFrame:
    d = F.col("payment_date")
    return r["payment_days"].filter(F.col("payment_status") == "paid").agg(
        _sum(F.lit(True)).alias("total_revenue"), _sum(D.same_day(d, as_of)).alias("today_revenue"),
        _sum(D.same_week_any_year(d, as_of, same_year)).alias("week_revenue"),
        _sum(D.same_month_any_year(d, as_of, same_year)).alias("month_revenue"))


def monthly_revenue(r: dict[str, DataFrame], as_of=D.DEFAULT_AS_OF, months: int = 6) -> DataFrame:
    d = F.col("payment_date")
    g = (r["payment_days"].filter((F.col("payment_status") == "paid") & (d >= D.months_back(as_of, months)))
         .groupBy(FM.month_key(d).alias("month"), FM.month_name(d).alias("month_name"))
         .agg(F.sum("amount").alias("revenue"), F.sum("n").alias("orders")))
    average = F.round(F.col("revenue") / F.when(F.col("orders") != 0, F.col("orders")).otherwise(1), 2)
    return g.select("month", "month_name", F.col("revenue").cast("double").alias("revenue"), "orders",
                    average.cast("double").alias("avg_order_value")).orderBy("month")


def payment_type_stats(r: dict[str, DataFrame]) -> DataFrame:
    g = (r["payment_days"].filter(F.col("payment_status") == "paid").groupBy("payment_type")
         .agg(F.sum("n").alias("count"), F.sum("amount").alias("revenue")))
    total = F.sum("revenue").over(Window.partitionBy())  # one row per payment type
    share = F.round(F.col("revenue").cast("double") * 100.0 / F.when(total != 0, total).otherwise(F.lit(1)).cast("double"), 1)
    return g.select("payment_type", "count", F.col("revenue").cast("double").alias("revenue"), share.alias("pct"), FM.pct_text(share).alias("pct_text"))


def top_products(r: dict[str, DataFrame], products: DataFrame, n: int = 10, months: Optional[Sequence[str]] = None) -> DataFrame:
    """Best sellers among paid bookings, of all time or of some payment months (``yyyy-MM``), without reading an item."""
    rows = r["product_months"]
    rows = rows if months is None else rows.filter(F.col("month").isin(*months))
    g = rows.groupBy("product_id").agg(F.sum("quantity").alias("total_quantity"), F.sum("amount").alias("__revenue"),
                                       F.sum("n").alias("order_count")).filter(F.col("order_count") > 0)
    names = product_dim(products, "name")
    top = g.orderBy(F.desc("__revenue"), F.asc("product_id")).limit(n).join(names, "product_id", "left")
    return top.orderBy(F.desc("__revenue"), F.asc("product_id")).select(
        "product_id", "name", "total_quantity", F.col("__revenue").cast("double").alias("total_revenue"), "order_count")
