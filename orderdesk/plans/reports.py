"""The accountant's reports, payments and bookings stats strips, dashboards.

Money stays DECIMAL inside every plan and is cast to DOUBLE only in the output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import formats as FM
from ..operators.joins import product_dim, with_known_products
from ..operators.spread import spread_join
from ..operators.stats import count_where, one_row, status_counts, sum_where
from ..sources.driver import Tables


def _money(c):
    return c.cast("double")


PAID_COLS = ("amount", "customer_name", "payment_type", "created_at")


def paid_bookings(t: Tables, *cols: str, since=None) -> DataFrame:
    """Bookings joined to their paid payment row, with ``since`` only those paid on that date or later.

    The reference writes ``LEFT JOIN payments ... WHERE payment_status='paid'``;
    the filter rejects NULLs, so this is an inner join with the status filter
    pushed into the payments scan.
    """
    pay = t.payments.filter(F.col("payment_status") == "paid")
    if since is not None:
        pay = pay.filter(F.col("payment_date") >= since)
        if "payment_month" in pay.columns:  # stored by month: no other month is listed
            pay = pay.filter(F.col("payment_month") >= FM.month_key(since))
    pay = pay.select("booking_id", "payment_status", "payment_date")
    core = set(cols) <= set(t.booking_core.columns)
    b = (t.booking_core if core else t.bookings).select("id", *cols)
    return b.join(pay, b["id"] == pay["booking_id"], "inner").drop("booking_id")


def _paid(t: Tables, paid: DataFrame | None, *cols: str) -> DataFrame:
    """The paid-bookings join, or the shared precomputed one (``PAID_COLS``)."""
    return paid_bookings(t, *cols) if paid is None else paid


def revenue_overview(t: Tables, as_of=D.DEFAULT_AS_OF, same_year: bool = False,
                     paid: DataFrame | None = None) -> DataFrame:
    """Total, today, this-week and this-month paid revenue.

    Week and month ignore the year unless ``same_year`` (the reference's
    ``WEEK(d) = WEEK(CURDATE())`` matches that week of every year). A paid
    payment without a date counts in the total only.
    """
    j = _paid(t, paid, "amount")
    d, amt, true = F.col("payment_date"), F.col("amount"), F.lit(True)
    out = j.agg(
        sum_where(true, amt).alias("total_revenue"),
        sum_where(D.same_day(d, as_of), amt).alias("today_revenue"),
        sum_where(D.same_week_any_year(d, as_of, same_year), amt).alias("week_revenue"),
        sum_where(D.same_month_any_year(d, as_of, same_year), amt).alias("month_revenue"))
    return out.select(*[_money(F.col(c)).alias(c) for c in out.columns])


def booking_stats(t: Tables) -> DataFrame:
    """Stats strip of the bookings page: total and four status counts."""
    return status_counts(t.booking_core, "status", {
        "pending": "pending", "approved": "approved", "delivered": "delivered",
        "rejected": "rejected"}, total="total")


def booking_stats_full(t: Tables) -> DataFrame:
    """Status counts of the reports page, including ``not_delivered``."""
    return status_counts(t.booking_core, "status", {
        "pending": "pending", "approved": "approved", "delivered": "delivered",
        "not_delivered": "not_delivered", "rejected": "rejected"}, total="total_bookings")


def delivery_stats(t: Tables, as_of=D.DEFAULT_AS_OF) -> DataFrame:
    """Storeman figures: ready, delivered today (by ``updated_at``), delivered, not delivered."""
    s = F.col("status")
    return t.booking_core.select("status", "updated_at").agg(
        count_where(s == "approved").alias("ready_for_delivery"),
        count_where((s == "delivered") & D.same_day(F.col("updated_at"), as_of)).alias("delivered_today"),
        count_where(s == "delivered").alias("total_delivered"),
        count_where(s == "not_delivered").alias("not_delivered"))


def payment_stats(t: Tables) -> DataFrame:
    """Payment strip: every booking counts in ``total_payments`` (left join), a
    booking without a payment row lands in no status bucket."""
    pay = t.payments.select("booking_id", "payment_status")
    b = t.booking_core.select("id", "amount")
    j = b.join(pay, b["id"] == pay["booking_id"], "left")
    s = F.col("payment_status")
    return j.agg(
        F.count(F.lit(1)).alias("total_payments"),
        count_where(s == "pending").alias("pending_payments"),
        count_where(s == "paid").alias("paid_payments"),
        count_where(s == "failed").alias("failed_payments"),
        _money(sum_where(s == "paid", F.col("amount"))).alias("total_revenue"))


def monthly_revenue(t: Tables, as_of=D.DEFAULT_AS_OF, months: int = 6,
                    paid: DataFrame | None = None) -> DataFrame:
    """Paid revenue per payment month since ``as_of - months`` (lower bound
    only, so future-dated payments count), with orders and average value."""
    since = D.months_back(as_of, months)
    j = paid_bookings(t, "amount", since=since) if paid is None else paid.filter(F.col("payment_date") >= since)
    g = j.groupBy(FM.month_key(F.col("payment_date")).alias("month"),
                  FM.month_name(F.col("payment_date")).alias("month_name")).agg(
        F.sum("amount").alias("revenue"), F.count("id").alias("orders"))
    aov = F.round(F.col("revenue") / F.when(F.col("orders") != 0, F.col("orders")).otherwise(1), 2)
    return g.select("month", "month_name", _money(F.col("revenue")).alias("revenue"),
                    "orders", _money(aov).alias("avg_order_value")).orderBy("month")


def top_products(t: Tables, n: int = 10, ranked: bool = False, paid: DataFrame | None = None) -> DataFrame:
    """Best sellers among paid bookings: quantity, revenue, distinct orders.

    The items of paid, existing bookings are kept by a semi join, dealt by
    booking into partitions by the number of items (a hot booking is split by
    product). Lines whose product is unknown form one line of their own, so
    they lose their product before items are summed per (booking, product).
    A booking then has one row per product, and these are summed per product,
    map-side first, with orders counted plainly. Names are joined to the totals.
    """
    if paid is None:
        paid_ids = (t.payments.filter(F.col("payment_status") == "paid").select("booking_id")
                    .join(t.booking_core.select(F.col("id").alias("booking_id")), "booking_id", "left_semi"))
    else:
        paid_ids = paid.select(F.col("id").alias("booking_id")).distinct()
    lines = spread_join(t.booking_items.select("booking_id", "product_id", "quantity", "unit_price"), paid_ids,
                        "booking_id", "product_id", "left_semi")
    per_order = (with_known_products(lines, t.products).groupBy("booking_id", "product_id")
                 .agg(F.sum("quantity").alias("q"), F.sum(F.col("quantity") * F.col("unit_price")).alias("r")))
    g = (per_order.groupBy("product_id")
         .agg(F.sum("q").alias("total_quantity"), F.sum("r").alias("total_revenue"), F.count(F.lit(1)).alias("order_count"))
         .join(product_dim(t.products, "name"), "product_id", "left").withColumnRenamed("product_id", "pid"))
    top = g.orderBy(F.desc("total_revenue"), F.asc("pid")).limit(n)
    out = top.select(F.col("pid").alias("product_id"), "name", "total_quantity",
                     _money(F.col("total_revenue")).alias("total_revenue"), "order_count")
    if ranked:
        # At most n rows reach this window.
        w = Window.orderBy(F.desc("total_revenue"), F.asc("product_id"))
        out = out.withColumn("rank", F.row_number().over(w))
    return out


def recent_transactions(t: Tables, n: int = 10, paid: DataFrame | None = None) -> DataFrame:
    """Latest paid bookings by payment date (NULL dates last), newest first."""
    j = _paid(t, paid, "customer_name", "amount", "payment_type", "created_at")
    top = j.orderBy(F.col("payment_date").desc_nulls_last(), F.asc("id")).limit(n)
    return top.select("id", "customer_name", _money(F.col("amount")).alias("amount"),
                      "payment_type", "payment_status", "payment_date", "created_at")


def payment_type_stats(t: Tables, paid: DataFrame | None = None) -> DataFrame:
    """Paid bookings and revenue per payment type, with the share of all paid
    revenue in percent (one decimal; a zero total divides by 1)."""
    g = _paid(t, paid, "payment_type", "amount").groupBy("payment_type").agg(
        F.count(F.lit(1)).alias("count"), F.sum("amount").alias("revenue"))
    # One row per payment type (an enum), so this window sees a handful of rows.
    total = F.sum("revenue").over(Window.partitionBy())
    denom = F.when(total != 0, total).otherwise(F.lit(1))
    pct = F.round(F.col("revenue").cast("double") * 100.0 / denom.cast("double"), 1)
    return g.select("payment_type", "count", _money(F.col("revenue")).alias("revenue"),
                    pct.alias("pct"), FM.pct_text(pct).alias("pct_text"))


def status_distribution(t: Tables) -> DataFrame:
    """Chart data of the reports page: (label, n) for each non-zero status."""
    wide = booking_stats_full(t).drop("total_bookings")
    order = ["pending", "approved", "delivered", "not_delivered", "rejected"]
    long = wide.unpivot([], order, "status", "n").filter(F.col("n") > 0)
    pos = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("status"))
    return long.select(FM.status_label(F.col("status")).alias("status_label"), "n",
                       pos.cast("int").alias("position"))


def dash_moderator(t: Tables, moderator_id: int = 1) -> DataFrame:
    """Moderator dashboard: catalogue size, low stock (< 10), own and own pending bookings."""
    p = t.products.select("stock_quantity").agg(
        F.count(F.lit(1)).alias("total_products"),
        count_where(F.col("stock_quantity") < 10).alias("low_stock"))
    b = (t.bookings.filter(F.col("moderator_id") == moderator_id).select("status").agg(
        F.count(F.lit(1)).alias("my_bookings"),
        count_where(F.col("status") == "pending").alias("pending_bookings")))
    return one_row(p, b)


def dash_accountant(t: Tables) -> DataFrame:
    """Accountant dashboard: bookings, pending, delivered and delivered revenue."""
    s = F.col("status")
    return t.booking_core.select("status", "amount").agg(
        F.count(F.lit(1)).alias("total_bookings"),
        count_where(s == "pending").alias("pending_approval"),
        count_where(s == "delivered").alias("delivered_orders"),
        _money(sum_where(s == "delivered", F.col("amount"))).alias("total_revenue"))


def dash_storeman(t: Tables, as_of=D.DEFAULT_AS_OF) -> DataFrame:
    """Storeman dashboard figures (same as the deliveries page strip)."""
    return delivery_stats(t, as_of)
