"""Nested booking documents, chart series, CSV report rows, display texts,
text cleaning and shopping-cart arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import formats as FM
from ..functions import text as TX
from ..operators.joins import product_dim, with_user_names
from ..operators.spread import spread
from ..operators.stats import one_row
from ..sources.driver import Tables
from . import reports as R

JSON_OPTIONS = {"ignoreNullFields": "false", "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss",
                "timestampFormat": "yyyy-MM-dd HH:mm:ss"}


def _money_text(c):
    """DECIMAL as its exact text, as the database driver hands it to PHP."""
    return c.cast("string")


def booking_document(t: Tables) -> DataFrame:
    """``id, document``: the drill-down JSON of every booking — header with
    staff names and payment status, ``items`` (id order) and
    ``delivery_details`` (``null`` when there is none).

    Items are nested per booking with one grouped aggregate and joined once;
    the sort inside the array is per booking.
    """
    b = t.bookings
    b = with_user_names(b, t.users, {"moderator_id": "moderator_name", "accountant_id": "accountant_name",
                                     "storeman_id": "storeman_name"})
    pay = t.payments.select(F.col("booking_id").alias("pay_booking_id"), "payment_status")
    b = b.join(pay, b["id"] == pay["pay_booking_id"], "left").drop("pay_booking_id")

    li = t.booking_items.join(product_dim(t.products, F.col("name").alias("product_name")),
                              "product_id", "left")
    item = F.struct("id", "product_id", "quantity", "booking_id",
                    _money_text(F.col("unit_price")).alias("unit_price"), "product_name")
    items = li.groupBy("booking_id").agg(F.sort_array(F.collect_list(item)).alias("items"))
    b = b.join(items, b["id"] == items["booking_id"], "left").drop("booking_id")

    dd = t.delivery_details
    dd = dd.select(F.col("booking_id").alias("dd_booking_id"),
                   F.struct(*[F.col(c) for c in dd.columns]).alias("delivery_details"))
    b = b.join(dd, b["id"] == dd["dd_booking_id"], "left").drop("dd_booking_id")

    doc = F.struct(
        "id", "customer_name", "customer_phone", "customer_address", "payment_type",
        _money_text(F.col("amount")).alias("amount"), "status", "moderator_id", "accountant_id",
        "storeman_id", "created_at", "updated_at", "moderator_name", "accountant_name",
        "storeman_name", "payment_status",
        F.coalesce(F.col("items"), F.array()).alias("items"), "delivery_details")
    return b.select("id", F.to_json(doc, JSON_OPTIONS).alias("document"))


def chart_points(t: Tables, as_of=D.DEFAULT_AS_OF) -> DataFrame:
    """Chart data of the reports page, one row per point:
    ``series ('revenue'|'status'), position, label, value`` — month labels
    and paid revenue in month order, status labels and counts (non-zero
    statuses) in the page's order."""
    m = R.monthly_revenue(t, as_of)
    # One row per month with revenue (bounded by the calendar), so this
    # window sees a handful of rows.
    rev = m.select(F.lit("revenue").alias("series"),
                   F.row_number().over(Window.orderBy("month")).alias("position"),
                   F.col("month_name").alias("label"), F.col("revenue").cast("double").alias("value"))
    st = R.status_distribution(t).select(F.lit("status").alias("series"), "position",
                                         F.col("status_label").alias("label"),
                                         F.col("n").cast("double").alias("value"))
    return rev.unionByName(st)


def chart_series(t: Tables, as_of=D.DEFAULT_AS_OF) -> DataFrame:
    """The same points as the page's parallel arrays, in one row:
    ``revenue_labels, revenue_data, status_labels, status_data``."""
    m = R.monthly_revenue(t, as_of)
    m = m.agg(F.sort_array(F.collect_list(F.struct("month", "month_name", "revenue"))).alias("s"))
    m = m.select(F.transform("s", lambda x: x["month_name"]).alias("revenue_labels"),
                 F.transform("s", lambda x: x["revenue"]).alias("revenue_data"))
    s = R.status_distribution(t)
    s = s.agg(F.sort_array(F.collect_list(F.struct("position", "status_label", "n"))).alias("s"))
    s = s.select(F.transform("s", lambda x: x["status_label"]).alias("status_labels"),
                 F.transform("s", lambda x: x["n"]).alias("status_data"))
    return one_row(m, s)


def chart_json(t: Tables, as_of=D.DEFAULT_AS_OF) -> DataFrame:
    """``chart_series`` as the page embeds it: each array as JSON text, money with its cents."""
    numbers = F.transform("revenue_data", lambda x: x.cast("decimal(20,2)").cast("string"))
    counts = F.transform("status_data", lambda x: x.cast("string"))
    return chart_series(t, as_of).select(
        F.to_json("revenue_labels").alias("revenue_labels"), F.concat(F.lit("["), F.array_join(numbers, ","), F.lit("]")).alias("revenue_data"),
        F.to_json("status_labels").alias("status_labels"), F.concat(F.lit("["), F.array_join(counts, ","), F.lit("]")).alias("status_data"))


def money_out(df: DataFrame) -> DataFrame:
    """DECIMAL ``amount`` as DOUBLE at the output edge."""
    return df.withColumn("amount", F.col("amount").cast("double"))


def monthly_csv_rows(t: Tables, as_of=D.DEFAULT_AS_OF) -> DataFrame:
    """Rows of the monthly CSV export: ``Month,Orders,Revenue,Avg Order Value``
    (revenue as exact text, average unrounded)."""
    j = (R.paid_bookings(t, "amount")
         .filter(F.col("payment_date") >= D.months_back(as_of)))
    g = j.groupBy(FM.month_key(F.col("payment_date")).alias("month_key"),
                  FM.month_name(F.col("payment_date")).alias("Month")).agg(
        F.count("id").alias("Orders"), F.sum("amount").alias("rev"))
    avg = F.col("rev").cast("double") / F.when(F.col("Orders") != 0, F.col("Orders")).otherwise(1)
    return g.orderBy("month_key").select("Month", "Orders", F.col("rev").cast("string").alias("Revenue"),
                                     avg.alias("Avg Order Value"))


def display_formats(t: Tables) -> DataFrame:
    """The page texts of every booking: money, dates, status labels, grouped id."""
    b = t.bookings
    return b.select(
        "id", FM.int_text(F.col("id")).alias("id_text"),
        FM.currency(F.col("amount")).alias("amount_text"),
        FM.date_text(F.col("created_at")).alias("created_date_text"),
        FM.datetime_text(F.col("updated_at")).alias("updated_text"),
        FM.status_label(F.col("status")).alias("status_label"),
        FM.status_badge(F.col("status")).alias("status_badge"),
        FM.payment_badge(F.col("payment_type")).alias("payment_badge"))


def payment_weeks(t: Tables) -> DataFrame:
    """Week of year (MySQL mode 0) and month of every payment date."""
    p = t.payments
    return p.select("booking_id", "payment_date",
                    D.week_mode0(F.col("payment_date")).alias("week"),
                    F.month("payment_date").alias("month"))


def clean_documents(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Form-input cleaning (trim, strip tags, HTML-escape) over whole texts."""
    return df.select(id_col, TX.clean_text(F.col(text_col)).alias("clean_text"))


def phone_numbers(t: Tables) -> DataFrame:
    """What a phone text of a booking gives as a whole number, as a request id is read (its leading digits, else 0)."""
    return t.bookings.select("id", "customer_phone", TX.to_int(F.col("customer_phone")).alias("leading_number"),
                             TX.to_int(F.regexp_replace("customer_phone", "[^0-9]", "")).alias("digits"))


def leading_numbers(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Whole texts read as a request id."""
    return df.select(id_col, TX.to_int(F.col(text_col)).alias("number"))


# ---------------------------------------------------------------- carts

# Picks of one product in one cart that a task takes in a row.
PICK_RANGE = 1 << 16


def merged_cart_lines(cart_lines: DataFrame, pick_range: int = PICK_RANGE) -> DataFrame:
    """Repeat picks of a product in one cart merged into one line, in pick
    order. A line is removed the moment its quantity is not above zero, so
    later picks start afresh: the end is the running sum less its lowest
    point below zero.

    A stretch of picks counts by its sum and its lowest running sum, and two
    stretches in a row make one: the sums add up, the lowest point is the
    first's or the first's sum and the second's. So the picks are summed up in
    ranges of ``pick_no``, spread over tasks, and a window sees one row per
    range: a cart with millions of picks of one product is no hot task. Lines
    hardly repeat, so both shuffles get partitions by the number of picks."""
    return _merged(cart_lines, pick_range, cart_lines.count())


def _merged(cart_lines: DataFrame, pick_range: int, rows: int) -> DataFrame:
    line = ("cart_id", "product_id")
    ranged = spread(cart_lines.withColumn("__range", F.floor(F.col("pick_no") / F.lit(pick_range))),
                    *line, "__range", rows=rows)
    in_range = (Window.partitionBy(*line, "__range").orderBy("pick_no", F.desc("quantity"))
                .rowsBetween(Window.unboundedPreceding, 0))
    stretches = (ranged.withColumn("__run", F.sum("quantity").over(in_range)).groupBy(*line, "__range")
                 .agg(F.sum("quantity").alias("__sum"), F.min("__run").alias("__low")))
    before = Window.partitionBy(*line).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    low = F.coalesce(F.sum("__sum").over(before), F.lit(0)) + F.col("__low")
    g = spread(stretches, *line, rows=rows).withColumn("__lowest", low).groupBy(*line).agg(
        (F.sum("__sum") - F.least(F.min("__lowest"), F.lit(0))).alias("quantity"))
    return g.filter(F.col("quantity") > 0)


def cart_totals(t: Tables) -> DataFrame:
    """Per cart: merged lines, lines with a known price, and the total of
    price x quantity over those (lines without a product are skipped)."""
    rows = t.cart_lines.count()
    m = _merged(t.cart_lines, PICK_RANGE, rows)
    j = m.join(product_dim(t.products, "price"), "product_id", "left")
    return spread(j, "cart_id", rows=rows).groupBy("cart_id").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count("price").alias("n_priced"),
        F.coalesce(F.sum(F.col("price") * F.col("quantity")), F.lit(0)).cast("double").alias("total"))
