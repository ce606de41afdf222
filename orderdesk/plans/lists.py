"""List pages, searches and catalogue reads.

Every list is "bookings + per-booking aggregate + small dimensions": items are
aggregated per booking before the join (never a fan-out of the wide booking
rows), user names come from a size-checked broadcast, and filters on booking
columns sit under the joins where Catalyst pushes them into the scan. When a
filter or top-k narrows the bookings, items are semi-joined to the survivors
before aggregation.
"""

from __future__ import annotations

from typing import Optional

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import formats as FM
from ..functions import text as TX
from ..operators import search as SEARCH
from ..operators.items import with_item_labels
from ..operators.joins import with_user_names
from ..sources.driver import Tables

BOOKING_COLS = ("id", "customer_name", "customer_phone", "customer_address", "payment_type",
                "amount", "status", "moderator_id", "accountant_id", "storeman_id",
                "created_at", "updated_at")
PRODUCT_COLS = ("id", "name", "description", "category", "price", "stock_quantity", "sku",
                "created_at", "updated_at")

# The low-stock threshold of the dashboard and product badges.
LOW_STOCK_BELOW = 10


def _out(df: DataFrame, money=("amount", "price")) -> DataFrame:
    """Cast DECIMAL money columns to DOUBLE at the output edge."""
    return df.select(*[F.col(c).cast("double").alias(c) if c in money else F.col(c) for c in df.columns])


def booking_search_pred(search: Optional[str]) -> list[Column]:
    """``b.id LIKE %s% OR customer_name LIKE ... OR customer_phone LIKE ...``."""
    search = TX.clean_param(search)
    if not TX.is_set(search):
        return []
    return [TX.any_contains([F.col("id"), F.col("customer_name"), F.col("customer_phone")], search)]


# ---------------------------------------------------------------- products

def scan_products(t: Tables) -> DataFrame:
    """Catalogue sorted by name (id breaks ties), with the low-stock flag."""
    p = t.products.select(*PRODUCT_COLS,
                          (F.col("stock_quantity") < LOW_STOCK_BELOW).alias("low_stock"))
    return _out(p.orderBy("name", "id"))


def orderable_products(t: Tables) -> DataFrame:
    """Products offered on the booking form: in stock, by name."""
    p = t.products.filter(F.col("stock_quantity") > 0).select(*PRODUCT_COLS)
    return _out(p.orderBy("name", "id"))


def low_stock_products(t: Tables) -> DataFrame:
    """Products below the low-stock threshold."""
    p = t.products.filter(F.col("stock_quantity") < LOW_STOCK_BELOW).select(*PRODUCT_COLS)
    return _out(p.orderBy("stock_quantity", "id"))


def product_categories(t: Tables) -> DataFrame:
    """Distinct non-NULL categories, sorted."""
    return (t.products.filter(F.col("category").isNotNull()).select("category")
            .distinct().orderBy("category"))


def product_search(t: Tables, search: Optional[str] = None, category: Optional[str] = None) -> DataFrame:
    """Products page: text search over name, description and sku (wildcards
    kept), optional category equality; '' and '0' mean no filter."""
    search, category = TX.clean_param(search), TX.clean_param(category)
    preds = []
    if TX.is_set(search):
        preds.append(TX.any_contains([F.col("name"), F.col("description"), F.col("sku")], search))
    if TX.is_set(category):
        preds.append(F.col("category") == category)
    return _out(t.products.filter(TX.all_of(preds)).select(*PRODUCT_COLS).orderBy("name", "id"))


# ---------------------------------------------------------------- users and simple booking reads

def user_lookup(t: Tables, username: Optional[str] = None) -> DataFrame:
    """Login lookup columns (the password hash is not carried), of all users or of a login name; which names are
    equal follows the column's collation."""
    users = t.users if username is None else t.users.filter(F.col("username") == username)
    return users.select("id", "username", "role", "full_name")


def category_spellings(t: Tables) -> DataFrame:
    """``product_categories`` of tables under a collation: per category its first spelling by bytes and how many
    products and spellings it has."""
    plain = F.collate(F.col("category"), "UTF8_BINARY")
    return (t.products.filter(F.col("category").isNotNull()).groupBy("category")
            .agg(F.min(plain).alias("first_spelling"), F.countDistinct(plain).alias("n_spellings"), F.count(F.lit(1)).alias("n_products"))
            .select("first_spelling", "n_spellings", "n_products").orderBy("first_spelling"))


def bookings_by_moderator(t: Tables, moderator_id: int = 1) -> DataFrame:
    """Bookings created by one moderator."""
    return _out(t.bookings.filter(F.col("moderator_id") == moderator_id).select(*BOOKING_COLS))


def delivered_today(t: Tables, as_of=D.DEFAULT_AS_OF) -> DataFrame:
    """Bookings delivered on ``as_of`` (by their last update)."""
    b = t.bookings.filter((F.col("status") == "delivered") & D.same_day(F.col("updated_at"), as_of))
    if "updated_month" in b.columns:  # stored by month: no other month is listed
        b = b.filter(F.col("updated_month") == FM.month_key(D.as_of_date(as_of)))
    return _out(b.select(*BOOKING_COLS))


# ---------------------------------------------------------------- dashboard top-5 lists

def _newest(b: DataFrame, n: int) -> DataFrame:
    return b.orderBy(F.desc("created_at"), F.desc("id")).limit(n)


def recent_bookings(t: Tables, moderator_id: int = 1, n: int = 5) -> DataFrame:
    """A moderator's newest bookings with their product names."""
    top = _newest(t.bookings.filter(F.col("moderator_id") == moderator_id).select(*BOOKING_COLS), n)
    out = with_item_labels(top, t.booking_items, t.products, with_quantity=False, restrict=top, bound=n,
                           stored=t.booking_labels)
    return _out(out.orderBy(F.desc("created_at"), F.desc("id")))


def _status_top(t: Tables, status: str, n: int) -> DataFrame:
    top = _newest(t.bookings.filter(F.col("status") == status).select(*BOOKING_COLS), n)
    out = with_user_names(top, t.users, {"moderator_id": "moderator_name"})
    out = with_item_labels(out, t.booking_items, t.products, with_quantity=False, restrict=top, bound=n,
                           stored=t.booking_labels)
    return _out(out.orderBy(F.desc("created_at"), F.desc("id")))


def pending_approvals(t: Tables, n: int = 5) -> DataFrame:
    """Accountant dashboard: newest pending bookings."""
    return _status_top(t, "pending", n)


def ready_orders(t: Tables, n: int = 5) -> DataFrame:
    """Storeman dashboard: newest approved bookings."""
    return _status_top(t, "approved", n)


# ---------------------------------------------------------------- full lists

def search_texts() -> dict[str, Column]:
    """The texts that the search box of the list pages looks at."""
    return {c: F.col(c).cast("string") for c in ("id", "customer_name", "customer_phone")}


def booking_list(t: Tables, search: Optional[str] = None, status: Optional[str] = None,
                 ids: Optional[DataFrame] = None) -> DataFrame:
    """Bookings page: every matching booking with three staff names, its
    items as ``name (qty)`` text, payment status and the sort bucket
    (pending first, then newest). ``ids`` (an ``id`` column, once each) names
    the only bookings to look at, such as candidates of an index."""
    preds = booking_search_pred(search)
    status = TX.clean_param(status)
    if TX.is_set(status):
        preds.append(F.col("status") == status)
    found = t.bookings.select(*BOOKING_COLS).filter(TX.all_of(preds))
    if ids is not None:
        found = found.join(ids, "id", "left_semi")
    narrowed = bool(preds) or ids is not None
    b = with_user_names(found, t.users, {"moderator_id": "moderator_name", "accountant_id": "accountant_name",
                                         "storeman_id": "storeman_name"})
    b = with_item_labels(b, t.booking_items, t.products, restrict=found if narrowed else None, stored=t.booking_labels)
    pay = t.payments.select(F.col("booking_id").alias("pay_booking_id"), "payment_status")
    b = b.join(pay, b["id"] == pay["pay_booking_id"], "left").drop("pay_booking_id")
    b = b.withColumn("sort_bucket", F.when(F.col("status") == "pending", 1).otherwise(2))
    return _out(b.orderBy("sort_bucket", F.desc("created_at"), F.asc("id")))


def delivery_list(t: Tables, search: Optional[str] = None, status: Optional[str] = "approved") -> DataFrame:
    """Deliveries page: approved/delivered/not-delivered bookings (default:
    approved only; '' lists all three) with delivery details."""
    preds = booking_search_pred(search)
    status = TX.clean_param(status)
    if TX.is_set(status):
        preds.append(F.col("status") == status)
    preds.append(F.col("status").isin("approved", "delivered", "not_delivered"))
    found = t.bookings.select(*BOOKING_COLS).filter(TX.all_of(preds))
    b = with_user_names(found, t.users, {"moderator_id": "moderator_name", "accountant_id": "accountant_name"})
    b = with_item_labels(b, t.booking_items, t.products, restrict=found, stored=t.booking_labels)
    dd = t.delivery_details.select(F.col("booking_id").alias("dd_booking_id"), "delivery_company",
                                   "tracking_number", "delivery_date",
                                   F.col("notes").alias("delivery_notes"))
    b = b.join(dd, b["id"] == dd["dd_booking_id"], "left").drop("dd_booking_id")
    b = b.withColumn("sort_bucket", F.when(F.col("status") == "approved", 1).otherwise(2))
    return _out(b.orderBy("sort_bucket", F.desc("updated_at"), F.asc("id")))


def payment_list(t: Tables, search: Optional[str] = None, payment_status: Optional[str] = None,
                 booking_status: Optional[str] = None) -> DataFrame:
    """Payments page: bookings with their payment row, moderator name and items;
    pending payments first."""
    preds = booking_search_pred(search)
    payment_status, booking_status = TX.clean_param(payment_status), TX.clean_param(booking_status)
    if TX.is_set(booking_status):
        preds.append(F.col("status") == booking_status)
    b = t.bookings.select(*BOOKING_COLS).filter(TX.all_of(preds))
    pay = t.payments.select(F.col("booking_id").alias("pay_booking_id"), "payment_status",
                            "payment_method", "transaction_id", "payment_date",
                            F.col("notes").alias("payment_notes"))
    b = b.join(pay, b["id"] == pay["pay_booking_id"], "left").drop("pay_booking_id")
    if TX.is_set(payment_status):
        b = b.filter(F.col("payment_status") == payment_status)
    narrowed = bool(preds) or TX.is_set(payment_status)
    found, b = b, with_user_names(b, t.users, {"moderator_id": "moderator_name"})
    b = with_item_labels(b, t.booking_items, t.products, restrict=found if narrowed else None, stored=t.booking_labels)
    b = b.withColumn("sort_bucket", F.when(F.col("payment_status") == "pending", 1).otherwise(2))
    return _out(b.orderBy("sort_bucket", F.desc("created_at"), F.asc("id")))


def row_cells() -> list[Column]:
    """The cells of a row of the bookings table, as shown."""
    return [F.concat(F.lit("#"), F.col("id").cast("string")),
             F.concat(F.lit("by "), F.col("moderator_name")),
             F.col("customer_name"), F.col("customer_phone"), F.col("products"),
             FM.currency(F.col("amount").cast("decimal(12,2)")), F.col("payment_type"),
             FM.status_label(F.col("status")), FM.datetime_text(F.col("created_at")),
             F.concat(F.lit("View"), F.when(F.col("status") == "pending", " Approve Reject").otherwise(""))]


def row_text_search(t: Tables, query: str, search: Optional[str] = None,
                    status: Optional[str] = None, ids: Optional[DataFrame] = None) -> DataFrame:
    """Live filter of the bookings table: keep rows whose shown text contains
    ``query`` case-insensitively (``%`` and ``_`` are literal here); ``ids`` as
    in ``booking_list``."""
    return booking_list(t, search, status, ids).filter(TX.row_contains(row_cells(), query))


def indexed_booking_list(t: Tables, index: DataFrame, search: str, status: Optional[str] = None) -> DataFrame:
    """``booking_list`` with its search answered through an index of ``search_texts`` (``operators.search``)."""
    pattern = TX.clean_param(search)
    ids = SEARCH.found(index.sparkSession, index, pattern) if TX.is_set(pattern) else None
    return booking_list(t, search, status, ids)


def indexed_row_search(t: Tables, index: DataFrame, query: str, search: Optional[str] = None,
                       status: Optional[str] = None) -> DataFrame:
    """``row_text_search`` answered through an index of the rows' shown texts."""
    return row_text_search(t, query, search, status, SEARCH.found(index.sparkSession, index, query, wildcards=False))


def booking_index(t: Tables, search: Optional[str] = None) -> DataFrame:
    """Index of the texts behind the search box; with ``search`` only the lists that it asks for."""
    if search is None:
        return SEARCH.postings(t.bookings, "id", search_texts())
    return SEARCH.lists(t.bookings, "id", search_texts(), SEARCH.asked(t.bookings.sparkSession, TX.clean_param(search)))


def row_index(t: Tables, query: Optional[str] = None) -> DataFrame:
    """Index of the whole shown rows of the bookings table; with ``query`` only the lists that it asks for."""
    rows, text = booking_list(t), {"row": F.concat_ws(" ", *[c.cast("string") for c in row_cells()])}
    if query is None:
        return SEARCH.postings(rows, "id", text)
    return SEARCH.lists(rows, "id", text, SEARCH.asked(rows.sparkSession, query, wildcards=False))


def booking_details(t: Tables, ids: Optional[DataFrame] = None) -> DataFrame:
    """Drill-down header: booking, three staff names and payment status, for
    the bookings in ``ids`` (one ``id`` column) or for all."""
    b = t.bookings.select(*BOOKING_COLS)
    if ids is not None:
        b = b.join(ids.select("id"), "id", "left_semi")
    b = with_user_names(b, t.users, {"moderator_id": "moderator_name", "accountant_id": "accountant_name",
                                     "storeman_id": "storeman_name"})
    pay = t.payments.select(F.col("booking_id").alias("pay_booking_id"), "payment_status")
    b = b.join(pay, b["id"] == pay["pay_booking_id"], "left").drop("pay_booking_id")
    return _out(b)
