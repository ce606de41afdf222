"""Bulk forms of the reference's write requests.

The web app applies one form post at a time as a guarded ``UPDATE``. Here a
whole table of posts (commands) is folded into the tables at once:

* reviews: ``pending → approved | rejected``; the earliest review of a booking
  that is pending wins, later ones find it "already processed";
* deliveries: ``approved → delivered | not_delivered``; the earliest delivery
  command after the winning approval (or any, if the booking was approved to
  begin with) wins; the effective one also upserts the delivery details;
* payment updates: no state guard, so the last valid post per booking wins;
* booking requests: priced and stock-checked line by line, all or nothing.

The state machine has depth two, so two grouped passes replace a sequential
fold. Every "first/last per booking" is a ``min``/``max`` over a struct whose
leading fields are the order key: a partial aggregate, so one hot booking with
a third of all commands is pre-combined in every task instead of being sorted
in one window partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as TX
from ..sources import schemas as S
from .joins import product_dim
from .skew import hot_keys, salted_join

REVIEW_ACTIONS = ("approve", "reject")
DELIVERY_ACTIONS = ("delivered", "not_delivered")

# The reference's user-facing messages.
MSG_REVIEW_NOOP = "Booking not found or already processed."
MSG_DELIVERY_NOOP = "Booking not found or not ready for delivery."
MSG_BAD_DELIVERY_STATUS = "Please select a valid delivery status."
# Our wording: the database refuses delivery details that do not fit their
# columns (a non-date, an over-long text), the transaction rolls back and the
# page shows the driver's error text, which is not reproduced.
MSG_DB_DELIVERY = "Database refused the delivery details."
MSG_BAD_PAYMENT_STATUS = "Please select a valid payment status."
MSG_NO_PAYMENT = "Payment record not found."
MSG_PAYMENT_FAILED = "Failed to update payment status."
MSG_MISSING_CUSTOMER = "Please fill in all required customer details."
MSG_NO_ITEMS = "Please select at least one product."
MSG_INVALID_PRODUCT = "Invalid product selected."
MSG_NO_VALID_ITEMS = "No valid items in the booking."
# Our wording for a booking row the database refuses (the page shows the
# driver's error text, which is not reproduced).
MSG_DB_NAME = "Database refused the booking: customer_name longer than 100 characters."
MSG_DB_PHONE = "Database refused the booking: customer_phone longer than 20 characters."
MSG_DB_PAYMENT_TYPE = "Database refused the booking: payment_type is not an allowed value."
MSG_DB_AMOUNT = "Database refused the booking: amount out of range."
MAX_AMOUNT = 99999999.99


def _first(*fields: str) -> Column:
    """Earliest row of a group by (ts, cmd_id), carrying ``fields``."""
    return F.min(F.struct("ts", "cmd_id", *fields))


def _last(*fields: str) -> Column:
    return F.max(F.struct("ts", "cmd_id", *fields))


def _blank_to_null(c: Column) -> Column:
    """``$value ?: null``: '' and '0' become NULL."""
    return F.when(~TX.is_blank(c), c)


def _form_date(c: Column) -> Column:
    return _blank_to_null(TX.clean_text(c)).try_cast("date")


def _unchanged_by_cleaning(c: Column) -> Column:
    """Digits and dashes only: cleaning (trim, tags, escapes) leaves the text as is."""
    return F.translate(c, "0123456789-", "") == ""


def _date_ok(c: Column) -> Column:
    """A non-blank date that is not a date makes the database refuse the post.

    The common cases (NULL, blank, a plain ``yyyy-mm-dd``) are decided on the
    raw text; only other texts are cleaned first (``OR`` is evaluated lazily).
    """
    quick = c.isNull() | (_unchanged_by_cleaning(c) & (c.isin("", "0") | c.try_cast("date").isNotNull()))
    raw = _blank_to_null(TX.clean_text(c))
    return quick | raw.isNull() | raw.try_cast("date").isNotNull()


def _fits(c: Column, n: int) -> Column:
    """The cleaned text fits a ``VARCHAR(n)`` column (NULL fits). Cleaning at
    most multiplies the length by 6 (``'`` becomes ``&#039;``), so short texts
    are decided without cleaning them."""
    return F.coalesce((F.length(c) * 6 <= n) | (F.length(TX.clean_text(c)) <= n), F.lit(True))


def delivery_fits() -> Column:
    return (_date_ok(F.col("delivery_date")) & _fits(F.col("delivery_company"), 100)
            & _fits(F.col("tracking_number"), 100))


# ---------------------------------------------------------------- reviews and deliveries

def _review_gate(bookings: DataFrame, commands: DataFrame) -> DataFrame:
    """Per booking: its start state and the winning review, if any."""
    first_review = (commands.filter(F.col("action").isin(*REVIEW_ACTIONS))
                    .groupBy("booking_id").agg(_first("action", "actor_id").alias("r")))
    b = bookings.select("id", F.col("status").alias("initial_status"), "accountant_id",
                        "storeman_id", "updated_at")
    g = b.join(first_review, b["id"] == first_review["booking_id"], "left").drop("booking_id")
    # The first review only counts when the booking was pending at the start.
    return g.withColumn("r", F.when(F.col("initial_status") == "pending", F.col("r")))


def _hot_bookings(commands: DataFrame) -> DataFrame:
    """Bookings with the most commands (counted on the key column alone)."""
    return hot_keys(commands.select("booking_id"), "booking_id")


def _winning_delivery(gate: DataFrame, commands: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """``booking_id, d``: earliest delivery command while the booking is approved."""
    open_from = (gate.filter((F.col("initial_status") == "approved")
                             | (F.col("r.action") == "approve"))
                 .select(F.col("id").alias("booking_id"),
                         F.when(F.col("initial_status") == "pending",
                                F.struct(F.col("r.ts").alias("ts"), F.col("r.cmd_id").alias("cmd_id")))
                         .alias("after")))
    # Delivery details the database refuses roll back with the status change,
    # so such a command never counts.
    dl = commands.filter(F.col("action").isin(*DELIVERY_ACTIONS) & delivery_fits())
    dl = salted_join(dl, open_from, "booking_id", "inner",
                     hot=_hot_bookings(commands) if hot is None else hot)
    later = F.col("after").isNull() | (F.struct("ts", "cmd_id") > F.col("after"))
    return (dl.filter(later).groupBy("booking_id")
            .agg(_first("action", "actor_id", "delivery_company", "tracking_number",
                        "delivery_date", "notes").alias("d")))


def workflow_state(bookings: DataFrame, commands: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Bookings after all review and delivery commands.

    ``id, initial_status, status, accountant_id, storeman_id, updated_at,
    review_cmd_id, delivery_cmd_id`` for every booking; the two command ids name
    the effective commands (NULL when none).
    """
    gate = _review_gate(bookings, commands)
    d = _winning_delivery(gate, commands, hot)
    s = gate.join(d, gate["id"] == d["booking_id"], "left").drop("booking_id")
    reviewed = F.col("r").isNotNull()
    delivered = F.col("d").isNotNull()
    status = (F.when(delivered, F.col("d.action"))
              .when(reviewed, F.when(F.col("r.action") == "approve", "approved").otherwise("rejected"))
              .otherwise(F.col("initial_status")))
    return s.select(
        "id", "initial_status", status.alias("status"),
        F.when(reviewed, F.col("r.actor_id")).otherwise(F.col("accountant_id")).alias("accountant_id"),
        F.when(delivered, F.col("d.actor_id")).otherwise(F.col("storeman_id")).alias("storeman_id"),
        F.coalesce(F.col("d.ts"), F.col("r.ts"), F.col("updated_at")).alias("updated_at"),
        F.col("r.cmd_id").alias("review_cmd_id"), F.col("d.cmd_id").alias("delivery_cmd_id"))


def bookings_after(bookings: DataFrame, state: DataFrame) -> DataFrame:
    """The booking rows with the status, staff and time that ``workflow_state`` gives them."""
    new = ("status", "accountant_id", "storeman_id", "updated_at")
    s = state.select(F.col("id").alias("__id"), *[F.col(c).alias(f"__{c}") for c in new])
    return bookings.join(s, bookings["id"] == s["__id"], "left").select(
        *[F.when(F.col("__id").isNotNull(), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in new else F.col(c)
          for c in bookings.columns])


def effective_deliveries(bookings: DataFrame, commands: DataFrame) -> DataFrame:
    """The one effective delivery command per booking, with its form payload."""
    d = _winning_delivery(_review_gate(bookings, commands), commands)
    return d.select("booking_id", "d.*")


def workflow_rejections(bookings: DataFrame, commands: DataFrame) -> DataFrame:
    """Review and delivery commands that changed nothing, with the reference's
    message: ``cmd_id, booking_id, action, reason``."""
    hot = _hot_bookings(commands)
    return rejections_from_state(commands, workflow_state(bookings, commands, hot), hot)


def rejections_from_state(commands: DataFrame, state: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """``workflow_rejections`` given an already computed ``workflow_state``."""
    st = state.select(F.col("id").alias("booking_id"), "review_cmd_id", "delivery_cmd_id")
    j = salted_join(commands, st, "booking_id", "left", hot=_hot_bookings(commands) if hot is None else hot)
    effective = ((F.col("cmd_id") == F.col("review_cmd_id"))
                 | (F.col("cmd_id") == F.col("delivery_cmd_id")))
    return (j.filter(~F.coalesce(effective, F.lit(False)))
            .select("cmd_id", "booking_id", "action", rejection_reason().alias("reason")))


def rejection_reason() -> Column:
    """Why a command that changed nothing did not."""
    known = F.coalesce(F.col("action").isin(*REVIEW_ACTIONS, *DELIVERY_ACTIONS), F.lit(False))
    return (F.when(~known, F.lit(MSG_BAD_DELIVERY_STATUS))
            .when(F.col("action").isin(*REVIEW_ACTIONS), F.lit(MSG_REVIEW_NOOP))
            .when(~delivery_fits(), F.lit(MSG_DB_DELIVERY))
            .otherwise(F.lit(MSG_DELIVERY_NOOP)))


# ---------------------------------------------------------------- payment updates

def _valid_payment_status() -> Column:
    status = TX.clean_text(F.col("payment_status"))
    return F.coalesce((~TX.is_blank(status)) & status.isin("pending", "paid", "failed"), F.lit(False))


def _payment_fits() -> Column:
    return (_date_ok(F.col("payment_date")) & _fits(F.col("payment_method"), 50)
            & _fits(F.col("transaction_id"), 100))


def valid_payment_update() -> Column:
    return _valid_payment_status() & _payment_fits()


def payment_updates_applied(payments: DataFrame, updates: DataFrame) -> DataFrame:
    """Payments after all update posts: the last valid post per booking
    overwrites status, method, transaction, date ('' → NULL), notes and actor."""
    valid = updates.filter(valid_payment_update())
    last = valid.groupBy("booking_id").agg(
        _last("actor_id", "payment_status", "payment_method", "transaction_id",
              "payment_date", "notes").alias("u"))
    j = payments.join(last, "booking_id", "left")
    hit = F.col("u").isNotNull()

    def pick(new: Column, old: str) -> Column:
        return F.when(hit, new).otherwise(F.col(old))

    return j.select(
        "id", "booking_id",
        pick(TX.clean_text(F.col("u.payment_status")), "payment_status").alias("payment_status"),
        pick(_form_date(F.col("u.payment_date")), "payment_date").alias("payment_date"),
        pick(TX.clean_text(F.col("u.payment_method")), "payment_method").alias("payment_method"),
        pick(TX.clean_text(F.col("u.transaction_id")), "transaction_id").alias("transaction_id"),
        pick(TX.clean_text(F.col("u.notes")), "notes").alias("notes"),
        pick(F.col("u.actor_id"), "updated_by").alias("updated_by"),
        "created_at",
        pick(F.col("u.ts"), "updated_at").alias("updated_at"))


def payment_update_rejections(payments: DataFrame, updates: DataFrame) -> DataFrame:
    """Update posts that changed nothing: invalid status or no payment row."""
    has_row = payments.select("booking_id").distinct().withColumn("has_row", F.lit(True))
    j = salted_join(updates, has_row, "booking_id", "left")
    reason = (F.when(~_valid_payment_status(), F.lit(MSG_BAD_PAYMENT_STATUS))
              .when(F.col("has_row").isNull(), F.lit(MSG_NO_PAYMENT))
              .when(~_payment_fits(), F.lit(MSG_PAYMENT_FAILED)))
    return (j.select("cmd_id", "booking_id", F.lit("update_payment").alias("action"), reason.alias("reason"))
            .filter(F.col("reason").isNotNull()))


# ---------------------------------------------------------------- delivery upsert

def delivery_upsert(delivery_details: DataFrame, bookings: DataFrame, commands: DataFrame) -> DataFrame:
    """Delivery details after the effective delivery commands: an existing row
    gets the new payload (``created_at`` kept), a missing one is inserted with
    the command id as its id. Unique key: ``booking_id``."""
    return upsert_deliveries(delivery_details, effective_deliveries(bookings, commands))


def upsert_deliveries(delivery_details: DataFrame, new: DataFrame) -> DataFrame:
    """Merge effective delivery commands (``booking_id, ts, cmd_id, actor_id``
    and the form payload) into the delivery details on ``booking_id``."""
    old = delivery_details.select(F.col("booking_id").alias("old_booking_id"),
                                  *[F.col(c).alias(f"old_{c}") for c in delivery_details.columns
                                    if c != "booking_id"])
    j = old.join(new, old["old_booking_id"] == new["booking_id"], "full_outer")
    hit = F.col("cmd_id").isNotNull()

    def pick(new_col: Column, old: str) -> Column:
        return F.when(hit, new_col).otherwise(F.col(f"old_{old}"))

    return j.select(
        F.coalesce(F.col("old_id"), F.col("cmd_id")).alias("id"),
        F.coalesce(F.col("booking_id"), F.col("old_booking_id")).alias("booking_id"),
        pick(TX.clean_text(F.col("delivery_company")), "delivery_company").alias("delivery_company"),
        pick(TX.clean_text(F.col("tracking_number")), "tracking_number").alias("tracking_number"),
        pick(_form_date(F.col("delivery_date")), "delivery_date").alias("delivery_date"),
        pick(TX.clean_text(F.col("notes")), "notes").alias("notes"),
        pick(F.col("actor_id"), "updated_by").alias("updated_by"),
        F.coalesce(F.col("old_created_at"), F.col("ts")).alias("created_at"),
        pick(F.col("ts"), "updated_at").alias("updated_at"))


# ---------------------------------------------------------------- booking requests

def priced_lines(request_items: DataFrame, products: DataFrame) -> DataFrame:
    """Request lines with product lookup, validity and the line's error."""
    dim = product_dim(products, "name", "price", F.col("stock_quantity").alias("stock"),
                      F.lit(True).alias("found"))
    li = request_items.join(dim, "product_id", "left")
    q = F.col("quantity")
    valid = (F.coalesce(F.col("product_id") != 0, F.lit(False))
             & F.coalesce(q > 0, F.lit(False)))
    error = (F.when(valid & F.col("found").isNull(), F.lit(MSG_INVALID_PRODUCT))
             .when(valid & (F.col("stock") < q),
                   F.concat(F.lit("Insufficient stock for "), F.col("name"), F.lit(". Available: "),
                            F.col("stock").cast("string"), F.lit(", Requested: "), q.cast("string"))))
    return li.select("request_id", "line_no", "product_id", "quantity", "price",
                     valid.alias("valid"), error.alias("error"))


def price_requests(requests: DataFrame, request_items: DataFrame, products: DataFrame) -> DataFrame:
    """Outcome of every booking request.

    ``request_id, outcome ('accepted'|'rejected'), message, amount, n_items``.
    Precedence: blank customer field, no lines, first bad line in line order
    (unknown product or short stock), no valid line. Stock is checked per
    line against the catalogue snapshot (never decremented, as in the
    reference). Accepted amount = sum of price x quantity over valid lines.
    """
    return outcomes_from_lines(requests, priced_lines(request_items, products))


def outcomes_from_lines(requests: DataFrame, lines: DataFrame) -> DataFrame:
    """``price_requests`` over already priced lines (see ``priced_lines``)."""
    agg = lines.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count_if(F.col("valid")).alias("n_valid"),
        F.min(F.when(F.col("error").isNotNull(),
                     F.struct("line_no", "product_id", "quantity", "error"))).alias("bad"),
        F.sum(F.when(F.col("valid"), F.col("price") * F.col("quantity"))).alias("total"))
    header_blank = TX.is_blank(TX.clean_text(F.col("customer_name")))
    for c in ("customer_phone", "customer_address", "payment_type"):
        header_blank = header_blank | TX.is_blank(TX.clean_text(F.col(c)))
    r = requests.join(agg, "request_id", "left")
    message = (F.when(header_blank, F.lit(MSG_MISSING_CUSTOMER))
               .when(F.coalesce(F.col("n_lines"), F.lit(0)) == 0, F.lit(MSG_NO_ITEMS))
               .when(F.col("bad").isNotNull(), F.col("bad.error"))
               .when(F.col("n_valid") == 0, F.lit(MSG_NO_VALID_ITEMS)))
    # Last, the booking row itself must fit its columns (in column order).
    name, phone = TX.clean_text(F.col("customer_name")), TX.clean_text(F.col("customer_phone"))
    ptype = TX.clean_text(F.col("payment_type"))
    message = (message.when(F.length(name) > 100, F.lit(MSG_DB_NAME))
               .when(F.length(phone) > 20, F.lit(MSG_DB_PHONE))
               .when(~ptype.isin(*S.PAYMENT_TYPES), F.lit(MSG_DB_PAYMENT_TYPE))
               .when(F.col("total") > F.lit(MAX_AMOUNT), F.lit(MSG_DB_AMOUNT)))
    ok = message.isNull()
    return r.select(
        "request_id",
        F.when(ok, "accepted").otherwise("rejected").alias("outcome"),
        message.alias("message"),
        F.when(ok, F.col("total")).cast("double").alias("amount"),
        F.when(ok, F.col("n_valid")).alias("n_items"))


def request_rejections(requests: DataFrame, request_items: DataFrame, products: DataFrame) -> DataFrame:
    return (price_requests(requests, request_items, products)
            .filter(F.col("outcome") == "rejected").select("request_id", "message"))


def accepted_ids(outcomes: DataFrame) -> DataFrame:
    """``request_id, amount, new_id`` of the accepted requests; the request id
    is kept as the booking id (see ``plans.jobs.dense_ids`` for new numbers)."""
    return (outcomes.filter(F.col("outcome") == "accepted")
            .select("request_id", "amount", F.col("request_id").alias("new_id")))


def _at(as_of) -> Column:
    return F.lit(str(as_of)).cast("timestamp_ntz")


def booking_rows(requests: DataFrame, accepted: DataFrame, as_of) -> DataFrame:
    """Booking rows to append, with every declared column: cleaned customer
    fields, amount, status pending, nobody else assigned, created and updated
    at ``as_of``; plus the request they come from."""
    r = requests.join(accepted.select("request_id", "amount", "new_id"), "request_id", "inner")
    return r.select(
        F.col("new_id").alias("id"), "request_id",
        *[TX.clean_text(F.col(c)).alias(c) for c in
          ("customer_name", "customer_phone", "customer_address", "payment_type")],
        F.col("amount").cast("decimal(10,2)").alias("amount"), F.lit("pending").alias("status"),
        "moderator_id", F.lit(None).cast("long").alias("accountant_id"), F.lit(None).cast("long").alias("storeman_id"),
        _at(as_of).alias("created_at"), _at(as_of).alias("updated_at"))


def item_rows(lines: DataFrame, accepted: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Item rows to append: the valid lines of accepted requests at catalogue price."""
    j = salted_join(lines.filter(F.col("valid")), accepted.select("request_id", "new_id"), "request_id",
                    "inner", hot=hot)
    return j.select(F.col("new_id").alias("booking_id"), "line_no", "product_id", "quantity",
                    F.col("price").alias("unit_price"))


def payment_rows(bookings: DataFrame) -> DataFrame:
    """Payment row of each new booking, with every declared column: 'Online
    Paid' → paid, else pending; no date. It takes the booking's id and times."""
    none = F.lit(None).cast("string")
    return bookings.select(
        "id", F.col("id").alias("booking_id"),
        F.when(F.col("payment_type") == "Online Paid", "paid").otherwise("pending").alias("payment_status"),
        F.lit(None).cast("date").alias("payment_date"), none.alias("payment_method"), none.alias("transaction_id"),
        none.alias("notes"), F.col("moderator_id").alias("updated_by"), "created_at", "updated_at")


def new_bookings(requests: DataFrame, request_items: DataFrame, products: DataFrame, as_of=D.DEFAULT_AS_OF) -> DataFrame:
    """Booking rows to append for the accepted requests (status pending)."""
    return booking_rows(requests, accepted_ids(price_requests(requests, request_items, products)), as_of)


def appended(table: DataFrame, rows: DataFrame) -> DataFrame:
    """``table`` with the new ``rows`` behind it, in the table's columns."""
    return table.unionByName(rows.select(*table.columns))


def new_booking_items(requests: DataFrame, request_items: DataFrame, products: DataFrame) -> DataFrame:
    """Item rows of the accepted requests: the valid lines at catalogue price."""
    acc = accepted_ids(price_requests(requests, request_items, products))
    hot = hot_keys(request_items.select("request_id"), "request_id")
    out = item_rows(priced_lines(request_items, products), acc, hot)
    return out.withColumn("unit_price", F.col("unit_price").cast("double"))


def initial_payments(requests: DataFrame, request_items: DataFrame, products: DataFrame, as_of=D.DEFAULT_AS_OF) -> DataFrame:
    """Payment row of each new booking: 'Online Paid' → paid, else pending; no date."""
    return payment_rows(new_bookings(requests, request_items, products, as_of))
