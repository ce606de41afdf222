"""Declared schemas of the logical tables and of the bulk-job inputs.

Nothing is inferred: every reader passes one of these ``StructType``s. Ids are
``long`` so the same schemas hold the driver's data and a real catalogue.
"""

from pyspark.sql import types as T

_L, _I, _S = T.LongType(), T.IntegerType(), T.StringType()
_TS, _D = T.TimestampNTZType(), T.DateType()
MONEY = T.DecimalType(10, 2)


def _schema(*fields):
    return T.StructType([T.StructField(name, dtype, nullable) for name, dtype, nullable in fields])


USERS = _schema(("id", _L, False), ("username", _S, False), ("role", _S, False),
                ("full_name", _S, False), ("email", _S, True), ("created_at", _TS, True))

PRODUCTS = _schema(("id", _L, False), ("name", _S, False), ("description", _S, True),
                   ("category", _S, True), ("price", MONEY, False), ("stock_quantity", _I, False),
                   ("sku", _S, True), ("created_at", _TS, True), ("updated_at", _TS, True))

BOOKINGS = _schema(("id", _L, False), ("customer_name", _S, False), ("customer_phone", _S, False),
                   ("customer_address", _S, False), ("payment_type", _S, False),
                   ("amount", MONEY, False), ("status", _S, True), ("moderator_id", _L, True),
                   ("accountant_id", _L, True), ("storeman_id", _L, True),
                   ("created_at", _TS, True), ("updated_at", _TS, True))

BOOKING_ITEMS = _schema(("id", _L, False), ("booking_id", _L, False), ("product_id", _L, False),
                        ("quantity", _I, False), ("unit_price", MONEY, False))

DELIVERY_DETAILS = _schema(("id", _L, False), ("booking_id", _L, False), ("delivery_company", _S, True),
                           ("tracking_number", _S, True), ("delivery_date", _D, True),
                           ("notes", _S, True), ("updated_by", _L, True),
                           ("created_at", _TS, True), ("updated_at", _TS, True))

PAYMENTS = _schema(("id", _L, False), ("booking_id", _L, False), ("payment_status", _S, True),
                   ("payment_date", _D, True), ("payment_method", _S, True),
                   ("transaction_id", _S, True), ("notes", _S, True), ("updated_by", _L, True),
                   ("created_at", _TS, True), ("updated_at", _TS, True))

# Inputs of the bulk jobs that replace one-row web requests.
BOOKING_REQUESTS = _schema(("request_id", _L, False), ("customer_name", _S, True),
                           ("customer_phone", _S, True), ("customer_address", _S, True),
                           ("payment_type", _S, True), ("moderator_id", _L, True))

BOOKING_REQUEST_ITEMS = _schema(("request_id", _L, False), ("line_no", _I, False),
                                ("product_id", _L, True), ("quantity", _I, True))

WORKFLOW_COMMANDS = _schema(("cmd_id", _L, False), ("ts", _TS, False), ("booking_id", _L, False),
                            ("actor_id", _L, True), ("action", _S, True),
                            ("delivery_company", _S, True), ("tracking_number", _S, True),
                            ("delivery_date", _S, True), ("notes", _S, True))

PAYMENT_UPDATES = _schema(("cmd_id", _L, False), ("ts", _TS, False), ("booking_id", _L, False),
                          ("actor_id", _L, True), ("payment_status", _S, True),
                          ("payment_method", _S, True), ("transaction_id", _S, True),
                          ("payment_date", _S, True), ("notes", _S, True))

CART_LINES = _schema(("cart_id", _L, False), ("pick_no", _I, False),
                     ("product_id", _L, True), ("quantity", _I, True))

LOGICAL = {
    "users": USERS, "products": PRODUCTS, "bookings": BOOKINGS,
    "booking_items": BOOKING_ITEMS, "delivery_details": DELIVERY_DETAILS, "payments": PAYMENTS,
}

# Enum domains declared by the reference's DDL.
ROLES = ("moderator", "accountant", "storeman")
PAYMENT_TYPES = ("Online Paid", "Cash on Delivery")
BOOKING_STATUSES = ("pending", "approved", "rejected", "delivered", "not_delivered")
PAYMENT_STATUSES = ("pending", "paid", "failed")
