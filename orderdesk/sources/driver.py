"""Logical order-booking tables derived from the driver's star-schema parquet.

Each logical table is a projection of one or two driver tables, so every job
reads the given data and its work grows with it. The mapping is the one of
(phone, address, payment method, ...). The oracle in ``orderdesk.oracle``
states the same mapping independently in DuckDB SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas as S


class Tables:
    """The six tables of the booking database, plus optional job inputs.

    Members are DataFrames or zero-argument factories; a factory runs on first
    access, so a query only reads the tables it uses.
    """

    FIELDS = ("users", "products", "bookings", "booking_items", "payments", "delivery_details",
              "workflow_commands", "payment_updates", "booking_requests", "booking_request_items",
              "cart_lines", "booking_labels", "booking_core")

    def __init__(self, **parts):
        unknown = set(parts) - set(self.FIELDS)
        if unknown:
            raise TypeError(f"unknown tables: {sorted(unknown)}")
        self.__dict__["_parts"] = {name: parts.get(name) for name in self.FIELDS}

    def __getattr__(self, name: str):
        parts = self.__dict__["_parts"]
        if name not in parts:
            raise AttributeError(name)
        value = parts[name]
        if value is None and name == "booking_core":
            return self.bookings  # the narrow columns are there too
        if value is not None and not isinstance(value, DataFrame):
            value = parts[name] = value()
        return value

    def replace(self, **changes) -> "Tables":
        """A copy with some members replaced."""
        merged = dict(self.__dict__["_parts"])
        if "bookings" in changes:
            merged["booking_core"] = None  # follows the bookings
        merged.update(changes)
        return Tables(**merged)

    def register(self, spark: SparkSession) -> None:
        """Expose every present table as a temp view for ``spark.sql``."""
        for name in self.FIELDS:
            df = getattr(self, name)
            if df is not None:
                df.createOrReplaceTempView(name)


def read_driver_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables (schema from the file footer)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_read = read_driver_table


def _plus_days(ts_col: str, days: Column) -> Column:
    return F.date_add(F.to_date(F.col(ts_col)), days.cast("int"))


def _phone(custkey: Column) -> Column:
    # A few customers carry a short, invalid number so the format audit has work.
    return (F.when(custkey % 50 == 0, (custkey % 100000).cast("string"))
            .otherwise(F.concat(F.lit("+1 555 "), F.lpad((custkey % 10000000).cast("string"), 7, "0"))))


def _payment_type(segment: Column) -> Column:
    return (F.when(segment.isin("AUTOMOBILE", "BUILDING"), F.lit("Online Paid"))
            .otherwise(F.lit("Cash on Delivery")))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _read(spark, sf_dir, "nation")
    role = (F.when(n.n_regionkey % 3 == 0, "moderator")
            .when(n.n_regionkey % 3 == 1, "accountant").otherwise("storeman"))
    return n.select(
        n.n_nationkey.cast("long").alias("id"),
        F.lower(n.n_name).alias("username"),
        role.alias("role"),
        n.n_name.alias("full_name"),
        F.concat(F.lower(n.n_name), F.lit("@example.com")).alias("email"),
        F.lit(None).cast("timestamp_ntz").alias("created_at"))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "part")
    return p.select(
        p.p_partkey.alias("id"), p.p_name.alias("name"), p.p_brand.alias("description"),
        p.p_type.alias("category"), p.p_retailprice.cast(S.MONEY).alias("price"),
        p.p_size.alias("stock_quantity"),
        # Every 500th product repeats its neighbour's SKU, so the key audit has work.
        F.concat(F.lit("SKU"), F.when(p.p_partkey % 500 == 0, p.p_partkey - 1).otherwise(p.p_partkey).cast("string"))
        .alias("sku"),
        F.lit(None).cast("timestamp_ntz").alias("created_at"),
        F.lit(None).cast("timestamp_ntz").alias("updated_at"))


def _booking_core() -> list[Column]:
    """The booking columns that ``orders`` alone gives."""
    prio = F.substring(F.col("o_orderpriority"), 1, 1)
    status = (F.when(prio == "1", "pending").when(prio == "2", "approved")
              .when(prio == "3", "rejected").when(prio == "4", "delivered")
              .otherwise("not_delivered"))
    # A few statuses outside the domain and a few unknown accountants, for the audits.
    status = F.when(F.col("o_orderkey") % 997 == 0, "archived").otherwise(status)
    return [
        F.col("o_orderkey").alias("id"),
        F.col("o_totalprice").cast(S.MONEY).alias("amount"),
        status.alias("status"),
        F.when(~F.col("o_orderpriority").startswith("1"), F.col("o_orderkey") % 27).alias("accountant_id"),
        F.when(prio.isin("4", "5"), F.col("o_custkey") % 25).alias("storeman_id"),
        F.col("o_orderdate").alias("created_at"),
        _plus_days("o_orderdate", F.col("o_orderkey") % 10).cast("timestamp_ntz").alias("updated_at")]


def booking_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bookings without their customer and moderator columns: no join."""
    return _read(spark, sf_dir, "orders").select(*_booking_core())


def bookings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    c = _read(spark, sf_dir, "customer")
    j = o.join(c, o.o_custkey == c.c_custkey, "left").select(
        *_booking_core(),
        F.col("c_name").alias("customer_name"),
        _phone(F.col("o_custkey")).alias("customer_phone"),
        F.concat(F.col("c_mktsegment"), F.lit(" district "), F.col("c_nationkey").cast("string"))
        .alias("customer_address"),
        _payment_type(F.col("c_mktsegment")).alias("payment_type"),
        F.col("c_nationkey").cast("long").alias("moderator_id"))
    return j.select(*[f.name for f in S.BOOKINGS.fields])


def booking_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem")
    return li.select(
        (li.l_orderkey * 8 + li.l_linenumber).alias("id"), li.l_orderkey.alias("booking_id"),
        li.l_partkey.alias("product_id"), li.l_quantity.cast("int").alias("quantity"),
        li.l_extendedprice.cast(S.MONEY).alias("unit_price"))


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders").filter(F.col("o_orderkey") % 10 != 0)
    k = F.col("o_orderkey")
    status = (F.when(F.col("o_orderstatus") == "P", "paid")
              .when(F.col("o_orderstatus") == "O", "pending").otherwise("failed"))
    method = F.when(k % 3 == 0, "Bank Transfer").when(k % 3 == 1, "Card").otherwise("Cash")
    return o.select(
        k.alias("id"), k.alias("booking_id"), status.alias("payment_status"),
        F.when(k % 7 != 0, _plus_days("o_orderdate", k % 30)).alias("payment_date"),
        method.alias("payment_method"),
        F.concat(F.lit("TXN"), k.cast("string")).alias("transaction_id"),
        F.lit(None).cast("string").alias("notes"),
        (k % 25).alias("updated_by"),
        F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("updated_at"))


def delivery_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    o = o.filter(F.substring("o_orderpriority", 1, 1).isin("4", "5"))
    k = F.col("o_orderkey")
    return o.select(
        k.alias("id"), k.alias("booking_id"),
        F.when(k % 11 != 0, F.concat(F.lit("Carrier"), (k % 5).cast("string"))).alias("delivery_company"),
        F.concat(F.lit("TRK"), k.cast("string")).alias("tracking_number"),
        _plus_days("o_orderdate", k % 14).alias("delivery_date"),
        F.lit(None).cast("string").alias("notes"),
        (F.col("o_custkey") % 25).alias("updated_by"),
        F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("updated_at"))


def workflow_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review and delivery commands: click=approve, error=reject,
    purchase=delivered, view=not_delivered (every 40th: a status that does not
    exist); ``user_id`` names the booking."""
    e = _read(spark, sf_dir, "events").filter(F.col("event_type").isin("click", "error", "purchase", "view"))
    t = F.col("event_type")
    action = (F.when(t == "click", "approve").when(t == "error", "reject")
              .when(t == "purchase", "delivered").when(F.col("event_id") % 40 == 0, "returned")  # not a valid status
              .otherwise("not_delivered"))
    is_delivery = t.isin("purchase", "view")
    eid = F.col("event_id")
    return e.select(
        eid.alias("cmd_id"), F.col("ts"), F.col("user_id").alias("booking_id"),
        (eid % 25).alias("actor_id"), action.alias("action"),
        F.when(is_delivery, F.concat(F.lit("Carrier"), (eid % 5).cast("string"))).alias("delivery_company"),
        F.when(is_delivery, F.concat(F.lit("TRK-E"), eid.cast("string"))).alias("tracking_number"),
        F.when(is_delivery, F.when(eid % 4 == 0, F.lit(""))
               .otherwise(F.to_date("ts").cast("string"))).alias("delivery_date"),
        F.when(is_delivery, F.col("props")).alias("notes"))


def payment_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payment-status form posts: the ``signup`` events."""
    e = _read(spark, sf_dir, "events").filter(F.col("event_type") == "signup")
    eid = F.col("event_id")
    status = (F.when(eid % 4 == 0, "paid").when(eid % 4 == 1, "pending")
              .when(eid % 4 == 2, "failed").otherwise("refunded"))
    return e.select(
        eid.alias("cmd_id"), F.col("ts"), F.col("user_id").alias("booking_id"),
        (eid % 25).alias("actor_id"), status.alias("payment_status"),
        F.when(eid % 2 == 0, "Card").otherwise("Cash").alias("payment_method"),
        F.concat(F.lit("TXN-E"), eid.cast("string")).alias("transaction_id"),
        F.when(eid % 5 == 0, F.lit("")).otherwise(F.to_date("ts").cast("string")).alias("payment_date"),
        F.col("props").alias("notes"))


def booking_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One create-booking form post per order; a few have a blank phone."""
    o = _read(spark, sf_dir, "orders")
    c = _read(spark, sf_dir, "customer")
    j = o.join(c, o.o_custkey == c.c_custkey, "left")
    k = F.col("o_orderkey")
    return j.select(
        k.alias("request_id"), F.col("c_name").alias("customer_name"),
        F.when(k % 101 == 0, F.lit("  ")).otherwise(_phone(F.col("o_custkey"))).alias("customer_phone"),
        F.concat(F.col("c_mktsegment"), F.lit(" district "), F.col("c_nationkey").cast("string"))
        .alias("customer_address"),
        _payment_type(F.col("c_mktsegment")).alias("payment_type"),
        F.col("c_nationkey").cast("long").alias("moderator_id"))


def booking_request_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem")
    return li.select(li.l_orderkey.alias("request_id"), li.l_linenumber.alias("line_no"),
                     li.l_partkey.alias("product_id"), li.l_quantity.cast("int").alias("quantity"))


def cart_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product picks per cart; line 7 of an order is a removal of that quantity."""
    li = _read(spark, sf_dir, "lineitem")
    q = li.l_quantity.cast("int")
    return li.select(li.l_orderkey.alias("cart_id"), li.l_linenumber.alias("pick_no"),
                     li.l_partkey.alias("product_id"),
                     F.when(li.l_linenumber == 7, -q).otherwise(q).alias("quantity"))


def driver_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """All logical tables over one driver data folder (lazy; nothing is read yet)."""
    makers = {name: globals()[name] for name in Tables.FIELDS if name != "booking_labels"}
    return Tables(**{name: (lambda f=f: f(spark, sf_dir)) for name, f in makers.items()})
