"""End-to-end write jobs: several outputs from one pass, committed together.

Each job computes its shared intermediate once and cuts the lineage with a
reliable ``checkpoint()`` into the folder the session names in
``spark.checkpoint.dir`` (a shared folder on a cluster), so a lost executor
recomputes from the checkpoint instead of from the sources, and the outputs
do not recompute the intermediate. Outputs are then committed as one version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates as D
from ..operators import workflow as W
from ..operators.items import booking_labels
from . import reports as R
from ..session import ensure_checkpoint_dir
from ..sources.driver import Tables
from ..sources.sinks import commit_versioned, read_version


def dense_ids(df: DataFrame, order_col: str, start: int, name: str = "new_id") -> DataFrame:
    """Number the rows ``start, start+1, ...`` in ``order_col`` order, like an
    auto-increment column, without funnelling rows through one partition.

    After a range-partitioned sort every row is tagged with
    ``monotonically_increasing_id`` (partition index in the high bits,
    position in the low bits) and the result is checkpointed so the tags are
    stable. Rows are then counted per partition (one row per partition: a
    bounded table), the counts are prefix-summed into offsets, and the
    broadcast offsets are added back.
    """
    tagged = df.orderBy(order_col).withColumn("__mid", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright(F.col("__mid"), 33)
    pos = F.col("__mid").bitwiseAND((1 << 33) - 1)
    counts = tagged.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    out = tagged.withColumn("__part", part).join(F.broadcast(offsets), "__part")
    return out.select(*df.columns, (F.lit(start) + F.col("__off") + pos).alias(name))


def _committed(spark: SparkSession, outputs: dict[str, DataFrame], root: str, version: str) -> dict[str, DataFrame]:
    """Commit the outputs and return what is stored for the version, by this attempt or an earlier one."""
    commit_versioned(spark, outputs, root, version)
    return {name: read_version(spark, root, name, version) for name in outputs}


def process_booking_requests(spark: SparkSession, t: Tables, root: str, version: str,
                             dense: bool = False, as_of=D.DEFAULT_AS_OF) -> dict[str, DataFrame]:
    """Price and stock-check all requests; commit new bookings, their items,
    their payment rows, their item texts (to append to ``booking_labels``)
    and the rejections as one version under ``root``.

    New bookings keep the request id as their id, or with ``dense`` get the
    next ids after the largest existing booking id, in request order (the
    database's auto-increment); ``request_id`` is kept beside it."""
    ensure_checkpoint_dir(spark)
    lines = W.priced_lines(t.booking_request_items, t.products).checkpoint()
    outcome = W.outcomes_from_lines(t.booking_requests, lines).checkpoint()
    accepted = W.accepted_ids(outcome)
    if dense:
        start = (t.bookings.agg(F.max("id")).first()[0] or 0) + 1
        ids = dense_ids(accepted.select("request_id"), "request_id", start, "new_id").checkpoint()
        accepted = accepted.drop("new_id").join(ids, "request_id", "inner")
    new_bookings = W.booking_rows(t.booking_requests, accepted, as_of)
    items = W.item_rows(lines, accepted)
    payments = W.payment_rows(new_bookings)
    rejections = outcome.filter(F.col("outcome") == "rejected").select("request_id", "message")
    outputs = {"new_bookings": new_bookings, "new_booking_items": items, "new_payments": payments,
               "new_booking_labels": booking_labels(items, t.products),
               "request_rejections": rejections}
    return _committed(spark, outputs, root, version)


def apply_commands(spark: SparkSession, t: Tables, root: str, version: str) -> dict[str, DataFrame]:
    """Fold review, delivery and payment commands into new versions of the
    bookings, delivery details and payments tables, plus the rejected
    commands, committed together under ``root``."""
    ensure_checkpoint_dir(spark)
    state = W.workflow_state(t.bookings, t.workflow_commands).checkpoint()
    bookings = W.bookings_after(t.bookings, state)
    effective = state.filter(F.col("delivery_cmd_id").isNotNull()).select(F.col("id").alias("booking_id"),
                                                                           "delivery_cmd_id")
    cmds = t.workflow_commands
    new = cmds.join(effective, (cmds["booking_id"] == effective["booking_id"])
                    & (cmds["cmd_id"] == effective["delivery_cmd_id"]), "left_semi")
    deliveries = W.upsert_deliveries(t.delivery_details, new)
    payments = W.payment_updates_applied(t.payments, t.payment_updates)
    rejected = W.rejections_from_state(cmds, state).unionByName(
        W.payment_update_rejections(t.payments, t.payment_updates))
    outputs = {"bookings": bookings, "delivery_details": deliveries, "payments": payments,
               "rejected_commands": rejected}
    return _committed(spark, outputs, root, version)


def reports_page(spark: SparkSession, t: Tables, root: str, version: str,
                 as_of=D.DEFAULT_AS_OF) -> dict[str, DataFrame]:
    """All sections of the reports page from one pass: the bookings ⋈ paid
    payments join that four sections share is computed once and checkpointed,
    the sections are derived from it and committed together under ``root``."""
    ensure_checkpoint_dir(spark)
    paid = R.paid_bookings(t, *R.PAID_COLS).checkpoint()
    outputs = {
        "revenue_overview": R.revenue_overview(t, as_of, paid=paid),
        "booking_stats": R.booking_stats_full(t),
        "monthly_revenue": R.monthly_revenue(t, as_of, paid=paid),
        "top_products": R.top_products(t, ranked=True, paid=paid),
        "recent_transactions": R.recent_transactions(t, paid=paid),
        "payment_type_stats": R.payment_type_stats(t, paid=paid),
    }
    return _committed(spark, outputs, root, version)
