"""A fold over command batches that may be continued, in any order.

``workflow.workflow_state`` folds all commands at once. Commands that arrive
in batches, late ones included, must end in the same state however they were
dealt, so what a batch leaves behind may not be the folded booking: an earlier
approve that comes late makes deliveries count that were too early before.

What is left behind is the set of *open* commands, those that can still decide
something. Per booking that was pending at the start:

* the earliest review; a later one can never win, since reviews only get earlier;
* the deliveries up to the first one after that review: whatever earlier review
  may come, the first delivery after it is one of these.

Per booking that was approved at the start: its earliest delivery. Bookings in
another state, unknown bookings, unknown actions and deliveries that the
database refuses have no open commands. All others are *settled*: they changed
nothing and never will.

``open_commands`` is associative, commutative and idempotent over batches, and
``workflow_state(start, open)`` equals the fold over all commands. The same
holds for payment posts, of which the last valid one per booking is open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from . import workflow as W
from .skew import hot_keys, salted_join

_ORDER = ("ts", "cmd_id")


def _order() -> Column:
    return F.struct(*_ORDER)


def _marked(start: DataFrame, commands: DataFrame) -> DataFrame:
    """``commands`` with ``__open``: whether each can still decide something.

    ``start``: ``id`` and ``status`` of the bookings before any command. Every "first per booking" is a
    partial aggregate, and commands meet it in salted joins, so a hot booking is no hot task."""
    hot = hot_keys(commands.select("booking_id"), "booking_id")
    first_review = (commands.filter(F.col("action").isin(*W.REVIEW_ACTIONS)).groupBy("booking_id")
                    .agg(F.min(_order()).alias("__review")))
    gate = (start.filter(F.col("status").isin("pending", "approved")).select(F.col("id").alias("booking_id"), "status")
            .join(first_review, "booking_id", "left")
            .select("booking_id", F.col("status").alias("__start"), F.when(F.col("status") == "pending", F.col("__review")).alias("__review")))
    met = salted_join(commands, gate, "booking_id", "left", hot=hot)
    delivery = F.col("action").isin(*W.DELIVERY_ACTIONS) & W.delivery_fits()
    # A booking approved at the start takes any delivery, a pending one those after its review.
    counts = delivery & ((F.col("__start") == "approved") | (_order() > F.col("__review")))
    last = (met.groupBy("booking_id").agg(F.min(F.when(counts, _order())).alias("__last")))
    met = salted_join(met, last, "booking_id", "left", hot=hot)
    open_review = F.col("action").isin(*W.REVIEW_ACTIONS) & (F.col("__start") == "pending") & (_order() == F.col("__review"))
    open_delivery = delivery & F.col("__start").isNotNull() & (F.col("__last").isNull() | (_order() <= F.col("__last")))
    return (met.withColumn("__open", F.coalesce(open_review | open_delivery, F.lit(False)))
            .drop("__start", "__review", "__last"))


def open_commands(start: DataFrame, *batches: DataFrame) -> DataFrame:
    """The commands of all batches (open ones of earlier folds included) that are still open; each once."""
    commands = batches[0]
    for more in batches[1:]:
        commands = commands.unionByName(more.select(*commands.columns))
    return _marked(start, commands).filter("__open").drop("__open").dropDuplicates(["cmd_id"])


def settled_commands(start: DataFrame, *batches: DataFrame) -> DataFrame:
    """The other commands: ``cmd_id, booking_id, action, reason``, as ``workflow.workflow_rejections`` gives them."""
    commands = batches[0]
    for more in batches[1:]:
        commands = commands.unionByName(more.select(*commands.columns))
    rest = _marked(start, commands).filter("NOT __open")
    return rest.select("cmd_id", "booking_id", "action", W.rejection_reason().alias("reason"))


def open_posts(*batches: DataFrame) -> DataFrame:
    """The last valid payment post of each booking over all batches; the others can never win."""
    posts = batches[0]
    for more in batches[1:]:
        posts = posts.unionByName(more.select(*posts.columns))
    rest = [c for c in posts.columns if c not in (*_ORDER, "booking_id")]
    last = (posts.filter(W.valid_payment_update()).groupBy("booking_id")
            .agg(F.max(F.struct(*_ORDER, *rest)).alias("__p")))
    return last.select("booking_id", "__p.*").select(*posts.columns)


def folded_in_batches(start: DataFrame, batches: list[DataFrame]) -> DataFrame:
    """``workflow_state`` with the batches folded one after another, keeping only open commands between them,
    in the session's checkpoint folder."""
    ensure_checkpoint_dir(start.sparkSession)
    held = open_commands(start, batches[0]).checkpoint()
    for batch in batches[1:]:
        held = open_commands(start, held, batch).checkpoint()
    return W.workflow_state(start, held)
