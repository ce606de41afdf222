"""Results from maintained state, over whole tables: batches and rollups.

``plans.store`` keeps this state in versioned tables; here it is built and
used in one go, so that its results can be held against full computations.
"""

from __future__ import annotations

from typing import Optional

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..operators import fold
from ..operators import rollups as RU
from ..operators import workflow as W
from ..operators.spread import Dealing, dealing
from ..sources.driver import Tables


def _batches(commands: DataFrame) -> list[DataFrame]:
    """All commands in three batches by who sent them, so none of them is in time order with the others."""
    who = F.coalesce(F.col("actor_id"), F.lit(0))
    return [commands.filter(who >= 16), commands.filter(who < 8), commands.filter((who >= 8) & (who < 16))]


def workflow_state_in_batches(t: Tables) -> DataFrame:
    """``workflow.workflow_state`` with the commands folded batch by batch, late ones included."""
    return fold.folded_in_batches(t.booking_core, _batches(t.workflow_commands))


def _rollups(t: Tables, bookings: DataFrame, payments: DataFrame, dealt: Optional[Dealing] = None) -> dict[str, DataFrame]:
    return RU.rollups(bookings, payments, t.booking_items, t.products, dealt)


def rolled_revenue_overview(t: Tables, as_of=D.DEFAULT_AS_OF) -> DataFrame:
    """Revenue overview from the payment-day rollup."""
    return RU.revenue_overview(_rollups(t, t.bookings, t.payments), as_of)


def rolled_payment_type_stats(t: Tables) -> DataFrame:
    """Payment-type shares from the payment-day rollup."""
    return RU.payment_type_stats(_rollups(t, t.bookings, t.payments))


def rolled_top_products(t: Tables) -> DataFrame:
    """Top products from the product-month rollup."""
    return RU.top_products(_rollups(t, t.bookings, t.payments, dealing(t.booking_items, "booking_id")), t.products)


def top_products_after_jobs(t: Tables) -> DataFrame:
    """Top products after all payment posts."""
    return RU.top_products(rollups_after_jobs(t, dealing(t.booking_items, "booking_id")), t.products)


def rollups_after_jobs(t: Tables, dealt: Optional[Dealing] = None) -> dict[str, DataFrame]:
    """The rollups of all bookings, changed by what the bookings of the workflow commands and payment posts
    contribute before and after those: no other booking is looked at for the change. ``dealt`` is for the
    product months."""
    named = t.workflow_commands.select("booking_id").union(t.payment_updates.select("booking_id")).distinct()
    bookings = t.bookings.join(named.withColumnRenamed("booking_id", "id"), "id", "left_semi")
    payments = t.payments.join(named, "booking_id", "left_semi")
    state = W.workflow_state(bookings, t.workflow_commands)
    new = _rollups(t, W.bookings_after(bookings, state), W.payment_updates_applied(payments, t.payment_updates), dealt)
    return RU.added(_rollups(t, t.bookings, t.payments, dealt), RU.change(_rollups(t, bookings, payments, dealt), new))


def dash_accountant_after_jobs(t: Tables) -> DataFrame:
    """Accountant dashboard after all commands."""
    return RU.dash_accountant(rollups_after_jobs(t))


def delivery_stats_after_jobs(t: Tables, as_of=D.DEFAULT_AS_OF) -> DataFrame:
    """Delivery strip after all commands."""
    return RU.delivery_stats(rollups_after_jobs(t), as_of)


def payment_stats_after_jobs(t: Tables) -> DataFrame:
    """Payment strip after all payment posts."""
    return RU.payment_stats(rollups_after_jobs(t))


def monthly_revenue_after_jobs(t: Tables, as_of=D.DEFAULT_AS_OF) -> DataFrame:
    """Paid revenue per month after all payment posts."""
    return RU.monthly_revenue(rollups_after_jobs(t), as_of)


def mixed_case_categories(t: Tables) -> Tables:
    """The catalogue with the spellings of several suppliers: categories as they come or lower-cased, and SKUs too.

    The driver's table has one spelling of each; every third product is given the other one."""
    other = F.col("id") % 3 == 0
    p = t.products.withColumns({c: F.when(other, F.lower(c)).otherwise(F.col(c)) for c in ("category", "sku")})
    return t.replace(products=p)
