"""A booking store: versioned tables that jobs change in place, bucket by bucket.

The web application updates single rows. Here a job takes a batch of requests
or commands and a snapshot, works on the buckets that hold the bookings it
touches, and commits them as the next version; the files of all other buckets
stay as they are. A commit that comes in between makes the job's base stale
(``versions.StaleBase``); ``retried`` runs it again on the newest version.

Beside the current tables the store keeps

* ``booking_start``, ``payment_start``, ``delivery_start``: the rows before any command;
* ``open_commands``, ``open_posts``: the commands that can still decide something
  (``operators.fold``), so batches may come in any order, late commands included,
  and end in the state of one fold over all commands;
* ``rejections``: commands and posts that changed nothing, with the reason. Open
  commands are not in it: ``rejected`` adds those that have no effect as of a version;
* ``booking_grams``: the trigram index of the search box (``operators.search``);
  what it covers is never edited, so it only grows;
* ``audit_counts``: the counts behind the key, reference and stock audits
  (``operators.audit_counts``), changed in the buckets of the values that change;
* the rollups of the dashboards (``operators.rollups``), changed by what the touched
  bookings contribute before and after.
"""

from __future__ import annotations

from typing import Callable, Optional

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dates as D
from ..functions import text as TX
from ..operators import audit_counts, fold, rollups, search
from ..operators import workflow as W
from . import lists as L
from ..session import ensure_checkpoint_dir
from ..sources import schemas as S
from ..sources import versions as V
from ..sources.driver import Tables

BUCKETS = 64
_KEYS = {"bookings": "id", "booking_items": "booking_id", "payments": "booking_id", "delivery_details": "booking_id",
         "booking_start": "id", "payment_start": "booking_id", "delivery_start": "booking_id",
         "open_commands": "booking_id", "open_posts": "booking_id", "booking_grams": "gram_hash",
         "audit_counts": "value_hash"}
_START = ("id", "status", "accountant_id", "storeman_id", "updated_at")
_REJECTION = "cmd_id long, booking_id long, action string, reason string"


def _none(spark: SparkSession, schema: T.StructType | str) -> DataFrame:
    return spark.createDataFrame([], schema)


def create(spark: SparkSession, t: Tables, root: str, buckets: int = BUCKETS, version: str = "start") -> V.Snapshot:
    """The first version: all tables of ``t``, no commands, and the rollups."""
    rows = {"bookings": t.bookings, "booking_items": t.booking_items, "payments": t.payments, "delivery_details": t.delivery_details,
            "booking_start": t.bookings.select(*_START), "payment_start": t.payments, "delivery_start": t.delivery_details,
            "audit_counts": audit_counts.counts({name: getattr(t, name) for name in S.LOGICAL}),
            "booking_grams": L.booking_index(t), "open_commands": _none(spark, S.WORKFLOW_COMMANDS), "open_posts": _none(spark, S.PAYMENT_UPDATES)}
    writes = {name: V.Write(df, key=_KEYS[name], buckets=buckets) for name, df in rows.items()}
    writes |= {"users": V.Write(t.users), "products": V.Write(t.products), "rejections": V.Write(_none(spark, _REJECTION))}
    writes |= {name: V.Write(df) for name, df in rollups.rollups(t.bookings, t.payments, t.booking_items, t.products).items()}
    return V.commit(V.latest(spark, root), version, writes)


def tables(snapshot: V.Snapshot, base: Optional[Tables] = None) -> Tables:
    """The six tables as of one version; job inputs are taken from ``base``."""
    stored = {name: (lambda n=name: snapshot.read(n)) for name in (*S.LOGICAL,)}
    return base.replace(**stored) if base is not None else Tables(**stored)


def stored_rollups(snapshot: V.Snapshot) -> dict[str, DataFrame]:
    return {name: snapshot.read(name) for name in rollups.GROUPS}


def _counted(snapshot: V.Snapshot, change: DataFrame) -> V.Write:
    """The stored counts with a change (checkpointed), in the buckets it touches."""
    touched = snapshot.touched("audit_counts", change, "value_hash")
    return V.Write(audit_counts.added(snapshot.read("audit_counts", touched), change), "buckets", touched=tuple(touched))


def rejected(snapshot: V.Snapshot) -> DataFrame:
    """All commands and posts without effect as of a version, with the reason."""
    held = snapshot.read("open_commands")
    return snapshot.read("rejections").unionByName(W.workflow_rejections(snapshot.read("booking_start"), held))


def apply_batch(snapshot: V.Snapshot, version: str, commands: Optional[DataFrame] = None,
                posts: Optional[DataFrame] = None) -> V.Snapshot:
    """Fold a batch of review and delivery commands and of payment posts into the store.

    Only the buckets of the bookings they name are read and written."""
    done = V.version_of(snapshot.spark, snapshot.root, version)
    if done is not None:
        return done
    spark = snapshot.spark
    ensure_checkpoint_dir(spark)
    commands = _none(spark, S.WORKFLOW_COMMANDS) if commands is None else commands
    posts = _none(spark, S.PAYMENT_UPDATES) if posts is None else posts
    touched = snapshot.touched("bookings", commands.select("booking_id").union(posts.select("booking_id")).dropna(), "booking_id")

    def old(name: str) -> DataFrame:
        return snapshot.read(name, touched)

    start, held = old("booking_start"), old("open_commands")
    open_ = fold.open_commands(start, held, commands).checkpoint()
    settled = fold.settled_commands(start, held, commands)
    open_posts = fold.open_posts(old("open_posts"), posts).checkpoint()
    lost = W.payment_update_rejections(old("payment_start"), posts)
    bookings = W.bookings_after(old("bookings"), W.workflow_state(start, open_)).checkpoint()
    payments = W.payment_updates_applied(old("payment_start"), open_posts).checkpoint()
    deliveries = W.upsert_deliveries(old("delivery_start"), W.effective_deliveries(start, open_)).checkpoint()
    items, products = old("booking_items"), snapshot.read("products")
    change = rollups.change(rollups.rollups(old("bookings"), old("payments"), items, products),
                            rollups.rollups(bookings, payments, items, products))
    changed = {"bookings": bookings, "payments": payments, "delivery_details": deliveries,
               "open_commands": open_, "open_posts": open_posts}
    writes = {name: V.Write(df, "buckets", touched=tuple(touched)) for name, df in changed.items()}
    names = ("bookings", "payments", "delivery_details")
    counted = audit_counts.change({n: old(n) for n in names} | {"booking_items": items},
                                  {n: changed[n] for n in names} | {"booking_items": items}).checkpoint()
    writes["audit_counts"] = _counted(snapshot, counted)
    writes["rejections"] = V.Write(settled.unionByName(lost), "append")
    writes |= {name: V.Write(df) for name, df in rollups.added(stored_rollups(snapshot), change).items()}
    return V.commit(snapshot, version, writes)


def append_requests(snapshot: V.Snapshot, version: str, requests: DataFrame, request_items: DataFrame,
                    as_of=D.DEFAULT_AS_OF) -> V.Snapshot:
    """Price and check booking requests against the stored catalogue and append the accepted ones.

    No committed file of the tables is read but the products, and none is rewritten."""
    done = V.version_of(snapshot.spark, snapshot.root, version)
    if done is not None:
        return done
    ensure_checkpoint_dir(snapshot.spark)
    lines = W.priced_lines(request_items, snapshot.read("products")).checkpoint()
    outcome = W.outcomes_from_lines(requests, lines).checkpoint()
    accepted = W.accepted_ids(outcome)
    bookings = W.booking_rows(requests, accepted, as_of).checkpoint()
    items = W.item_rows(lines, accepted).withColumn("id", F.col("booking_id") * 8 + F.col("line_no"))
    payments = W.payment_rows(bookings)
    rows = {"bookings": bookings, "booking_items": items, "payments": payments,
            "booking_start": bookings, "payment_start": payments,
            "booking_grams": search.postings(bookings, "id", L.search_texts())}
    writes = {name: V.Write(df, "append") for name, df in rows.items()}
    change = rollups.rollups(bookings, payments, items, snapshot.read("products"))
    writes |= {name: V.Write(df) for name, df in rollups.added(stored_rollups(snapshot), change).items()}
    counted = audit_counts.counts({"bookings": bookings, "booking_items": items, "payments": payments}).checkpoint()
    writes["audit_counts"] = _counted(snapshot, counted)
    return V.commit(snapshot, version, writes)


def search_bookings(snapshot: V.Snapshot, pattern: str, status: Optional[str] = None) -> DataFrame:
    """The bookings page for a search text. Of the index the lists of the pattern's trigrams are read, of the
    tables the buckets that hold candidates. A pattern too short for the index scans."""
    spark, clean = snapshot.spark, TX.clean_param(pattern)
    asked = search.asked(spark, clean) if TX.is_set(clean) else search.Asked(())
    if asked.scan:
        return L.booking_list(tables(snapshot), pattern, status)
    ensure_checkpoint_dir(spark)
    lists = snapshot.read("booking_grams", snapshot.touched("booking_grams", search.hashes(spark, asked), "gram_hash"))
    ids = search.candidates(lists, asked).checkpoint()
    held = snapshot.touched("bookings", ids, "id")
    t = Tables(users=lambda: snapshot.read("users"), products=lambda: snapshot.read("products"),
               **{name: (lambda n=name: snapshot.read(n, held)) for name in ("bookings", "booking_items", "payments", "delivery_details")})
    return L.booking_list(t, pattern, status, ids)


def retried(spark: SparkSession, root: str, job: Callable[[V.Snapshot], V.Snapshot], attempts: int = 10) -> V.Snapshot:
    """Run a job on the newest version, again if another commit came first."""
    for left in range(attempts, 0, -1):
        try:
            return job(V.latest(spark, root))
        except V.StaleBase:
            if left == 1:
                raise
    raise ValueError("attempts must be positive")
