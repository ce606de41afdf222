"""The store: batches in any order end in one state, touch their buckets only,
and keep the dashboards' rollups equal to a full scan."""

from __future__ import annotations

import random
import threading

import pytest
from pyspark.sql import functions as F

from orderdesk.catalog import tables_for
from orderdesk.operators import audit_counts
from orderdesk.operators import audits as A
from orderdesk.operators import fold, rollups
from orderdesk.operators import workflow as W
from orderdesk.plans import reports as R
from orderdesk.plans import store
from orderdesk.sources import schemas as S
from orderdesk.sources import versions as V

from .conftest import SMOKE_DIR
from .test_bruteforce import STATUSES, T0, _random_commands, _replay
from .test_versions import explain, files, rows

DASHBOARDS = {
    "booking_stats": R.booking_stats, "booking_stats_full": R.booking_stats_full, "delivery_stats": R.delivery_stats,
    "payment_stats": R.payment_stats, "dash_accountant": R.dash_accountant, "revenue_overview": R.revenue_overview,
    "monthly_revenue": R.monthly_revenue, "payment_type_stats": R.payment_type_stats}


def same(a, b):
    return a.columns == b.columns and [str(x) for x in rows(a)] == [str(x) for x in rows(b)]


def assert_dashboards(snap):
    t, r = store.tables(snap), store.stored_rollups(snap)
    for name, scan in DASHBOARDS.items():
        assert same(getattr(rollups, name)(r), scan(t)), name
    assert same(rollups.top_products(r, t.products), R.top_products(t))
    c = snap.read("audit_counts")
    assert same(audit_counts.audit_unique(c), A.audit_unique(t)) and same(audit_counts.audit_fk(c), A.audit_fk(t))
    assert same(audit_counts.audit_stock(c, t.products), A.audit_stock(t))
    months = ["2001-01", "2001-05", "2001-06"]
    some = t.replace(payments=t.payments.filter(F.date_format("payment_date", "yyyy-MM").isin(months)))
    assert same(rollups.top_products(r, t.products, months=months), R.top_products(some))
    for moderator in (1, 3):
        assert same(rollups.dash_moderator(r, t.products, moderator), R.dash_moderator(t, moderator))


@pytest.fixture(scope="module")
def small(spark):
    """Part of the driver's bookings, so that batches can be many."""
    t = tables_for(spark, SMOKE_DIR)
    keep = F.col("id") % 7 == 1
    b = t.bookings.filter(keep).cache()
    return t.replace(bookings=b, payments=t.payments.filter(F.col("booking_id") % 7 == 1),
                     delivery_details=t.delivery_details.filter(F.col("booking_id") % 7 == 1),
                     booking_items=t.booking_items.filter(F.col("booking_id") % 7 == 1))


def test_open_commands_fold_like_all_commands(spark):
    """Random batches in random order, against a replay of all commands in time order."""
    rng = random.Random(12)
    n = 60
    initial = {b: rng.choice(STATUSES) for b in range(n)}
    start = spark.createDataFrame([(b, s, None, None, T0) for b, s in initial.items()],
                                  "id long, status string, accountant_id long, storeman_id long, updated_at timestamp_ntz")
    commands = _random_commands(rng, n, 500)
    expect, lost = _replay(initial, commands)
    for k in (1, 3, 5):
        dealt = [[] for _ in range(k)]
        for c in commands:  # late commands: batches are not in time order
            rng.choice(dealt).append(c)
        held, settled = None, set()
        for batch in dealt:
            df = spark.createDataFrame(batch, S.WORKFLOW_COMMANDS)
            batches = [df] if held is None else [held, df]
            settled |= {r.cmd_id for r in fold.settled_commands(start, *batches).collect()}
            held = fold.open_commands(start, *batches).checkpoint()
        got = {r["id"]: (r.status, r.accountant_id, r.storeman_id, r.updated_at) for r in W.workflow_state(start, held).collect()}
        assert got == {b: (e["status"], e["acc"], e["store"], e["upd"]) for b, e in expect.items()}
        assert settled <= lost and settled | {r.cmd_id for r in W.workflow_rejections(start, held).collect()} == lost
        assert held.count() < len(commands) / 2
        assert rows(fold.open_commands(start, held, held)) == rows(held)


def test_batches_equal_one_fold(spark, small, tmp_path):
    """Any split of commands and posts into batches, in any order, leaves the tables of one fold."""
    rng = random.Random(3)
    ids = [r["id"] for r in small.bookings.select("id").collect()]
    commands = [(c[0], c[1], rng.choice(ids[:40]), *c[3:]) for c in _random_commands(rng, 10, 300)]
    posts = [(k, T0.replace(minute=rng.randrange(60)), rng.choice([*ids[20:60], -5]), 3, rng.choice(["paid", "pending", "failed", "no"]), "Card",
              f"X{k}", rng.choice(["", "2001-06-15", "2001-05-02", "bad"]), "n") for k in range(1000, 1120)]
    whole = store.apply_batch(store.create(spark, small, str(tmp_path / "one"), 8), "all",
                              spark.createDataFrame(commands, S.WORKFLOW_COMMANDS), spark.createDataFrame(posts, S.PAYMENT_UPDATES))
    rng.shuffle(commands)
    rng.shuffle(posts)
    snap = store.create(spark, small, str(tmp_path / "many"), 8)
    for k in range(3):
        snap = store.apply_batch(snap, f"v{k}", spark.createDataFrame(commands[k::3], S.WORKFLOW_COMMANDS) if k != 1 else
                                 spark.createDataFrame(commands[k::3] + commands[:9], S.WORKFLOW_COMMANDS),  # some again
                                 spark.createDataFrame(posts[k::3], S.PAYMENT_UPDATES))
        assert_dashboards(snap)
    for name in ("bookings", "payments", "delivery_details"):
        assert rows(snap.read(name)) == rows(whole.read(name)), name
    want = W.workflow_state(small.bookings, spark.createDataFrame(commands, S.WORKFLOW_COMMANDS))
    assert rows(snap.read("bookings").select("id", "status")) == rows(want.select("id", "status"))
    assert {r.cmd_id for r in store.rejected(snap).collect()} == {r.cmd_id for r in store.rejected(whole).collect()}


def test_only_touched_buckets_change(spark, small, tmp_path):
    root = str(tmp_path)
    first = store.create(spark, small, root, 16)
    one = small.bookings.filter("status = 'pending'").first()["id"]
    before = files(root)
    cmds = spark.createDataFrame([(1, T0, one, 4, "approve", None, None, None, None)], S.WORKFLOW_COMMANDS)
    second = store.apply_batch(first, "v1", cmds)
    assert all(files(root)[f] == at for f, at in before.items())
    for name in ("bookings", "payments", "delivery_details"):
        old, new = set(first.tables[name].parts), set(second.tables[name].parts)
        assert len(old - new) <= 1 and len(new - old) <= 1 and len(old & new) >= 10
    text = explain(first.read("bookings", first.touched("bookings", cmds, "booking_id")))
    assert "PartitionFilters" in text and text.count(f"{V.BUCKET}=") == 1  # one folder of sixteen is listed
    # As the full outer join over the whole table has it.
    state = W.workflow_state(small.bookings, cmds)
    assert rows(second.read("bookings")) == rows(W.bookings_after(small.bookings, state))
    assert second.read("bookings").filter(F.col("id") == one).first()["status"] == "approved"
    for df, table in ((rollups.revenue_overview(store.stored_rollups(second)), "payment_days"),
                      (rollups.top_products(store.stored_rollups(second), second.read("products")), "product_months")):
        plan = explain(df)
        assert f"/{table}/" in plan and "/bookings/" not in plan and "/payments/" not in plan and "/booking_items/" not in plan


def test_appended_requests(spark, small, tmp_path):
    t = tables_for(spark, SMOKE_DIR)
    snap = store.create(spark, small, str(tmp_path), 8)
    before = files(str(tmp_path))
    new = F.col("request_id") % 7 == 3  # ids that are not stored yet
    requests, items = t.booking_requests.filter(new), t.booking_request_items.filter(new)
    snap = store.append_requests(snap, "v1", requests, items)
    assert all(files(str(tmp_path))[f] == at for f, at in before.items())
    assert_dashboards(snap)
    want = W.new_bookings(requests, items, t.products)
    assert snap.read("bookings").count() == small.bookings.count() + want.count() > small.bookings.count()
    some = [r["id"] for r in want.limit(5).collect()]
    cmds = spark.createDataFrame([(k, T0, b, 4, "approve", None, None, None, None) for k, b in enumerate(some)], S.WORKFLOW_COMMANDS)
    snap = store.apply_batch(snap, "v2", cmds)
    assert_dashboards(snap)
    assert snap.read("bookings").filter(F.col("id").isin(some) & (F.col("status") == "approved")).count() == 5


def test_jobs_at_the_same_time_all_count(spark, small, tmp_path):
    root = str(tmp_path)
    store.create(spark, small, root, 4)
    ids = [r["id"] for r in small.bookings.filter("status = 'pending'").limit(3).collect()]

    def job(k):
        cmds = spark.createDataFrame([(k, T0, ids[k], 4, "approve", None, None, None, None)], S.WORKFLOW_COMMANDS)
        store.retried(spark, root, lambda snap: store.apply_batch(snap, f"job {k}", cmds))
    threads = [threading.Thread(target=job, args=(k,)) for k in range(3)]
    for th in threads:
        th.start()
    for th in threads:
        th.join()
    snap = V.latest(spark, root)
    assert snap.number == 4
    assert snap.read("bookings").filter(F.col("id").isin(ids) & (F.col("status") == "approved")).count() == 3
    assert_dashboards(snap)


def test_rollups_add_and_retract(spark, golden):
    parts = [golden.bookings.filter(F.col("id") % 2 == k) for k in (0, 1)]
    rest = (golden.payments, golden.booking_items, golden.products.filter("id != 2"))  # an unknown product
    one, two = (rollups.rollups(p, *rest) for p in parts)
    whole = rollups.rollups(golden.bookings, *rest)
    for name in rollups.GROUPS:
        assert rows(rollups.added(one, two)[name]) == rows(whole[name]) == rows(rollups.added(two, one)[name])
        assert rows(rollups.added(whole, rollups.change(two, {n: d.limit(0) for n, d in two.items()}))[name]) == rows(one[name])
