"""Bulk jobs against a sequential replay of the web app's rules (one post at a
time, in time order) on random fixtures, including one hot booking that holds
a third of all commands."""

from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal

from orderdesk.operators import workflow as W
from orderdesk.sources import schemas as S

T0 = dt.datetime(2024, 1, 1)
STATUSES = ["pending", "pending", "pending", "approved", "rejected", "delivered", "not_delivered"]
ACTIONS = ["approve", "reject", "delivered", "not_delivered"]


def _random_commands(rng: random.Random, n_bookings: int, n_cmds: int):
    hot = 0
    rows = []
    for cmd_id in range(1, n_cmds + 1):
        booking = hot if rng.random() < 1 / 3 else rng.randrange(n_bookings + 5)  # some unknown bookings
        t = T0 + dt.timedelta(seconds=rng.randrange(n_cmds // 2))  # many equal timestamps
        action = rng.choice(ACTIONS)
        payload = ("Co", f"T{cmd_id}", rng.choice(["", "2024-02-03", "0", "bad"]), "n") if action in W.DELIVERY_ACTIONS \
            else (None, None, None, None)
        rows.append((cmd_id, t, booking, rng.randrange(25), action, *payload))
    return rows


def _replay(initial: dict[int, str], commands):
    state = {b: {"status": s, "acc": None, "store": None, "upd": T0} for b, s in initial.items()}
    rejected = set()
    for cmd_id, t, b, actor, action, _co, _trk, date, _notes in sorted(commands, key=lambda r: (r[1], r[0])):
        row = state.get(b)
        if action in W.REVIEW_ACTIONS and row and row["status"] == "pending":
            row.update(status="approved" if action == "approve" else "rejected", acc=actor, upd=t)
        elif action in W.DELIVERY_ACTIONS and row and row["status"] == "approved" and date != "bad":
            # A refused date rolls the whole delivery back.
            row.update(status=action, store=actor, upd=t)
        else:
            rejected.add(cmd_id)
    return state, rejected


def test_workflow_matches_sequential_replay(spark):
    rng = random.Random(7)
    n = 200
    initial = {b: rng.choice(STATUSES) for b in range(n)}
    bookings = spark.createDataFrame(
        [(b, "C", "+1 555 0000000", "A", "Cash on Delivery", Decimal("1.00"), s, 1, None, None, T0, T0)
         for b, s in initial.items()], S.BOOKINGS)
    commands = _random_commands(rng, n, 3000)
    cmd_df = spark.createDataFrame(commands, S.WORKFLOW_COMMANDS)
    expect, expect_rejected = _replay(initial, commands)
    got = {r["id"]: r for r in W.workflow_state(bookings, cmd_df).collect()}
    assert set(got) == set(expect)
    for b, e in expect.items():
        g = got[b]
        assert (g["status"], g["accountant_id"], g["storeman_id"], g["updated_at"]) == (
            e["status"], e["acc"], e["store"], e["upd"]), b
    got_rejected = {r["cmd_id"] for r in W.workflow_rejections(bookings, cmd_df).collect()}
    assert got_rejected == expect_rejected


def test_payment_updates_match_sequential_replay(spark):
    rng = random.Random(11)
    ids = list(range(60))
    have_row = [b for b in ids if rng.random() < 0.8]
    payments = spark.createDataFrame(
        [(b, b, "pending", None, None, None, None, None, T0, T0) for b in have_row], S.PAYMENTS)
    ups = []
    for cmd_id in range(1, 801):
        b = 0 if rng.random() < 1 / 3 else rng.choice(ids)
        ups.append((cmd_id, T0 + dt.timedelta(seconds=rng.randrange(300)), b, rng.randrange(25),
                    rng.choice(["paid", "pending", "failed", "", "refunded", " paid "]),
                    rng.choice(["Card", "Cash"]), f"X{cmd_id}", rng.choice(["", "2024-05-06", "0", "bad"]),
                    rng.choice(["ok", "<i>x</i>"])))
    up_df = spark.createDataFrame(ups, S.PAYMENT_UPDATES)
    state = {b: ("pending", None, None) for b in have_row}
    for cmd_id, t, b, actor, st, method, txn, date, notes in sorted(ups, key=lambda r: (r[1], r[0])):
        st = st.strip()
        if st not in ("pending", "paid", "failed") or b not in state or date == "bad":
            continue
        state[b] = (st, None if date in ("", "0") else dt.date.fromisoformat(date), actor)
    got = {r["booking_id"]: (r["payment_status"], r["payment_date"], r["updated_by"])
           for r in W.payment_updates_applied(payments, up_df).collect()}
    assert got == state


PRODUCTS = {1: ("Wireless Headphones", Decimal("99.99"), 50), 2: ("Smartphone Case", Decimal("19.99"), 100),
            3: ("Bluetooth Speaker", Decimal("79.99"), 30), 4: ("USB Cable", Decimal("9.99"), 200)}


def _php_create_booking(header, lines):
    """The create-booking handler, one request at a time."""
    if any(v is None or v.strip() in ("", "0") for v in header):
        return "rejected", W.MSG_MISSING_CUSTOMER, None
    if not lines:
        return "rejected", W.MSG_NO_ITEMS, None
    total, valid = Decimal("0"), 0
    for _, pid, qty in sorted(lines, key=lambda x: (x[0], x[1] if x[1] is not None else -1,
                                                     x[2] if x[2] is not None else -1)):
        if not pid or not qty or qty <= 0:
            continue
        if pid not in PRODUCTS:
            return "rejected", W.MSG_INVALID_PRODUCT, None
        name, price, stock = PRODUCTS[pid]
        if stock < qty:
            return "rejected", f"Insufficient stock for {name}. Available: {stock}, Requested: {qty}", None
        total += price * qty
        valid += 1
    if not valid:
        return "rejected", W.MSG_NO_VALID_ITEMS, None
    name, phone, _address, ptype = (v.strip() for v in header)
    if len(name) > 100:
        return "rejected", W.MSG_DB_NAME, None
    if len(phone) > 20:
        return "rejected", W.MSG_DB_PHONE, None
    if ptype not in ("Online Paid", "Cash on Delivery"):
        return "rejected", W.MSG_DB_PAYMENT_TYPE, None
    return "accepted", None, float(total)


def test_price_requests_match_handler(spark, golden):
    rng = random.Random(3)
    reqs, items = [], []
    for rid in range(1, 400):
        header = [rng.choice(["x", "x", "x", "", "0", " "]) if rng.random() < 0.1 else "x" for _ in range(3)]
        header.append(rng.choice(["Online Paid", "Cash on Delivery", "Cash on Delivery", "Card", ""]))
        if rng.random() < 0.05:
            header[1] = "+1 (555) 000-0000 ext 12"  # longer than the phone column
        reqs.append((rid, *header, 1))
        n = 0 if rng.random() < 0.05 else rng.randrange(1, 5)
        for ln in range(1, n + 1):
            items.append((rid, ln, rng.choice([1, 2, 3, 4, 99, 0, None]), rng.choice([1, 2, 20, 31, 0, -1, None])))
    req_df = spark.createDataFrame(reqs, S.BOOKING_REQUESTS)
    item_df = spark.createDataFrame(items, S.BOOKING_REQUEST_ITEMS)
    got = {r["request_id"]: (r["outcome"], r["message"], r["amount"])
           for r in W.price_requests(req_df, item_df, golden.products).collect()}
    by_req: dict[int, list] = {}
    for rid, ln, pid, qty in items:
        by_req.setdefault(rid, []).append((ln, pid, qty))
    for rid, *header, _ in reqs:
        assert got[rid] == _php_create_booking(header, by_req.get(rid, [])), rid
