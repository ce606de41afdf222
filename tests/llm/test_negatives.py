from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from orderdesk.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=2, n_positives=5, n_negatives=10):
    """Every window scanned on its own, in Python integers."""
    usable = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        usable[i, label, tuple(math.floor(256 * float(x)) for x in v)] = None
    out = []
    for i, label, v in usable:
        if i % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), j, k) for j, k, w in usable)
        positives = [(s, j) for s, j, k in scored if k == label and j != i][:n_positives]
        for p, j in positives:
            found = [(s, k) for s, k, kind in scored if kind != label and 3 * -p <= 10 * -s <= 9 * -p][:n_negatives]
            out += [(i, j, r, k, -p, -s) for r, (s, k) in enumerate(found, 1)]
    return sorted(out)


def mined(df, **more):
    got = negatives.hard_negatives(df, F.col("__id") % 2 == 0, **more).collect()
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in got)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 16)
    monkeypatch.setattr(negatives, "STRIP", 3)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(4, 6))
    rows = []
    for i in range(90):
        c = int(rng.integers(0, 4))
        v = np.float32(np.round(centres[c] + rng.normal(size=6) * rng.choice([0.2, 1.0, 2.0]), 1))  # coarse: many ties
        rows.append((i, [float(x) for x in v], int(rng.choice([c, c, 0]))))
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = brute(rows)
    assert mined(df) == want and len({w[0] for w in want}) > 20
    assert mined(df, n_positives=2, n_negatives=3) == brute(rows, n_positives=2, n_negatives=3)


def test_windows_that_overlap(spark):
    """Windows with equal, nested and empty ranges: scores stand on a line, so that every limit is hit exactly."""
    rows = [(0, [1.0], 0)] + [(i, [x], 0) for i, x in [(1, 10.0), (3, 9.0), (5, 5.0), (7, 0.5), (9, -1.0), (11, 10.0)]]
    rows += [(100 + k, [k / 4], 1) for k in range(-4, 60)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = [r for r in mined(df) if r[0] == 0]
    assert got == [r for r in brute(rows) if r[0] == 0]
    assert {r[1] for r in got} == {1, 3, 5, 7, 11}


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0], 0), (0, [1.0, 2.0], 0), (0, [2.0, 1.0], 0), (1, [1.0, 1.0], 0), (1, [1.0, 1.0], 0), (2, [0.5, 0.5], 1),
            (2, [0.5, 0.5], 1), (3, None, 0), (4, [], 0), (5, [None, 1.0], 1), (6, [float("nan"), 1.0], 1),
            (7, [float("inf"), 1.0], 1), (8, [1.0, 1.0], None), (None, [1.0, 1.0], 0), (9, [0.5], 1), (10, [0.4, 0.6, 3.0], 1)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", rank int, `a.b` string").repartition(3)
    assert mined(df) == brute(rows) and mined(df)
    assert mined(df.limit(0)) == []
    assert mined(df.filter("embedding IS NULL")) == []
    assert mined(df.filter("label = 0")) == []


def test_products_stay_exact():
    big = np.array([[2**40, 3], [-(2**62), 1]])
    assert negatives.products(big, big)[0, 0] == 2**63 - 1  # held within a long
    assert negatives.products(np.array([[2**30, 1]]), np.array([[2**30, 1]]))[0, 0] == 2**60 + 1
    slots, least = negatives.limits(np.array([10**18 + 7, 11, 10, -5, 0]))
    assert list(slots) == [-5, 0, 9, 9 * 10**17 + 6] and list(least) == [-1, 0, 3, 3 * 10**17 + 3]


def test_tasks_hand_on_only_the_first_rows(spark):
    rows = spark.range(4000).selectExpr("id AS vec_id", "array(CAST(rand(1) AS FLOAT)) AS embedding", "CAST(id % 2 AS INT) AS label")
    plan = negatives.hard_negatives(rows, F.col("__id") % 100 == 0)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_no_pair_of_blocks_is_lost(spark, monkeypatch):
    """Both halves of a pair of blocks come to one task, also when the shuffle keeps several partitions."""
    monkeypatch.setattr(negatives, "LEAST_BLOCK", 16)
    monkeypatch.setattr(negatives, "BLOCK", 32)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=4))], int(rng.integers(0, 3))) for i in range(160)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    coalescing = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalescing, "false")
    try:
        assert mined(df) == brute(rows)
    finally:
        spark.conf.set(coalescing, "true")
