from __future__ import annotations

import numpy as np
import pytest

from orderdesk.llm import embeddings


def brute(rows, threshold=0.95):
    units = {}
    for i, v in rows:
        a = np.array([np.nan if x is None else x for x in (v or [])], float)
        units.setdefault(i, a / np.abs(a).max() if len(a) and np.isfinite(a).all() and np.abs(a).max() > 0 else None)
    label, n = {i: i for i in units}, dict.fromkeys(units, 0)

    def find(x):
        while label[x] != x:
            x = label[x]
        return x
    ids = sorted(units)
    for k, i in enumerate(ids):
        for j in ids[k + 1:]:
            a, b = units[i], units[j]
            if a is None or b is None or len(a) != len(b) or a @ b / np.linalg.norm(a) / np.linalg.norm(b) < threshold:
                continue
            n[i] += 1
            n[j] += 1
            x, y = find(i), find(j)
            label[max(x, y)] = min(x, y)
    return {i: (n[i], find(i)) for i in ids}


def test_links_match_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for dim in (2, 16, 64):
        for _ in range(12):
            centre = rng.normal(size=dim)
            for _ in range(rng.integers(1, 9)):
                rows.append([float(x) for x in centre + rng.choice([0, 0.1, 0.2, 0.3]) * rng.normal(size=dim)])
    rows += [rows[0]] * 20 + [[2 * x for x in rows[0]], [1e200 * x for x in rows[1]], None, [], [0.0, 0.0], [None, 1.0],
                              [float("nan"), 1.0], [float("inf"), 1.0]]
    order = rng.permutation(len(rows))
    rows = [(int(order[k]), v) for k, v in enumerate(rows)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(df).collect()}
    assert got == brute(rows)


def test_nearest_lattice_point():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 8)) * 2
    p = embeddings.nearest_e8(x)
    twice = np.rint(2 * p)
    assert np.allclose(2 * p, twice) and (np.ptp(twice % 2, axis=1) == 0).all() and (p.sum(axis=1) % 2 == 0).all()
    step = ((x[:, None] - (p[:, None] + embeddings.ROOTS)) ** 2).sum(axis=2).min(axis=1)
    assert (((x - p) ** 2).sum(axis=1) <= step + 1e-12).all()
    assert embeddings.ROOTS.shape == (240, 8) and np.allclose((embeddings.ROOTS ** 2).sum(axis=1), 2)


@pytest.mark.parametrize("leaders", [100, 10**6])
def test_plan_reaches_the_recall(leaders):
    plan = embeddings.plan_for(leaders)
    rng = np.random.default_rng(9)
    a = rng.normal(size=(300, 48))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=(300, 48))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    b = 0.95 * a + np.sqrt(1 - 0.95 ** 2) * b
    ha, va = embeddings.cells(a, plan)
    hb, vb = embeddings.cells(b, plan)
    met = [bool(set(ha[k]) & (set(hb[k]) | set(vb[k])) or set(hb[k]) & set(va[k])) for k in range(300)]
    assert np.mean(met) >= 0.99
    bits = [bin(int(x) & (2**64 - 1)).count("1") for x in embeddings.sketches(a) ^ embeddings.sketches(b)]
    assert max(bits) <= plan.sketch_distance


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 5), (1, [1.0, 0.0], 5), (None, [1.0, 0.0], 6), (2, [1.0, 0.1], 7), (3, None, 8)],
                               "vec_id long, embedding array<double>, label int")
    rows = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect()), key=str)
    assert rows == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 0, None, True), (2, 2, 1, False), (3, 0, 3, True)], key=str)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0
    assert embeddings.near_duplicates(df.filter("embedding IS NULL")).count() == 1
