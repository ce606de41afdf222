from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from orderdesk.llm import mixing


def shared(sizes: list[int], weights: list[float], cap: float) -> list[float]:
    """Share by weight, stop at the cap, reshare the excess, until none is above."""
    total, target, full = sum(sizes), [0.0] * len(sizes), set()
    while True:
        free = [i for i in range(len(sizes)) if i not in full]
        rest = total - sum(cap * sizes[i] for i in full)
        for i in free:
            target[i] = rest * weights[i] / sum(weights[j] for j in free)
        over = {i for i in free if target[i] > cap * sizes[i] + 1e-9}
        if not over:
            return target
        for i in over:
            target[i] = cap * sizes[i]
        full |= over


@pytest.mark.parametrize("seed", range(4))
def test_targets_match_resharing(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 2, 5, 40, 300, 2000]) for _ in range(rng.randint(1, 12))]
    names = [f"s{i:02d}" for i in range(len(sizes) - 1)] + [None]
    docs = spark.createDataFrame([(i, "w " * n, s) for i, (n, s) in enumerate(zip(sizes, names, strict=True))],
                                 "doc_id long, text string, source string")
    got = {r["__source"]: r for r in mixing.source_targets(docs).collect()}
    want = shared(sizes, [1 + i % 3 for i in range(len(sizes))], 3.0)
    for name, size, target in zip(names, sizes, want, strict=True):
        assert got[name]["__source_size"] == size
        assert got[name]["__target"] == pytest.approx(target)


def test_ranks_are_by_code_point_over_many_partitions(spark):
    names = [f"{chr(65 + i % 50)}{i}" for i in range(400)] + ["é", "Z", "z", None]
    df = spark.createDataFrame([(n,) for n in names], "k string").repartition(7)
    got = [r["k"] for r in mixing.with_rank(df, "k").orderBy("__rank").collect()]
    assert got == [*sorted((n for n in names if n is not None), key=lambda s: s.encode()), None]


def test_copies_are_near_the_rate_and_reruns_agree(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("w w w "), "id").alias("text"),
                                    F.concat(F.lit("s"), F.col("id") % 3).alias("source"))
    rows = mixing.mixed(docs).collect()
    again = mixing.mixed(docs.repartition(5)).collect()
    assert sorted((r["doc_id"], r["__copies"]) for r in rows) == sorted((r["doc_id"], r["__copies"]) for r in again)
    for s in range(3):
        part = [r for r in rows if r["source"] == f"s{s}"]
        rate = part[0]["__target"] / part[0]["__source_size"]
        assert {r["__copies"] for r in part} <= {int(rate), int(rate) + 1}
        assert sum(r["__copies"] for r in part) == pytest.approx(rate * len(part), rel=0.08)
    assert mixing.mix(docs).count() == sum(r["__copies"] for r in rows)


def test_odd_rows(odd, none):
    rows = mixing.mixed(odd).collect()
    assert len(rows) == odd.count() and all(0 <= r["__copies"] <= 3 for r in rows)
    assert mixing.mix(odd).columns == odd.columns
    assert mixing.mixed(none).count() == 0 and mixing.mix(none).count() == 0
    empty = odd.filter("doc_id IN (3, 4, 5)")
    assert [r["__copies"] for r in mixing.mixed(empty).collect()] == [1, 1, 1]
