from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from orderdesk.llm import sharding


def places(spark, tree, n=20000):
    return dict(spark.range(n).select("id", sharding.shard_of(F.col("id"), tree).alias("s")).collect())


def test_one_more_shard_takes_rows_only_into_itself(spark):
    before, after = places(spark, sharding.uniform_tree(40)), places(spark, sharding.uniform_tree(41))
    moved = [k for k in before if before[k] != after[k]]
    assert {after[k] for k in moved} == {40}
    assert len(moved) == pytest.approx(20000 / 41, rel=0.2)
    counts = Counter(before.values())
    assert sorted(counts) == list(range(40)) and max(counts.values()) < 1.35 * 500 and min(counts.values()) > 0.65 * 500


def test_movement_stays_in_the_subtree_whose_weight_changes(spark):
    before = places(spark, sharding.uniform_tree(40))
    after = places(spark, sharding.uniform_tree(40, weights={12: 3.0}))
    for k in before:
        if before[k] != after[k]:
            assert after[k] // 10 == 1  # into the region of shard 12 or within it
            if before[k] // 10 == 1 and before[k] // 5 != 2:
                assert after[k] // 5 == 2  # within the region only into its rack
            if before[k] // 5 == 2:
                assert after[k] == 12  # within the rack only into the shard
    counts = Counter(after.values())
    assert counts[12] == pytest.approx(20000 * 3 / 42, rel=0.15)


@pytest.mark.parametrize("per_range", [10, 50_000])
def test_slots_are_gapless(spark, per_range):
    docs = spark.range(3000).select((F.col("id") % 2500).alias("doc_id"), F.concat(F.lit("t é "), "id").alias("text"))
    rows = sharding.shard_table(docs, rows_per_range=per_range).collect()
    for s in range(40):
        slots = sorted(r["__slot"] for r in rows if r["__shard"] == s)
        assert slots == list(range(len(slots)))
    texts = {(r.doc_id, zlib.crc32(r.text.encode()), len(r.text.encode()) + 16) for r in docs.collect()}
    assert {(r["doc_id"], r["__crc32"], r["__size"]) for r in rows} == texts


def test_odd_rows(odd, none):
    rows = sharding.shard_table(odd).collect()
    assert len(rows) == odd.count()
    assert {(r["__size"], r["__crc32"]) for r in rows if r["doc_id"] in (3, 4)} == {(16, 0)}
    assert len({r["__shard"] for r in rows if r["doc_id"] is None}) == 1
    assert sharding.shard_table(none).count() == 0


def drawn(key, tree):
    """The tree descended in plain Python: xxhash64 of the key (if any) and the child's name, lowest -ln(u) / weight."""
    node = ""
    while node in tree:
        def score(child):
            name, weight = child
            seed = 42 if key is None else xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), seed=42)
            u = ((xxhash.xxh64_intdigest(name.encode(), seed=seed) >> 11) + 0.5) / 2**53
            return -math.log(u) / weight, name
        node = min(map(score, tree[node]))[1]
    return int(node)


def test_shards_match_plain_draws(spark):
    rng = random.Random(3)
    rows = [(rng.randint(-2**62, 2**62), "é" * rng.randint(0, 3)) for _ in range(1500)] + [(k, None) for k in range(300)] + [(None, ""), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for n in (40, 7):
        got = [tuple(r) for r in sharding.placed(df, n_shards=n).select("doc_id", "text", "__shard", "__grown_shard", "__size", "__crc32").collect()]
        assert sorted(got, key=str) == sorted(
            ((k, t, drawn(k, sharding.uniform_tree(n)), drawn(k, sharding.uniform_tree(n + 1)), len((t or "").encode()) + 16,
              zlib.crc32((t or "").encode())) for k, t in rows), key=str)
    tree = sharding.uniform_tree(12, weights={3: 2.5, 11: 0.25})
    got = dict(df.filter("doc_id IS NOT NULL").select("doc_id", sharding.shard_of(F.col("doc_id"), tree)).collect())
    assert got == {k: drawn(k, tree) for k, _ in rows if k is not None}


def test_slots_number_each_shard_without_gaps(spark):
    rows = [(k % 500, "t" * (k % 3)) for k in range(2000)] + [(7, "same")] * 600  # repeated ids and rows
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    out = sharding.shard_table(df, n_shards=5, rows_per_range=40).collect()
    slots = defaultdict(list)
    for r in out:
        slots[r["__shard"]].append(r["__slot"])
    assert len(out) == len(rows) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert Counter(r["__shard"] for r in out) == Counter(drawn(k, sharding.uniform_tree(5)) for k, _ in rows)
