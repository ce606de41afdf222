from __future__ import annotations

import random

import numpy as np
import pytest

from orderdesk.llm import minhash
from orderdesk.llm.common import read_table
from tests.conftest import SMOKE_DIR


def shingles(text: str | None, size: int) -> frozenset:
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def brute(docs: list[tuple], size: int, percent: int) -> dict:
    sets = {d: shingles(t, size) for d, t in docs}
    label = {d: d for d in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d), find(d) == d) for d in ids}


def check(spark, docs, size=2, percent=80):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, size=size).collect()}
    assert got == brute(docs, size, percent)


def edited(rng, words, share):
    out = list(words)
    for i in rng.sample(range(len(out)), int(share * len(out))):
        out[i] = f"x{rng.randrange(10**6)}"
    return out


def test_families_hubs_and_chains_match_brute_force(spark):
    rng = random.Random(5)
    docs, n = [], 0

    def add(words):
        nonlocal n
        docs.append((n * 7 % 1009, " ".join(words)))
        n += 1
    for size in (6, 30, 120):  # copies at all distances, many below the threshold
        base = [f"w{rng.randrange(5000)}" for _ in range(size)]
        for _ in range(6):
            add(edited(rng, base, rng.choice([0, 0.02, 0.05, 0.08, 0.12])))
    hub = [f"h{i}" for i in range(200)]
    for _ in range(12):  # leaves are near the hub, not near each other
        add(edited(rng, hub, 0.05))
    add(hub)
    chain = [f"c{i}" for i in range(150)]
    for _ in range(4):
        add(chain)
        chain = edited(rng, chain, 0.04)
    for _ in range(20):
        add([f"w{rng.randrange(5000)}" for _ in range(rng.choice([1, 2, 3, 50]))])
    docs += [(2000, ""), (2001, None), (2002, "One"), (2003, "one"), (2004, " \t one two "), (2005, "ONE\x0btwo"), (2006, "one\xa0two")]
    check(spark, docs)


def test_small_blocks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4)
    rng = random.Random(2)
    base = [f"w{i}" for i in range(300)]
    check(spark, [(i, " ".join(edited(rng, base, rng.choice([0.04, 0.06, 0.09])))) for i in range(40)])


def test_blocks_do_not_meet_their_own_component(spark, monkeypatch):
    """60 copies of one component and 4 texts beside it: blocks of 4 move each copy once a bucket, not 15 times."""
    moved = spark.sparkContext.accumulator(0)
    true = minhash._compare

    def compare(*args):
        run = true(*args)

        def counting(batches):
            def seen():
                for batch in batches:
                    for rows in batch.column(3):
                        moved.add(len(rows))
                    yield batch
            return run(seen())
        return counting
    monkeypatch.setattr(minhash, "BLOCK", 4)
    monkeypatch.setattr(minhash, "_compare", compare)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(400)]
    docs = [(i, " ".join(edited(rng, base, 0.01))) for i in range(60)]
    docs += [(100 + i, " ".join(edited(rng, base, 0.085))) for i in range(4)]
    check(spark, docs)
    assert 0 < moved.value < 3000  # 11,782 when each pair of blocks was compared


def test_rows_that_share_an_id_are_judged_by_their_own_text(spark):
    rng = random.Random(4)
    first = [f"w{i}" for i in range(60)]
    texts = {"t1": first, "t2": edited(rng, first, 0.03), "own": [f"z{i}" for i in range(60)]}
    rows = [(1, "t1"), (2, "t2"), (2, "own"), (3, "own"), (3, "t1")]
    df = spark.createDataFrame([(d, " ".join(texts[t]), t) for d, t in rows], "doc_id long, text string, name string").repartition(3)
    got = [tuple(r) for r in minhash.near_duplicates(df, size=2).select("doc_id", "component_id", "kept").collect()]
    assert sorted(got) == [(1, 1, True), (2, 1, False), (2, 2, True), (3, 1, False), (3, 2, False)]
    left = [(r.doc_id, r.name) for r in minhash.deduplicated(df, size=2).collect()]
    assert sorted(left) == [(1, "t1"), (2, "own")]


def test_hashes_that_agree_in_the_kept_half_lose_no_link(spark, monkeypatch):
    """Hashes with few different upper halves, so that the comparison in blocks errs both ways."""
    true = minhash.shingle_hashes

    def coarse(words, size):
        h = true(words, size)
        return np.unique(h & np.uint64(0xFF000000FFFFFFFF))
    monkeypatch.setattr(minhash, "shingle_hashes", coarse)
    monkeypatch.setattr(minhash, "BLOCK", 4)
    rng = random.Random(6)
    bases = [[f"w{k}{i}" for i in range(60)] for k in range(3)]
    check(spark, [(i, " ".join(edited(rng, bases[i % 3], rng.choice([0.02, 0.04, 0.06])))) for i in range(36)])


def test_smoke_table_matches_brute_force(spark):
    docs = [tuple(r) for r in read_table(spark, SMOKE_DIR, "documents").select("doc_id", "text").collect()]
    check(spark, docs)
    check(spark, docs, size=5)


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    for n in (3, 40, 2000):
        agree = []
        for _ in range(30):
            pool = np.unique(rng.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64))
            a, b = pool[: max(1, int(0.9 * n))], pool[int(0.1 * n):]
            agree.append(np.mean(minhash.sketch(a, 256) == minhash.sketch(b, 256)) - len(np.intersect1d(a, b)) / n)
        assert abs(np.mean(agree)) < 0.12


def test_smallest_hashes_estimate_similarity():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 2**63, 1000, dtype=np.int64).astype(np.uint64)) for _ in range(2)]
    few = rng.permutation(sets[0])[:70]  # sets of hashes are random, not the smallest of another set
    sets += [np.sort(s) for s in (rng.permutation(sets[0])[:500], few[:60], few[10:],
                                  np.concatenate([rng.permutation(sets[0])[:900], rng.permutation(sets[1])[:100]]))]
    low = [(s[:minhash.BOTTOM] >> np.uint64(32)).astype(np.uint32) for s in sets]
    ends = np.cumsum([0, *map(len, low)])
    x, y = np.triu_indices(len(sets), 1)
    both, union = minhash.overlaps(np.concatenate(low), ends, np.array(list(map(len, sets))), x, y)
    got = both / union
    want = [len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j])) for i, j in zip(x, y, strict=True)]
    assert np.abs(got - want).max() < 0.15
    assert got[[i for i, p in enumerate(zip(x, y, strict=True)) if p == (3, 4)][0]] == pytest.approx(50 / 70)


def test_odd_rows(odd, none):
    rows = minhash.near_duplicates(odd, size=2).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert (by[2].component_id, by[2].kept, by[10].component_id) == (1, False, 1)
    assert by[3].n_shingles == by[4].n_shingles == by[5].n_shingles == 0 and by[4].kept
    assert all(r.kept and r.component_id is None for r in rows if r.doc_id is None)
    left = minhash.deduplicated(odd, size=2)
    assert left.columns == odd.columns
    assert sorted(r.doc_id for r in left.collect() if r.doc_id) == [1, 3, 4, 5, 6, 7, 8, 9]
    assert minhash.near_duplicates(none).count() == 0 and minhash.deduplicated(none).count() == 0
