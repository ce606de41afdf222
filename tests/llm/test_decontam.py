from __future__ import annotations

import random

from orderdesk.llm import decontam


def table(pattern: str, text: str) -> list[int]:
    """Distance of the pattern to the best substring that ends at each character."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d)))
        row = new
    return row[1:]


def test_bit_parallel_distance_is_the_table_distance():
    rng = random.Random(3)
    for _ in range(200):
        p = "".join(rng.choice("abé ") for _ in range(rng.randint(1, 80)))
        t = "".join(rng.choice("abé ") for _ in range(rng.randint(0, 90)))
        assert list(decontam.distances(decontam.char_masks(p), len(p), t)) == table(p, t)


def changed(rng: random.Random, text: str, edits: int) -> str:
    chars = list(text)
    for _ in range(edits):
        i = rng.randrange(len(chars))
        rng.choice([lambda: chars.pop(i), lambda: chars.insert(i, "q"), lambda: chars.__setitem__(i, "z")])()
    return "".join(chars)


def cases(seed: int = 1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    items = [(i, " ".join(word() for _ in range(rng.randint(2, 40)))) for i in range(12)]
    docs = []
    for n in range(60):
        body = [word() for _ in range(rng.randint(0, 60))]
        if n % 2:
            text = rng.choice(items)[1]
            body.insert(rng.randint(0, len(body)), changed(rng, text, rng.randint(0, int(0.12 * len(text)))).upper().replace(" ", "\n  "))
        docs.append((n, " ".join(body)))
    return docs, items


def test_hits_match_the_table_distance(spark):
    docs, items = cases()
    want = set()
    for d, text in docs:
        body = decontam.normalized(text)
        for i, item in items:
            best = min(table(decontam.normalized(item), body), default=10**9)
            if body and best <= int(len(decontam.normalized(item)) * decontam.ERROR_RATE):
                want.add((d, i, best))
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    for slice_bytes in (1 << 20, 300):
        rows = decontam.contaminations(d, b, slice_bytes=slice_bytes).collect()
        assert {(r.doc_id, r.item_id, r.distance) for r in rows} == want
    texts, item = dict(docs), dict(items)
    for r in rows:
        part = decontam.normalized(texts[r.doc_id])[r.start:r.end]
        body = decontam.normalized(item[r.item_id])
        assert list(decontam.distances(decontam.char_masks(body), len(body), part, True))[-1] == r.distance
    left = {r.doc_id for r in decontam.decontaminated(d, b).collect()}
    assert left == set(texts) - {x[0] for x in want}


def test_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "  "), (None, "zeta eta theta iota"), (4, "ZETA  ETA\ntheta iota")],
                                  "item_id long, text string")
    rows = decontam.contaminations(odd, items).collect()
    assert len(rows) == 2 * 5 and {r.item_id for r in rows} == {None, 4} and {r.distance for r in rows} == {0}
    left = decontam.decontaminated(odd, items)
    assert left.columns == odd.columns and left.count() == odd.count() - 5
    assert decontam.contaminations(none, items).count() == 0
    assert decontam.contaminations(odd, items.limit(0)).count() == 0
    assert decontam.decontaminated(odd, items.limit(0)).count() == odd.count()


def test_slices_leave_one_by_one(spark, monkeypatch):
    """Many slices: never two broadcasts alive, the same hits, and rows are dropped by text alone."""
    docs, items = cases(5)
    items += [(100 + i, t.upper()) for i, t in items[:3]]  # equal items under other ids
    d = spark.createDataFrame(docs + docs[:5], "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string").repartition(2)
    alive, most, make = set(), [0], spark.sparkContext.broadcast

    def counted(value):
        held = make(value)
        alive.add(id(held))
        most[0] = max(most[0], len(alive))
        destroy = held.destroy
        held.destroy = lambda *a: (alive.discard(id(held)), destroy(*a))
        return held
    want = sorted(map(tuple, decontam.contaminations(d, b).collect()))
    left = sorted(map(tuple, decontam.decontaminated(d, b).collect()))
    monkeypatch.setattr(spark.sparkContext, "broadcast", counted)
    assert sorted(map(tuple, decontam.contaminations(d, b, slice_bytes=150).collect())) == want
    assert sorted(map(tuple, decontam.decontaminated(d, b, slice_bytes=150).collect())) == left
    assert most[0] == 1 and not alive and len(want) > 20


def test_short_items(spark):
    items = spark.createDataFrame([(1, "a"), (2, "cat dog"), (3, " \t"), (4, None), (5, "he is")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a cat, a CAT   dog."), (2, "the concat dogma"), (3, "cat dogs, cat dog"), (4, "she is"), (5, "(he is)")],
                                 "doc_id long, text string")
    rows = decontam.contaminations(docs, items).collect()
    assert {(r.doc_id, r.item_id, r.start) for r in rows} == {(1, 2, 9), (3, 2, 10), (5, 5, 1)}
    assert sorted(r.item_id for r in decontam.skipped(items).collect()) == [1, 3, 4]
    assert {r.doc_id for r in decontam.decontaminated(docs, items).collect()} == {2, 4}
