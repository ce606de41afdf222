from __future__ import annotations

import random
import time
from collections import Counter, defaultdict

from orderdesk.llm import lines, queries
from orderdesk.llm.common import read_table
from tests.conftest import SMOKE_DIR


def blank(line):
    return not line.strip(" \t\r\x0b\x0c")


def runs(docs):
    """(id, first line, lines) of every chunk, by bytes; ``docs``: distinct (id, text), in order."""
    split = [(d, t.split("\n")) for d, t in docs if t is not None]
    seen = Counter(w for _, part in split for w in zip(part, part[1:], strict=False) if not (blank(w[0]) and blank(w[1])))
    for n, (d, part) in enumerate(split):
        start = None
        for i in range(len(part)):
            joined = i + 1 < len(part) and seen[part[i], part[i + 1]] > 1
            if joined and start is None:
                start = i
            if not joined and start is not None:
                yield n, start, tuple(part[start:i + 1])
                start = None


def brute(docs):
    """Chunks that equal an earlier one or lie inside a longer one go."""
    order = sorted({r for r in docs if r[1] is not None}, key=lambda r: (r[0] is not None, r[0] or 0))
    found = list(runs(order))
    gone = defaultdict(set)
    for k, (n, at, chunk) in enumerate(found):
        def inside(other, chunk=chunk):
            return len(other) > len(chunk) and any(other[i:i + len(chunk)] == chunk for i in range(len(other)))
        if sum(not blank(x) for x in chunk) >= lines.MIN_LINES and (
                any(c == chunk for _, _, c in found[:k]) or any(inside(c) for _, _, c in found)):
            gone[n] |= set(range(at, at + len(chunk)))
    out = {None: (None, 0)}
    for n, (d, t) in enumerate(order):
        kept = [x for i, x in enumerate(t.split("\n")) if i not in gone[n]]
        out[d, t] = ("\n".join(kept), len(gone[n]))
    return out


def assert_nothing_is_lost(before, after):
    """Every run of lines that occurs twice in the input occurs in the output (runs of blank lines excepted)."""
    def all_runs(texts, size):
        return Counter(tuple(part[i:i + size]) for t in texts if t is not None for part in [t.split("\n")]
                       for i in range(len(part) - size + 1))
    size, many = 2, 1
    while many:
        here = {r for r, n in all_runs(before, size).items() if n > 1 and not any(
            blank(a) and blank(b) for a, b in zip(r, r[1:], strict=False))}
        assert here <= set(all_runs(after, size))
        size, many = size + 1, len(here)


def check(spark, docs, exact=True):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = lines.deduplicated(df).collect()
    assert len(got) == len(docs) and Counter(r.doc_id for r in got) == Counter(d for d, _ in docs)
    assert_nothing_is_lost({t for _, t in docs} | {f"{t}" for _, t in docs if t is not None}, [r.text for r in got])
    if exact:
        want = brute(docs)
        assert Counter((r.doc_id, r.text, sum(x["lines"] for x in r["__removed"])) for r in got) == Counter(
            (d, *(want[d, t] if t is not None else (None, 0))) for d, t in docs)
    return {r.doc_id: r.text for r in got}


def test_overlapping_repeats_are_kept_somewhere(spark):
    assert check(spark, [(1, "B\nC"), (2, "A\nB\nC"), (3, "A\nB")]) == {1: "", 2: "A\nB\nC", 3: ""}
    assert check(spark, [(1, "x\nx\nx"), (2, "x\nx")]) == {1: "x\nx\nx", 2: ""}
    got = check(spark, [(1, "one\n\n\ntwo"), (2, "three\n\n\nfour"), (3, "\n\n")])
    assert got == {1: "one\n\n\ntwo", 2: "three\n\n\nfour", 3: "\n\n"}


def test_matches_removal_by_bytes(spark):
    rng = random.Random(8)
    pool = [f"line {i} \x01" if i % 7 == 0 else f"line {i}" for i in range(40)] + ["", " "]
    passages = [[f"passage {k} {i}" for i in range(14)] for k in range(4)]
    docs = []
    for d in range(120):
        body = [rng.choice([f"{d} {rng.random()}", rng.choice(pool)]) for _ in range(rng.randint(0, 12))]
        for _ in range(rng.randint(0, 3)):
            at, a = rng.randint(0, len(body)), rng.randint(0, 10)
            body[at:at] = rng.choice(passages)[a:rng.randint(a + 1, 14)] if rng.random() < 0.5 else rng.choice(passages)
        docs.append((d, "\n".join(body)))
    docs += [(200, docs[0][1]), (201, docs[0][1]), (201, docs[0][1]), (202, ""), (203, None), (204, "\n\n\n"), (7, "a\nb\nc"), (None, "a\nb\nc"),
             (205, "a\na\na"), (206, "b\na\na")]
    got = check(spark, docs)
    assert sum(t == "" for t in got.values()) > 5


def test_random_small_alphabet(spark):
    rng = random.Random(3)
    for size in (3, 6):
        check(spark, [(d, "\n".join(rng.choice("abcdef"[:size]) for _ in range(rng.randint(1, 7)))) for d in range(60)])


def test_smoke_table_and_query(spark):
    docs = [tuple(r) for r in read_table(spark, SMOKE_DIR, "documents").select("doc_id", "text").collect()]
    got = check(spark, docs)
    assert {r.doc_id: r.text for r in queries.op5_lines(spark, SMOKE_DIR).collect()} == got
    assert sum(t != got[d] for d, t in docs) > 5


def test_boundaries_do_not_shift(spark):
    rng = random.Random(1)
    body = [f"{rng.random()}" for _ in range(400)]
    got = check(spark, [(1, "\n".join(body)), (2, "\n".join(["x", *body[:5], "new", *body[5:], "y"]))], exact=False)
    assert got == {1: "\n".join(body), 2: "x\nnew\ny"}


def test_long_texts_take_linear_time(spark):
    rng = random.Random(2)
    body = "\n".join(f"{rng.random()}" for _ in range(20_000))
    df = spark.createDataFrame([(1, body), (2, body + "\nend"), (3, "start\n" + body)], "doc_id long, text string")
    began = time.time()
    assert {r.doc_id: r.text for r in lines.deduplicated(df).collect()} == {1: body, 2: "end", 3: "start"}
    assert time.time() - began < 60


def test_odd_rows(odd, none):
    out = lines.deduplicated(odd)
    assert out.count() == odd.count() and set(odd.columns) < set(out.columns)
    by = {r.doc_id: r for r in out.collect()}
    assert by[3].text is None and by[4].text == "" and by[3]["__removed"] == []
    assert lines.deduplicated(none).count() == 0
