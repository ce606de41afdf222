from __future__ import annotations

import hashlib
import random
import re

import pytest

from orderdesk.llm import secrets

KEYWORDS = ["password", "PASSWD", "Secret", "token", "api_key", "APIKEY", "apikey", "AKIA", "ghp_", "xoxb-", "sk_live_"]


def text_of(rng: random.Random) -> str:
    out = []
    for _ in range(rng.randint(0, 30)):
        out.append(rng.choice([
            rng.choice(KEYWORDS), rng.choice([" = ", ":", "=", '": "', "' :'", " "]), "é😀", "\n", "word ",
            "".join(rng.choice("abcdef0123456789") for _ in range(rng.choice([3, 20, 24, 40]))),
            "".join(rng.choice("ABCDEFGHIJKLMNOP0123") for _ in range(rng.choice([4, 16, 20]))),
            "".join(rng.choice("abcXYZ019+/_.=-") for _ in range(rng.choice([3, 5, 6, 30, 40])))]))
    return "".join(out)


def base_spans(text: str) -> list[tuple]:
    out = []
    for rank, (kind, pattern, keep) in enumerate((
            ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
            ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 24))):
        out += [(m.start(), rank, m.end(), kind) for m in re.finditer(pattern, text) if keep(m)]
    return sorted(out)


@pytest.mark.parametrize("rule", secrets.BASE + secrets.ADDED, ids=lambda r: r.kind)
def test_trigram_query_holds_for_every_match(rule):
    rng = random.Random(1)
    query = secrets.trigram_query(rule.pattern)
    texts = [text_of(rng) for _ in range(3000)] + [
        "ghp_" + "a" * 36, "xoxb-" + "1" * 12, "AIza" + "b" * 35, "sk_live_" + "c" * 24, "eyJ" + "a" * 9 + ".eyJ" + "b" * 9 + "." + "c" * 9,
        "-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----"]
    matching = [t for t in texts if re.search(rule.pattern, t)]
    assert matching
    assert query is None if rule.kind == "hex" else query
    for t in matching if query else []:
        assert any(all(g in t.lower() for g in grams) for grams in query)


def test_queries_from_patterns():
    q = secrets.trigram_query
    assert q("abcd") == [{"abc", "bcd"}] and q("ab.cd") is None and q("(abc|xy)z") is not None
    assert q("(abc|x)") is None and q("a[bc]d") == [{"abd"}, {"acd"}] and q("(abc)*") is None and q("(ab){2}") == [{"aba", "bab"}]
    assert q("abcx+def") == [{"abc", "bcx", "def"}] and q("abc[0-9]def") == [{"abc", "def"}]


def test_spans_match_a_plain_search(spark):
    rng = random.Random(7)
    docs = [(i, text_of(rng)) for i in range(400)] + [(900, None), (901, "token=secret=abcdefg api_key=token:abcdefgh"),
                                                      (902, "K password : 'hunter22' " + "0" * 24 + "G" + "f" * 23)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    rows = secrets.scanned(df).select("doc_id", secrets.joined("__base").alias("b"), secrets.joined("__spans").alias("s")).collect()
    text = {d: t or "" for d, t in docs}
    for r in rows:
        want = base_spans(text[r.doc_id])
        assert r.b == ",".join(f"{k}:{a}:{b}" for a, _, b, k in want)
        assert set(r.b.split(",")) <= set(r.s.split(",")) if r.b else True
        for kind, a, b in (x.split(":") for x in r.s.split(",") if x):
            rule = next(x for x in secrets.BASE + secrets.ADDED if x.kind == kind)
            assert re.fullmatch(rule.pattern, text[r.doc_id][int(a):int(b)])
    assert sum(bool(r.b) for r in rows) > 100
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


def test_odd_rows(odd, none):
    out = secrets.scanned(odd)
    assert out.count() == odd.count() and all(r["__spans"] == [] for r in out.collect())
    assert secrets.scanned(none).count() == 0
