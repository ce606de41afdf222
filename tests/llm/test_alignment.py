from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from orderdesk.llm import alignment
from orderdesk.llm.alignment import closed, composed, fragment, windows

A_FILE = f"{alignment.TOKENIZERS}/byte_bpe_50k.json"
B_FILE = f"{alignment.TOKENIZERS}/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def pair():
    with open(A_FILE, "rb") as a, open(B_FILE, "rb") as b:
        return alignment.Pair(alignment.byte_level(a.read(), True), alignment.pieces(b.read()))


@pytest.fixture(scope="module")
def plain():
    """Whole texts through the two libraries, groups by a walk over both token lists."""
    a = Tokenizer.from_file(A_FILE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B_FILE)
    letters = alignment._byte_letters()
    names = {k: bytes(letters[c] for c in t) for t, k in a.get_vocab(with_added_tokens=False).items() if k != 50256}

    def b_bytes(k):
        piece = b.id_to_piece(k)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(k) else piece.replace("▁", " ").encode()

    def groups(text):
        if not text:
            return []
        raw = (" " + text).encode()
        sides = [[(k, names[k]) for k in a.encode(" " + text, add_special_tokens=False).ids], [(k, b_bytes(k)) for k in b.encode(text)]]
        if any(b"".join(x for _, x in side) != raw for side in sides):
            return []
        ends = []
        for side in sides:
            at, out = 0, {}
            for k, x in side:
                at += len(x)
                out[at] = k
            ends.append(out)
        out, now = [], ([], [])
        for at in range(1, len(raw) + 1):
            for side in (0, 1):
                if at in ends[side]:
                    now[side].append(ends[side][at])
            if at in ends[0] and at in ends[1]:
                out.append(now)
                now = ([], [])
        return out
    return groups


def as_text(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


WORDS = ["the", "Häuser", "don't", "we're'll", "~'s", "漢字仮名", "🙂🙃", "12345", "\n\n", "\t", "   ", "a b", "　", "x" * 40, "QzJ9==", "<|endoftext|>",
         "<s>", "</s>", "<0x0A>", "\x00", "é", "é", "ﬁ", "\r\n", "...!?'", "'re", "\x1c", " ", "ab'cd", "—", "naïve", "﻿", "ß"]


def texts(seed, n):
    rng = random.Random(seed)
    for _ in range(n):
        yield rng.choice(["", " "]).join(rng.choice(WORDS) for _ in range(rng.randint(1, 30)))


def test_whole_texts_match_the_libraries(pair, plain):
    for text in [*texts(1, 300), "word", " lead", "trail ", "▁", "a▁b", " ", "\n", "a" * 5000]:
        f = closed(fragment(windows(" " + text, pair, 10**9)[0], pair))
        want = plain(text)
        assert f.groups.decode() == as_text(want), repr(text)
        assert (f.n_groups, f.n_links) == (len(want), sum(len(a) * len(b) for a, b in want))


@pytest.mark.parametrize("size", [1, 3, 10, 50])
def test_any_ranges_and_any_brackets_give_the_whole(pair, plain, size):
    rng = random.Random(size)
    several = 0
    for text in [*texts(size, 150), "漢字仮名" * 30, "x" * 300, "▁ b" * 9]:
        ranges = windows(" " + text, pair, size)
        assert ranges[0].lo == 0 and ranges[-1].hi == len((" " + text).encode())
        assert all(x.hi == y.lo for x, y in zip(ranges, ranges[1:], strict=False))
        parts = [fragment(w, pair) for w in ranges]
        several += len(parts) > 1
        while len(parts) > 1:  # compose neighbours in a random order
            k = rng.randrange(len(parts) - 1)
            parts[k:k + 2] = [composed(parts[k:k + 2])]
        f = closed(parts[0])
        want = plain(text)
        assert f.groups.decode() == as_text(want), repr(text)
        assert not len(f.post_a) and (f.n_a, f.n_b) == (sum(len(a) for a, _ in want), sum(len(b) for _, b in want))
        links = Counter((i << 32) | j for a, b in want for i in a for j in b)
        assert dict(zip(f.keys.tolist(), f.times.tolist(), strict=True)) == links
    assert several > 50


def test_ranges_have_open_ends(pair):
    """The ranges are cut at bytes, not at tokens, so fragments do have prefixes and suffixes of part groups."""
    parts = [fragment(w, pair) for text in texts(5, 100) for w in windows(" " + text, pair, 2)]
    assert sum(len(f.post_a) > 0 or len(f.post_b) > 0 for f in parts) > 50 and sum(not f.cut for f in parts) > 5


def test_text_without_safe_cuts_is_read_twice_at_most(pair):
    s = " " + "x" * 100_000
    assert len(windows(s, pair, 100)) == 1
    s += " end " + "y" * 50_000 + " z" * 500
    assert sum(len(w.text) for w in windows(s, pair, 100)) <= 2 * len(s)


def test_merges_by_rank_are_proven_for_the_file():
    with open(A_FILE, "rb") as f:
        raw = f.read()
    assert alignment.merges_alone(raw)
    assert not alignment.merges_alone(raw.replace(b'"use_regex":true', b'"use_regex":false').replace(b'"use_regex": true', b'"use_regex": false'))
    slow = alignment.byte_level(raw, False)
    fast = alignment.byte_level(raw, True)
    assert all((slow.encode(t, t.encode()) == fast.encode(t, t.encode())).all() for t in texts(8, 100))


def brute(rows, plain):
    held, best, out = defaultdict(int), defaultdict(int), []
    linked = [(i, g, Counter((x, y) for a, b in g for x in a for y in b)) for i, g in ((i, plain(t)) for i, t in rows)]
    for _, _, links in linked:
        for p in links:
            held[p] += 1
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    for i, g, links in linked:
        out.append((i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(links.values()),
                    sum(n for p, n in links.items() if held[p] == best[p[0]]), sum(n * held[p] for p, n in links.items()), as_text(g)))
    return sorted(out, key=str), held


def got(rows):
    return sorted((tuple(r) for r in alignment.scored(rows).select(
        "__id", "__n_a", "__n_b", "__n_groups", "__n_links", "__n_best", "__count_sum", "__written").collect()), key=str)


@pytest.mark.parametrize("size, pairs", [(1 << 15, 2_000_000), (40, 60)])
def test_documents_match_brute_force(spark, plain, monkeypatch, size, pairs):
    """With small ranges most texts go through the tree, in several levels; with small blocks most pairs meet across blocks."""
    monkeypatch.setattr(alignment, "RANGE", size)
    monkeypatch.setattr(alignment, "FAN", 3)
    monkeypatch.setattr(alignment, "BLOCK_PAIRS", pairs)
    monkeypatch.setattr(alignment, "_PART", 200)
    rows = [(k, t) for k, t in enumerate(texts(3, 60))] + [(5, "the cat"), (5, "the cat"), (None, "the dog"), (7, None), (8, ""), (9, "▁"), (10, "the " * 400)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_a int, `a.b` string").repartition(3)
    made = alignment.aligned(df, A_FILE, B_FILE)
    want, held = brute(rows, plain)
    assert got(made) == want
    assert {(r.a, r.b): r.docs for r in alignment.pair_counts(made).collect()} == held


def test_odd_rows(spark, odd, none, plain):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert got(alignment.aligned(odd)) == brute(rows, plain)[0]
    assert got(alignment.aligned(none)) == []
    assert got(alignment.aligned(odd.filter("text IS NULL"))) == sorted([(3, 0, 0, 0, 0, 0, 0, "")] + [(None, 0, 0, 0, 0, 0, 0, "")] * 2, key=str)


def test_products_of_a_block():
    keys = np.array([3, 5, 9])
    block = alignment._Block()
    f = alignment.Fragment(True, True, keys, keys, b"", 0, 0, 0, 0, keys, np.array([1, 2, 1]), keys, keys)
    first, second = block.add([({"__id": 1}, f), ({"__id": 2}, f)])
    (third,) = block.add([({"__id": 3}, alignment.Fragment(True, True, keys, keys, b"", 0, 0, 0, 0, np.array([1, 9]), np.array([4, 1]), keys, keys))])
    names, docs = alignment._whole(4, block.dictionary()["__pairs"], "<i8", "<i8")
    assert dict(zip(names.tolist(), docs.tolist(), strict=True)) == {3: 2, 5: 2, 9: 3, 1: 1}
    steps, times = alignment._whole(2, third["__pairs"], "<u4", "<u4")
    assert [(int(names[p]), int(t)) for p, t in zip(np.cumsum(steps), times, strict=True)] == [(9, 1), (1, 4)]
