from __future__ import annotations

import hashlib
import math
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from orderdesk.llm import decontam, gru, langid, mixing, queries, sharding
from orderdesk.llm.common import checkpointed, read_table
from tests.conftest import SMOKE_DIR
from tests.llm.test_minhash import brute as near_duplicates_by_pairs
from tests.llm.test_mixing import shared
from tests.llm.test_sharding import drawn


def test_stages_in_order_and_run(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontaminate", "mix", "shard"]
    docs = read_table(spark, SMOKE_DIR, "documents")
    rows = corpus_pipeline.run(spark, SMOKE_DIR)
    assert set(docs.columns) <= set(rows.columns) and {"shard", "grown_shard"} <= set(rows.columns)
    source = {tuple(r) for r in docs.collect()}
    got = rows.select(*docs.columns, "shard").collect()
    assert got and {tuple(r)[:-1] for r in got} <= source and all(0 <= r.shard < 40 for r in got)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_odd_and_empty_tables(spark, odd, none, name, stage):
    for docs in (odd, none):
        out = stage(spark, docs, SMOKE_DIR)
        rows = out.collect()
        if name != "shard":
            assert out.columns == docs.columns
        assert len(rows) <= 3 * docs.count()


def kept_by_language(docs):
    """Texts with a letter whose mean probability of the best language, worked out window by window, reaches the least score."""
    langs, params = langid.fit(langid.sample(docs))
    rows = docs.collect()
    bodies = {r.text: r.text.encode() for r in rows if r.text and any(c.isalpha() for c in r.text)}
    best = {}
    for text, body in bodies.items():
        data, lengths, _ = gru.windows_of([body])
        best[text] = gru.position_sums(params, data, lengths).sum(axis=0).max() / len(body)
    return [r for r in rows if best.get(r.text, 0) >= langid.MIN_SCORE]


def kept_by_near_dedup(docs):
    rows = docs.collect()
    classes = near_duplicates_by_pairs([(r.doc_id, r.text) for r in rows], size=5, percent=80)
    return [r for r in rows if classes[r.doc_id][2]]


def kept_by_decontamination(spark, docs):
    items = [decontam.normalized(r.text) for r in read_table(spark, SMOKE_DIR, "benchmark").collect() if r.text]
    out = []
    for r in docs.collect():
        body = decontam.normalized(r.text or "")
        if all(min(decontam.distances(decontam.char_masks(i), len(i), body), default=len(i)) > len(i) * decontam.ERROR_RATE for i in items):
            out.append(r)
    return out


def mixed_by_hand(docs):
    rows = docs.collect()
    size = {r: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows}
    names = sorted({r.source for r in rows}, key=lambda s: (s is None, (s or "").encode()))
    sizes = [sum(size[r] for r in rows if r.source == s) for s in names]
    target = dict(zip(names, shared(sizes, [1 + i % 3 for i in range(len(names))], 3.0), strict=True))
    out = []
    for r in rows:
        total = sizes[names.index(r.source)]
        rate = min(3.0, target[r.source] / total) if total else 1.0
        text = hashlib.md5((r.text or "").encode()).hexdigest()
        draw = int(hashlib.md5(f"{mixing.SEED}|{r.doc_id}|{text}".encode()).hexdigest()[:13], 16) / 2**52
        out += [r] * (math.floor(rate) + (draw < rate - math.floor(rate)))
    return out


def test_stages_match_brute_force(spark):
    """Each stage on what the one before it kept."""
    docs = read_table(spark, SMOKE_DIR, "documents")
    docs = docs.union(spark.createDataFrame([(10**6, "123 456 !", "en", "web", 9), (10**6 + 1, None, None, None, None)], docs.schema))
    by_hand = {"language_id": kept_by_language, "near_dedup": kept_by_near_dedup,
               "decontaminate": lambda d: kept_by_decontamination(spark, d), "mix": mixed_by_hand}
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        out = checkpointed(stage(spark, docs, SMOKE_DIR))
        if name == "shard":
            want = [(*r, drawn(r.doc_id, sharding.uniform_tree(40)), drawn(r.doc_id, sharding.uniform_tree(41))) for r in docs.collect()]
            assert sorted(map(str, map(tuple, out.select(*docs.columns, "shard", "grown_shard").collect()))) == sorted(map(str, want))
        else:
            assert sorted(map(str, out.collect())) == sorted(map(str, by_hand[name](docs))), name
        counts.append((docs.count(), out.count()))
        docs = out
    assert counts[0][1] < counts[0][0] and counts[1][1] < counts[1][0] and counts[2][1] < counts[2][0]


def test_clean_documents_stay(spark):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents").limit(400)
    clean = docs.filter(F.length("text") > 300)
    assert corpus_pipeline.language_id(spark, docs, SMOKE_DIR).filter(F.length("text") > 300).count() >= 0.99 * clean.count()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_their_statement(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMOKE_DIR}/{table}.parquet'")
    df = queries.queries()[name](spark, SMOKE_DIR)
    want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in df.collect())


def test_every_operator_is_registered():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{n}" for n in range(1, 14)]
