"""The trigram index answers like the scan and reads few bookings."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from orderdesk.catalog import tables_for
from orderdesk.operators import search
from orderdesk.plans import lists as L
from orderdesk.plans import store
from orderdesk.sources import versions as V

from .conftest import SMOKE_DIR
from .test_versions import explain, rows


@pytest.fixture(scope="module")
def snap(spark, tmp_path_factory):
    t = tables_for(spark, SMOKE_DIR)
    return store.create(spark, t, str(tmp_path_factory.mktemp("store")), 16)


def test_equal_to_the_scan_on_random_patterns(spark, snap):
    rng = random.Random(9)
    t = tables_for(spark, SMOKE_DIR)
    index = L.booking_index(t).cache()
    texts = [str(x) for r in t.bookings.select("id", "customer_name", "customer_phone").limit(200).collect() for x in r]
    scan = t.bookings.select("id", "customer_name", "customer_phone").cache()
    many = 0
    for _ in range(40):
        text = rng.choice(texts)
        a = rng.randrange(len(text))
        pattern = text[a:a + rng.randint(1, 9)]
        for _ in range(rng.randint(0, 2)):
            k = rng.randrange(len(pattern))
            pattern = pattern[:k] + rng.choice(["%", "_", pattern[k].upper(), pattern[k].swapcase(), "\\", "é", "zz"]) + pattern[k + 1:]
        ids = search.found(spark, index, pattern)
        pred = L.booking_search_pred(pattern)
        want = scan.filter(pred[0]) if pred else scan
        if ids is not None:
            assert rows(want.join(ids, "id", "left_semi").select("id")) == rows(want.select("id")), pattern
            many += 1
    assert many > 10
    for pattern in ("customer#000000077", "CUSTOMER#%77", "+1 555 0000_77", "5 00", "no such text", "77", "%", "'"):
        assert rows(store.search_bookings(snap, pattern)) == rows(L.booking_list(t, pattern)), pattern


def test_reads_few_bookings(spark, snap):
    df = store.search_bookings(snap, "customer#000000077")
    text = explain(df)
    held = df.select("id").collect()
    assert 0 < len(held) < 40
    listed = text.count(f"/bookings/attempt=")
    assert "PartitionFilters" in text and 0 < listed < 16  # of sixteen buckets those with candidates
    index = snap.read("booking_grams", snap.touched("booking_grams", search.hashes(spark, search.asked(spark, "#000000077")), "gram_hash"))
    text = explain(index.filter(F.col("gram").isin("#00", "077")))
    assert "PushedFilters: [In(gram" in text and "PartitionFilters" in text


def test_index_may_hold_more_than_is_true(spark):
    """Trigrams of texts that have changed since only make candidates."""
    df = spark.createDataFrame([(1, "alpha beta"), (2, "beta gamma"), (3, None), (4, "ab"), (5, "")], "id long, text string")
    index = search.postings(df, "id", {"text": F.col("text")})
    stale = index.unionByName(search.postings(spark.createDataFrame([(2, "alpha beta")], "id long, text string"), "id", {"text": F.col("text")}))
    assert rows(search.found(spark, index, "ALPHA")) == [(1,)]
    assert rows(search.found(spark, stale, "ALPHA")) == [(1,), (2,)]
    assert search.found(spark, index, "al") is None and search.found(spark, index, "a%l_p") is None
    assert rows(search.found(spark, index, "a%l_p", wildcards=False)) == []
    assert rows(search.found(spark, index, "eta_amm")) == [(2,)]


def test_lists_of_a_pattern_are_those_of_the_index(spark):
    t = tables_for(spark, SMOKE_DIR)
    for pattern in ("mer#%077", "5 0000_77", "Customer", "no such text"):
        a = search.asked(spark, pattern)
        assert rows(L.booking_index(t, pattern)) == rows(L.booking_index(t).filter(F.col("gram").isin(*a.grams)))
    a = search.asked(spark, "Widget (3", wildcards=False)
    assert rows(L.row_index(t, "Widget (3")) == rows(L.row_index(t).filter(F.col("gram").isin(*a.grams)))


def test_row_search_equal_to_the_scan(spark):
    t = tables_for(spark, SMOKE_DIR)
    index = L.row_index(t).cache()
    for query in ("Widget (3", "by france", "approve reject", "$1", "delivered 7", "district", "%", "nothing like it"):
        assert rows(L.indexed_row_search(t, index, query)) == rows(L.row_text_search(t, query)), query


def test_appended_bookings_are_found(spark, snap):
    t = tables_for(spark, SMOKE_DIR)
    requests = t.booking_requests.limit(1).select(F.lit(10**9).cast("long").alias("request_id"), F.lit("Zacharias Quux").alias("customer_name"),
                                                  F.lit("+1 555 9876543").alias("customer_phone"), "customer_address", "payment_type", "moderator_id")
    items = spark.createDataFrame([(10**9, 1, 1, 1)], "request_id long, line_no int, product_id long, quantity int")
    after = store.append_requests(V.latest(spark, snap.root), "more", requests, items)
    assert [r["id"] for r in store.search_bookings(after, "rias q").collect()] == [10**9]
    assert [r["id"] for r in store.search_bookings(after, "5 98765").collect()] == [10**9]
    assert store.search_bookings(snap, "rias q").count() == 0  # not in the version before
