"""Commits are atomic and ordered, snapshots stay what they were."""

from __future__ import annotations

import contextlib
import io
import os
import threading

import pytest
from pyspark.sql import functions as F

from orderdesk.sources import sinks
from orderdesk.sources import versions as V


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: [(x is not None, x) for x in r])


def files(root):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(root) for f in names
            if f.endswith(".parquet")}


def explain(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


def test_put_if_absent_lets_one_of_many_win(spark, tmp_path):
    path, won = str(tmp_path / "d" / "x.json"), []
    threads = [threading.Thread(target=lambda k=k: won.append(k) if V.put_if_absent(spark, path, f"text {k}") else None) for k in range(12)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and V._read_text(spark, path) == f"text {won[0]}"
    assert os.listdir(tmp_path / "d") == ["x.json"] or sorted(f for f in os.listdir(tmp_path / "d") if not f.endswith(".crc")) == ["x.json"]


def test_two_attempts_at_one_version_leave_one_record(spark, tmp_path):
    root, got = str(tmp_path), []

    def attempt(k):
        got.append(sinks.commit_versioned(spark, {"a": spark.range(k, k + 1), "b": spark.range(k, k + 1)}, root, "v1"))
    threads = [threading.Thread(target=attempt, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(got) == [False, False, False, True]
    assert V._numbers(spark, root) == [1]
    snap = V.latest(spark, root)
    assert rows(snap.read("a")) == rows(snap.read("b"))  # of one attempt, not of two


def test_stale_base_is_refused(spark, tmp_path):
    root = str(tmp_path)
    first = V.commit(V.latest(spark, root), "v1", {"a": V.Write(spark.range(3))})
    second = V.commit(first, "v2", {"a": V.Write(spark.range(4))})
    with pytest.raises(V.StaleBase):
        V.commit(first, "v3", {"a": V.Write(spark.range(5))})
    assert V.latest(spark, root) == second and rows(second.read("a")) == [(k,) for k in range(4)]


def test_base_that_goes_stale_during_the_write_is_refused(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    base = V.latest(spark, root)
    put = V.put_if_absent

    def late(s, path, text):
        monkeypatch.setattr(V, "put_if_absent", put)
        V.commit(base, "other", {"a": V.Write(spark.range(1))})
        return put(s, path, text)
    monkeypatch.setattr(V, "put_if_absent", late)
    with pytest.raises(V.StaleBase):
        V.commit(base, "mine", {"a": V.Write(spark.range(9))})
    assert V.latest(spark, root).version == "other" and V.version_of(spark, root, "mine") is None


def test_committing_a_version_again_changes_nothing(spark, tmp_path):
    root = str(tmp_path)
    first = V.commit(V.latest(spark, root), "v1", {"a": V.Write(spark.range(3))})
    before = files(root)
    assert V.commit(first, "v1", {"a": V.Write(spark.range(7))}) == first
    assert not sinks.commit_versioned(spark, {"a": spark.range(8)}, root, "v1")
    assert files(root) == before and rows(V.latest(spark, root).read("a")) == [(0,), (1,), (2,)]


def test_a_snapshot_never_mixes_versions(spark, tmp_path):
    root = str(tmp_path)
    snap = V.latest(spark, root)
    for k in range(1, 4):
        held = snap
        snap = V.commit(snap, f"v{k}", {"a": V.Write(spark.range(k)), **({"b": V.Write(spark.range(k))} if k != 2 else {})})
        if k > 1:
            assert held.read("a").count() == k - 1  # what was pinned still reads as it was
    assert (snap.read("a").count(), snap.read("b").count()) == (3, 3)
    middle = V.version_of(spark, root, "v2")
    assert (middle.read("a").count(), middle.read("b").count()) == (2, 1)  # v2 left b as its base had it


def test_failed_attempt_is_never_read(spark, tmp_path):
    root = str(tmp_path)
    first = V.commit(V.latest(spark, root), "v1", {"a": V.Write(spark.range(3))})
    bad = spark.range(3).select(F.raise_error(F.lit("no")).cast("long").alias("id"))
    with pytest.raises(Exception, match="no"):
        V.commit(first, "v2", {"a": V.Write(spark.range(9)), "b": V.Write(bad)})
    assert V.latest(spark, root) == first and rows(V.latest(spark, root).read("a")) == [(0,), (1,), (2,)]
    assert V.commit(first, "v2", {"a": V.Write(spark.range(4))}).number == 2


def test_buckets_append_and_replace(spark, tmp_path):
    root = str(tmp_path)
    df = spark.range(100).select("id", (F.col("id") * 2).alias("x"))
    one = V.commit(V.latest(spark, root), "v1", {"t": V.Write(df, key="id", buckets=8)})
    before = files(root)
    new = spark.range(100, 104).select("id", F.lit(-1).alias("x"))  # an int column goes in as the table's long
    two = V.commit(one, "v2", {"t": V.Write(new, "append")})
    touched = two.touched("t", spark.range(3), "id")
    changed = two.read("t", touched).select("id", F.lit(0).alias("x"))
    three = V.commit(two, "v3", {"t": V.Write(changed, "buckets", touched=tuple(touched))})
    assert all(files(root)[f] == at for f, at in before.items())  # no committed file is changed
    inside = {r["id"] for r in two.read("t", touched).collect()}
    assert 0 < len(inside) < 104 and {0, 1, 2} <= inside
    want = {k: 2 * k for k in range(100)} | dict.fromkeys(range(100, 104), -1)
    assert rows(one.read("t")) == [(k, 2 * k) for k in range(100)]
    assert rows(two.read("t")) == sorted(want.items())
    assert rows(three.read("t")) == sorted((want | dict.fromkeys(inside, 0)).items())
    kept = {p for p in two.tables["t"].parts if p[1] not in touched}
    assert kept and kept < set(three.tables["t"].parts)
    text = explain(two.read("t", touched))
    assert "PartitionFilters" in text and V.BUCKET in text.split("PartitionFilters")[1].split("\n")[0]


def test_empty_tables_keep_their_columns(spark, tmp_path):
    root = str(tmp_path)
    none = spark.range(0).select("id", F.lit("a").alias("s"))
    snap = V.commit(V.latest(spark, root), "v1", {"t": V.Write(none, key="id", buckets=4), "u": V.Write(none)})
    assert snap.read("t").columns == snap.read("u").columns == ["id", "s"]
    assert snap.read("t").count() == snap.read("u").count() == 0
    assert V.commit(snap, "v2", {"t": V.Write(spark.range(2).select("id", F.lit("b").alias("s")), "append")}).read("t").count() == 2
