"""Write jobs: outputs committed as one version and equal to the queries."""

from __future__ import annotations

import csv

from pyspark.sql import functions as F

from orderdesk.catalog import tables_for
from orderdesk.operators import workflow as W
from orderdesk.plans import documents as DOC
from orderdesk.plans import jobs as J
from orderdesk.plans import reports as R
from orderdesk.sources import sinks

from .conftest import SMOKE_DIR


def test_process_booking_requests(spark, tmp_path):
    t = tables_for(spark, SMOKE_DIR)
    root = str(tmp_path / "requests")
    J.process_booking_requests(spark, t, root, "v1")
    assert sinks.current_version(spark, root) == "v1"
    out = W.price_requests(t.booking_requests, t.booking_request_items, t.products)
    accepted = out.filter(F.col("outcome") == "accepted")
    nb = sinks.read_current(spark, root, "new_bookings")
    assert nb.count() == accepted.count()
    assert nb.select("id").subtract(accepted.select(F.col("request_id").alias("id"))).count() == 0
    assert sinks.read_current(spark, root, "new_payments").count() == accepted.count()
    items = sinks.read_current(spark, root, "new_booking_items")
    assert items.count() == W.new_booking_items(t.booking_requests, t.booking_request_items, t.products).count()
    assert (sinks.read_current(spark, root, "request_rejections").count()
            == out.filter(F.col("outcome") == "rejected").count())


def test_apply_commands(spark, tmp_path):
    t = tables_for(spark, SMOKE_DIR)
    root = str(tmp_path / "commands")
    J.apply_commands(spark, t, root, "v7")
    b = sinks.read_current(spark, root, "bookings")
    assert b.count() == t.bookings.count()
    state = W.workflow_state(t.bookings, t.workflow_commands)
    joined = b.join(state.select("id", F.col("status").alias("s")), "id")
    assert joined.filter(F.col("status") != F.col("s")).count() == 0
    dd = sinks.read_current(spark, root, "delivery_details")
    expect = W.delivery_upsert(t.delivery_details, t.bookings, t.workflow_commands)
    assert dd.exceptAll(expect).count() == 0 and expect.exceptAll(dd).count() == 0
    rej = sinks.read_current(spark, root, "rejected_commands").count()
    assert rej == (W.workflow_rejections(t.bookings, t.workflow_commands).count()
                   + W.payment_update_rejections(t.payments, t.payment_updates).count())


def test_csv_and_json_sinks(spark, tmp_path):
    t = tables_for(spark, SMOKE_DIR)
    csv_path = str(tmp_path / "monthly.csv")
    sinks.write_csv(DOC.monthly_csv_rows(t), csv_path)
    back = spark.read.option("header", True).csv(csv_path)
    assert back.columns == ["Month", "Orders", "Revenue", "Avg Order Value"]
    assert back.count() == R.monthly_revenue(t).count()
    expect = [tuple(r) for r in DOC.monthly_csv_rows(t).collect()]
    typed = spark.read.option("header", True).schema(DOC.monthly_csv_rows(t).schema).csv(csv_path)
    assert sorted(map(tuple, typed.collect())) == sorted(expect)
    one = str(tmp_path / "report.csv")
    for _ in range(2):  # a download replaces the one before
        sinks.write_csv_file(DOC.monthly_csv_rows(t), one)
    with open(one, newline="") as f:
        header, *lines = csv.reader(f)
    assert header == back.columns
    assert [(m, int(n), r, float(a)) for m, n, r, a in lines] == [(m, n, str(r), float(a)) for m, n, r, a in expect]
    assert sorted(x.name for x in tmp_path.iterdir() if not x.name.endswith(".crc")) == ["monthly.csv", "report.csv"]
    json_path = str(tmp_path / "docs")
    sinks.write_json_documents(DOC.booking_document(t), json_path)
    docs = spark.read.json(json_path)
    assert docs.count() == t.bookings.count()
    assert {"items", "delivery_details", "moderator_name"} <= set(docs.columns)


def test_dense_booking_ids(spark, tmp_path):
    t = tables_for(spark, SMOKE_DIR)
    root = str(tmp_path / "dense")
    J.process_booking_requests(spark, t, root, "v1", dense=True)
    nb = sinks.read_current(spark, root, "new_bookings")
    top = t.bookings.agg(F.max("id")).first()[0]
    ids = [r["id"] for r in nb.orderBy("request_id").collect()]
    assert ids == list(range(top + 1, top + 1 + len(ids)))  # dense, in request order
    items = sinks.read_current(spark, root, "new_booking_items")
    assert items.join(nb, items["booking_id"] == nb["id"], "left_anti").count() == 0
    pays = sinks.read_current(spark, root, "new_payments")
    assert sorted(r["booking_id"] for r in pays.collect()) == sorted(ids)


def test_dense_ids_across_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(0, 5000).select((F.col("id") * 7919 % 5003).alias("k")).repartition(13)
        out = J.dense_ids(df, "k", 100)
        rows = sorted((r["k"], r["new_id"]) for r in out.collect())
        assert [i for _, i in rows] == list(range(100, 100 + len(rows)))
        parts = df.orderBy("k").rdd.getNumPartitions()
        assert parts > 1
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_reports_page_equals_single_queries(spark, tmp_path):
    from orderdesk.plans import reports as R
    t = tables_for(spark, SMOKE_DIR)
    root = str(tmp_path / "reports")
    J.reports_page(spark, t, root, "v1")
    pairs = {"revenue_overview": R.revenue_overview(t), "monthly_revenue": R.monthly_revenue(t),
             "top_products": R.top_products(t, ranked=True), "recent_transactions": R.recent_transactions(t),
             "payment_type_stats": R.payment_type_stats(t), "booking_stats": R.booking_stats_full(t)}
    for name, expect in pairs.items():
        got = sinks.read_current(spark, root, name)
        assert got.exceptAll(expect).count() == 0 and expect.exceptAll(got).count() == 0, name


def test_new_booking_labels_match_items(spark, tmp_path):
    from orderdesk.operators.items import item_labels
    t = tables_for(spark, SMOKE_DIR)
    root = str(tmp_path / "labels")
    J.process_booking_requests(spark, t, root, "v1")
    labels = sinks.read_current(spark, root, "new_booking_labels")
    items = sinks.read_current(spark, root, "new_booking_items")
    expect = item_labels(items, t.products).withColumnRenamed("products", "products_qty")
    got = labels.select("booking_id", "products_qty")
    assert got.exceptAll(expect).count() == 0 and expect.exceptAll(got).count() == 0
