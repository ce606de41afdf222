"""Measure how a hot booking's work is spread over tasks, from the event log.

Usage: python tools/skew_probe.py SCRATCH_DIR plain|salted

Builds 300,000 review/delivery commands of which a third belong to one
booking, runs ``workflow_rejections`` with broadcasts off (as at scale) and
the hot-key threshold lowered to 10,000 rows, writes Spark's event log into
SCRATCH_DIR and prints, for the stage with the largest task, the shuffled rows
read by that task and by the median task. ``plain`` replaces the salted joins
by ordinary joins for comparison.
"""
import sys, datetime as dt, glob, os, json, statistics
sys.path.insert(0, '/root/repo')
evdir, mode = sys.argv[1], sys.argv[2]
from pyspark.sql import SparkSession
from orderdesk.session import DEFAULTS
b = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "32")
     .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", evdir).config("spark.eventLog.compress", "false"))
for k, v in DEFAULTS.items(): b = b.config(k, v)
for k, v in {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
             "spark.sql.adaptive.coalescePartitions.enabled": "false"}.items():
    b = b.config(k, v)
spark = b.getOrCreate(); spark.sparkContext.setLogLevel("ERROR")
from orderdesk.operators import workflow as W, skew
from pyspark.sql import functions as F
skew.ROWS_PER_SALT = 10000
if mode == "plain":
    W.salted_join = lambda big, small, key, how="inner", hot=None: big.join(small, key, how)
n = 300000
cmds = spark.range(n).select(
    F.col("id").alias("cmd_id"),
    (F.lit(dt.datetime(2024,1,1)).cast("timestamp_ntz") + F.make_dt_interval(secs=(F.col("id") % 86400).cast("int"))).alias("ts"),
    F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 5000).cast("long").alias("booking_id"),
    (F.col("id") % 25).alias("actor_id"),
    F.element_at(F.array(*[F.lit(a) for a in ["approve", "reject", "delivered", "not_delivered"]]), (F.col("id") % 4 + 1).cast("int")).alias("action"),
    F.lit("Co").alias("delivery_company"), F.lit("T").alias("tracking_number"), F.lit("").alias("delivery_date"), F.lit(None).cast("string").alias("notes"))
bookings = spark.range(5000).select(F.col("id"), F.lit("C").alias("customer_name"), F.lit("1").alias("customer_phone"), F.lit("A").alias("customer_address"),
    F.lit("Cash on Delivery").alias("payment_type"), F.lit(1).cast("decimal(10,2)").alias("amount"),
    F.when(F.col("id") % 2 == 0, "pending").otherwise("approved").alias("status"), F.lit(1).cast("long").alias("moderator_id"),
    F.lit(None).cast("long").alias("accountant_id"), F.lit(None).cast("long").alias("storeman_id"),
    F.lit(dt.datetime(2023,1,1)).cast("timestamp_ntz").alias("created_at"), F.lit(dt.datetime(2023,1,1)).cast("timestamp_ntz").alias("updated_at"))
out = W.workflow_rejections(bookings, cmds)
rows = out.count()
spark.stop()
# Per stage: shuffle records read per task; report the stage with the largest single task.
tasks = {}
for f in glob.glob(os.path.join(evdir, "**", "events*"), recursive=True):
    for line in open(f, errors="ignore"):
        if '"SparkListenerTaskEnd"' not in line:
            continue
        e = json.loads(line)
        m = e.get("Task Metrics") or {}
        r = (m.get("Shuffle Read Metrics") or {}).get("Total Records Read", 0)
        tasks.setdefault(e["Stage ID"], []).append(r)
worst = max(tasks.values(), key=lambda v: max(v))
print(f"{mode}: result rows {rows}; largest task reads {max(worst)} shuffled rows, "
      f"median task {int(statistics.median(worst))}, tasks in that stage {len(worst)}")
