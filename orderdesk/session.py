"""Spark session defaults for the order-booking jobs.

On a cluster the session is created by the platform; ``configure`` only fills
in settings that are unset, so cluster-wide choices (shuffle partitions,
checkpoint directory, broadcast thresholds) always win.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on. AQE re-plans joins from measured shuffle sizes,
# coalesces small partitions and splits skewed join partitions (a hot booking
# or product in a join); aggregates pre-combine hot keys map-side. Size-based
# automatic broadcasts keep Spark's default threshold: it is compared with an
# estimate from compressed file sizes, so it is not raised here.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.files.maxPartitionBytes": "256MB",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[8]", app_name: str = "orderdesk",
                  shuffle_partitions: int = 8, driver_memory: str = "16g") -> SparkSession:
    """Local session for tests and the bench (a cluster passes its own)."""
    builder = (SparkSession.builder.master(master).appName(app_name)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", driver_memory))
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster must name a shared folder there; only a local session (tests,
    the bench) without one gets a scratch folder, since executors cannot read
    a folder of the driver.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="orderdesk-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    spark.sparkContext.setCheckpointDir(current)
    return current
