"""Shared helpers of the corpus operators.

Internal columns start with ``__`` so that extra columns of the input never
clash with them.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Bytes up to which a table may be broadcast; beyond it Spark joins by shuffle.
BROADCAST_BYTES = 8 << 20

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns_of(df: DataFrame) -> list[Column]:
    """All columns, quoted, so that any name works in a select."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the session names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a scratch folder; on a
    cluster a missing setting is an error, since a driver-local folder cannot
    be read by executors.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            sc.setCheckpointDir(named)
        return
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="orderdesk-llm-"))


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def counted(df: DataFrame, what: Column | None = None) -> tuple[DataFrame, int]:
    """``df`` checkpointed, and its number of rows (or of those where ``what`` is true), counted as it is written."""
    seen = Observation()
    rows = F.count(F.lit(1)) if what is None else F.count(F.when(what, 1))
    out = checkpointed(df.observe(seen, rows.alias("n")))
    return out, int(seen.get["n"])


def stored(df: DataFrame, *partition_by: str) -> DataFrame:
    """``df`` written once as a table in the shared checkpoint folder and read back; cuts lineage like a checkpoint,
    in a compressed, columnar form."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def measured_bytes(df: DataFrame) -> int:
    """Bytes of all rows as JSON text, from one partial aggregate."""
    row = df.select(F.octet_length(F.to_json(F.struct(*columns_of(df)))).alias("__b")).agg(
        F.sum("__b").alias("b")).first()
    return int(row["b"] or 0)


def is_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the measured rows of a checkpointed (or otherwise cheap) frame may be broadcast."""
    return measured_bytes(df) <= limit


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint when its measured size is within ``limit``.

    A larger frame comes back without a hint and is joined by shuffle, where
    AQE splits skewed keys.
    """
    return F.broadcast(df) if is_small(df, limit) else df


def broadcast_if_few(df: DataFrame, rows: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, of a few numbers a row, with a broadcast hint when at most ``rows`` rows of 80 bytes are within ``limit``."""
    return F.broadcast(df) if rows * 80 <= limit else df


def word_count(text: Column) -> Column:
    """Number of maximal runs outside space and \\x09-\\x0D; null gives 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def md5_unit(*parts: Column) -> Column:
    """A number in [0, 1) from the md5 of the parts; a null part counts as empty."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
