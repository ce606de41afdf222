"""Sinks: CSV report export, JSON documents, and a versioned commit of
several outputs (the reference's multi-table transaction; see ``versions``).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import versions as V


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header line (one file per task; the export is not funnelled
    through a single task)."""
    df.write.mode(mode).option("header", True).csv(path)


def write_csv_file(df: DataFrame, path: str) -> None:
    """One CSV file with a header line, rows in the order of ``df``: the download of a report.

    For reports, whose rows are bounded by the calendar or a top-n: one task writes them. The file appears
    under its name when it is whole; an existing one is replaced."""
    spark = df.sparkSession
    fs, target = V.file_system(spark, path)
    own = f"{path}.{uuid.uuid4().hex}"
    df.coalesce(1).write.option("header", True).csv(own)
    parts = [n for n in V.names_in(spark, own) if n.startswith("part-")]
    if parts:
        if fs.exists(target):
            fs.delete(target, False)
        fs.rename(V.file_system(spark, f"{own}/{parts[0]}")[1], target)
    fs.delete(V.file_system(spark, own)[1], True)


def write_json_documents(df: DataFrame, path: str, column: str = "document", mode: str = "overwrite") -> None:
    """One JSON document per line, as produced by ``booking_document``."""
    df.select(F.col(column).alias("value")).write.mode(mode).text(path)


def commit_versioned(spark: SparkSession, outputs: dict[str, DataFrame], root: str, version: str) -> bool:
    """Write ``outputs`` under ``root`` and commit them together as ``version``.
    The outputs replace their tables whole, so a commit that came in between
    does not matter: it becomes the base. False when the version is committed
    already, by whichever attempt."""
    while True:
        try:
            return V.committed(V.latest(spark, root), version, {name: V.Write(df) for name, df in outputs.items()})[1]
        except V.StaleBase:
            continue


def current_version(spark: SparkSession, root: str) -> str:
    """The newest committed version under ``root``."""
    return V.latest(spark, root).version


def read_current(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One output of the newest version; to read several of one version take ``versions.latest`` once."""
    return V.latest(spark, root).read(name)


def read_version(spark: SparkSession, root: str, name: str, version: str) -> DataFrame:
    """Read one output of a committed version."""
    snapshot = V.version_of(spark, root, version)
    if snapshot is None:
        raise ValueError(f"version {version} is not committed under {root}")
    return snapshot.read(name)
