"""Optional relational-database source (the reference reads a MySQL database).

Needs the JDBC driver jar on the classpath; not exercised by the tests (no
database server is started here). Reads are split into ``num_partitions``
ranges of the primary key so a large table is not pulled through one task.
"""

from __future__ import annotations

from typing import Optional

from pyspark.sql import DataFrame, SparkSession

from . import schemas as S
from .driver import Tables


def read_table(spark: SparkSession, url: str, table: str, user: str, password: str,
               lower: int, upper: int, num_partitions: int, key: str = "id",
               driver: Optional[str] = None) -> DataFrame:
    """One table, read in ``num_partitions`` ranges of ``key`` from ``lower`` to ``upper``."""
    reader = (spark.read.format("jdbc").option("url", url).option("dbtable", table)
              .option("user", user).option("password", password))
    if driver:
        reader = reader.option("driver", driver)
    df = (reader.option("partitionColumn", key).option("lowerBound", lower)
          .option("upperBound", upper).option("numPartitions", num_partitions).load())
    wanted = [f.name for f in S.LOGICAL[table].fields] if table in S.LOGICAL else df.columns
    return df.select(*[c for c in wanted if c in df.columns])


def jdbc_tables(spark: SparkSession, url: str, user: str, password: str,
                bounds: dict[str, tuple[int, int, int]], driver: Optional[str] = None) -> Tables:
    """The six database tables, read lazily over JDBC. ``bounds`` names for
    every table the least and greatest id and the number of ranges to read."""
    missing = set(S.LOGICAL) - set(bounds)
    if missing:
        raise ValueError(f"no id bounds for: {sorted(missing)}")
    return Tables(**{name: (lambda n=name: read_table(spark, url, n, user, password, *bounds[n], driver=driver))
                     for name in S.LOGICAL})
