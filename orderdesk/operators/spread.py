"""Shuffles whose number of partitions follows the rows.

A cluster's number of shuffle partitions is fixed, so what one task sorts and
aggregates after a shuffle grows with the input. Where every row of a large
table goes through a shuffle on keys that hardly repeat, the steps here ask for
as many partitions as the rows need: a task then holds about ``ROWS_PER_TASK``
rows, whatever the size of the input. Counts of rows read no column of a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import skew

ROWS_PER_TASK = 1 << 18
# Number of rows and parts of a key (``dealing``).
Dealing = tuple[int, Column | None]
# Buckets of keys whose rows are counted to find the hot ones.
_BUCKETS = 1 << 16


def partitions(rows: int) -> int:
    return max(1, -(-rows // ROWS_PER_TASK))


def spread(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """``df`` dealt by ``keys``; windows, groups and joins on them, or on more columns, need no further shuffle."""
    return df.repartition(partitions(df.count() if rows is None else rows), *keys)


def dealing(df: DataFrame, key: str) -> Dealing:
    """Number of rows, and in how many parts the rows of a key are dealt (None: no key is split).

    Rows are counted per bucket of keys, combined map-side. A bucket with more than ``skew.ROWS_PER_SALT`` rows holds
    a hot key or a few warm ones, and all its keys are split; there is at most one such bucket per that many rows."""
    bucket = F.pmod(F.xxhash64(key), F.lit(_BUCKETS))
    counts = df.filter(F.col(key).isNotNull()).groupBy(bucket.alias("__bucket")).agg(F.count(F.lit(1)).alias("__n"))
    full = F.when(F.col("__n") > skew.ROWS_PER_SALT, F.struct("__bucket", "__n"))
    row = counts.agg(F.sum("__n").alias("n"), F.collect_list(full).alias("full")).first()
    salts = [F.lit(x) for b, n in row["full"] for x in (b, -(-n // skew.ROWS_PER_SALT))]
    return row["n"] or 0, F.coalesce(F.create_map(*salts)[bucket], F.lit(1)) if salts else None


def spread_join(big: DataFrame, small: DataFrame, key: str, within: str, how: str = "inner",
                dealt: Dealing | None = None) -> DataFrame:
    """``big.join(small, key, how)``, inner or left semi, dealt by ``key``: a group by it needs no further shuffle.

    Hot keys of ``big`` are split by ``within``; then a group by ``key`` has its own shuffle, combined map-side.
    ``dealt`` is the ``dealing`` of ``big`` or of a table it was filtered from: only the balance depends on it."""
    if big.schema[key].dataType != small.schema[key].dataType:
        raise TypeError(f"{key}: hashes of equal keys differ between types")
    big, small = big.filter(F.col(key).isNotNull()), small.filter(F.col(key).isNotNull())
    rows, salts = dealing(big, key) if dealt is None else dealt
    n = partitions(rows)
    if salts is None:
        return big.repartition(n, key).join(small.repartition(n, key), key, how)
    b = big.withColumn("__salt", F.pmod(F.xxhash64(within), salts).cast("int"))
    s = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), (salts - 1).cast("int"))))
    return b.repartition(n, key, "__salt").join(s.repartition(n, key, "__salt"), [key, "__salt"], how).drop("__salt")
