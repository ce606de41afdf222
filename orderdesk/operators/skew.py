"""Joins that stay balanced when one key holds a large share of the rows.

AQE splits skewed sort-merge-join partitions only when both inputs arrive
through their own shuffle; when the one-row-per-key side is already
partitioned by an earlier join or aggregate (the usual case here: a
per-booking state joined back to the commands), nothing splits the hot key
and one task gets all its rows. ``salted_join`` handles that case: a key with
more than ``ROWS_PER_SALT`` rows on the big side is split into as many salts
as its row count asks for, and its small-side row is copied once per salt.
Every hot key is split, whatever their number.

The salt is a hash of the row's content and of the partition it is read in,
so a retried task gives its rows the same salts and equal rows spread too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows of one key that a task may take; a key with more is split.
ROWS_PER_SALT = 1_000_000


def hot_keys(df: DataFrame, key: str) -> DataFrame:
    """The keys of ``df`` with more than ``ROWS_PER_SALT`` rows and their
    number of salts: ``key, __salts``. At most one row per ``ROWS_PER_SALT``
    rows of ``df``, so its broadcast is bounded (16 bytes per million rows)."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    return (counts.filter((F.col("__n") > ROWS_PER_SALT) & F.col(key).isNotNull())
            .select(key, F.ceil(F.col("__n") / ROWS_PER_SALT).cast("int").alias("__salts")))


def salted_join(big: DataFrame, small: DataFrame, key: str, how: str = "inner",
                hot: DataFrame | None = None) -> DataFrame:
    """``big.join(small, key, how)`` where ``small`` has at most one row per
    ``key``; hot keys of ``big`` are split over several tasks.

    ``hot`` (``key, __salts``, from ``hot_keys``) may be computed once on a
    cheaper input, e.g. the key column of the table ``big`` was filtered
    from: the result is the same for any such list, only the balance depends
    on it. Rows without a key match nothing and are spread as they are.
    """
    if hot is None:
        hot = hot_keys(big.select(key), key)
    # Grouped, so that no row is copied twice whatever list is passed.
    hot = F.broadcast(hot.groupBy(key).agg(F.max("__salts").alias("__salts")))
    place = F.xxhash64(*[F.col(c) for c in big.columns], F.spark_partition_id())
    b = (big.join(hot, key, "left")
         .withColumn("__salt", F.when(F.col(key).isNull() | F.col("__salts").isNotNull(),
                                      F.pmod(place, F.coalesce(F.col("__salts"), F.lit(ROWS_PER_SALT))))
                     .otherwise(F.lit(0)).cast("int"))
         .drop("__salts"))
    copies = F.when(F.col("__salts").isNotNull(), F.sequence(F.lit(0), F.col("__salts") - 1)).otherwise(F.array(F.lit(0)))
    s = small.join(hot, key, "left").withColumn("__salt", F.explode(copies)).drop("__salts")
    return b.join(s, [key, "__salt"], how).drop("__salt")
