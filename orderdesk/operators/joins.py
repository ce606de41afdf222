"""Lookup joins of the small dimensions.

No side is hinted: Catalyst broadcasts a side whose known size is below the
session's threshold, AQE does so from measured shuffle bytes, and a larger
side is joined by shuffle, where AQE splits skewed keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_user_names(b: DataFrame, users: DataFrame, roles: dict[str, str]) -> DataFrame:
    """Left-join the users table once per role: ``{fk column: output name}``.

    The same dimension is joined several times under different roles
    (moderator, accountant, storeman). Every join uses an identical side,
    renamed only after the join, so Spark builds it once and reuses it.
    """
    names = users.select(F.col("id").alias("__uid"), F.col("full_name").alias("__uname"))
    out = b
    for fk, alias in roles.items():
        out = (out.join(names, out[fk] == names["__uid"], "left")
               .drop("__uid").withColumnRenamed("__uname", alias))
    return out


def product_dim(products: DataFrame, *cols: str) -> DataFrame:
    """Pruned product columns keyed by ``product_id``."""
    return products.select(F.col("id").alias("product_id"), *cols)


def with_known_products(lines: DataFrame, products: DataFrame) -> DataFrame:
    """``lines`` with a null ``product_id`` where the catalogue has no such product."""
    known = products.select(F.col("id").alias("product_id"), F.lit(True).alias("__known")).distinct()
    return (lines.join(known, "product_id", "left")
            .withColumn("product_id", F.when(F.col("__known"), F.col("product_id"))).drop("__known"))
