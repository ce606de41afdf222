"""Mix sources to target weights.

Tokens are summed per source, each source gets a target by its weight, and a
document is emitted ``floor(rate)`` times plus one more time when a
hash-seeded Bernoulli draw with the fraction of the rate as its probability
succeeds (rate = target / source size). Draws depend on the seed, the
document id and the text only, so reruns and retried tasks agree.

Targets: all sizes together are shared by weight; a target stops at
``max_rate`` times its source's size and the excess is reshared by weight
among the others until none is above. That fixed point is
``target = min(max_rate * size, level * weight)`` for one level, found by a
few one-row aggregates over the table of sources.

Edge cases: a null text has size 0; a null source is a source of its own and
ranks last; a source without any word gets target 0 and its documents are
kept once (they weigh nothing); repeated rows draw alike when id and text are
equal; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import broadcast_if_small, checkpointed, columns_of, md5_unit, word_count

WEIGHTS = (1, 2, 3)
MAX_RATE = 3
SEED = 20240


def with_rank(df: DataFrame, key: str) -> DataFrame:
    """``df`` with ``__rank`` (0-based, ascending by ``key``, null last).

    Range partitions are counted and offset, so no task holds all keys; the
    window runs over one row per partition.
    """
    parts = checkpointed(
        df.repartitionByRange(F.col(key).asc_nulls_last()).sortWithinPartitions(F.col(key).asc_nulls_last())
        .withColumn("__part", F.spark_partition_id())
        .withColumn("__at", F.monotonically_increasing_id() - F.shiftleft(F.col("__part").cast("long"), 33)))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (parts.groupBy("__part").agg(F.count("*").alias("__n"))
               .select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")))
    return (parts.join(F.broadcast(offsets), "__part")  # one row per range partition
            .withColumn("__rank", F.col("__before") + F.col("__at")).drop("__part", "__at", "__before"))


def source_targets(docs: DataFrame, source: str = "source", text: str = "text",
                   weights: tuple[float, ...] = WEIGHTS, max_rate: float = MAX_RATE) -> DataFrame:
    """One row per source: ``__source``, ``__source_size``, ``__target``, ``__rate``."""
    sizes = (docs.select(F.col(source).alias("__source"), word_count(F.col(text)).alias("__size"))
             .groupBy("__source").agg(F.sum("__size").alias("__source_size")))
    ranked = with_rank(checkpointed(sizes), "__source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.col("__rank") % len(weights) + 1).cast("int"))
    table = checkpointed(ranked.select("__source", "__source_size", weight.alias("__weight")))
    level = _level(table, max_rate)
    cap = F.lit(float(max_rate)) * F.col("__source_size")
    size = F.col("__source_size")
    return (table.withColumn("__target", F.least(F.lit(level) * F.col("__weight"), cap))
            .withColumn("__rate", F.when(size > 0, F.least(F.col("__target") / size, F.lit(float(max_rate))))
                        .otherwise(F.lit(1.0)))
            .drop("__weight"))


def _level(table: DataFrame, max_rate: float) -> float:
    """The level L with sum(min(max_rate * size, L * weight)) = sum(size)."""
    level, capped = 0.0, -1
    while True:
        above = F.lit(level) * F.col("__weight") > F.lit(float(max_rate)) * F.col("__source_size")
        row = table.agg(
            F.sum("__source_size").alias("total"), F.sum("__weight").alias("weight"),
            F.count(F.when(above, 1)).alias("n"),
            F.sum(F.when(above, F.col("__source_size"))).alias("cap_size"),
            F.sum(F.when(above, F.col("__weight"))).alias("cap_weight")).first()
        if row["n"] == capped:
            return level
        capped = row["n"]
        free = (row["weight"] or 0.0) - (row["cap_weight"] or 0.0)
        if free <= 0:
            return level
        level = (float(row["total"] or 0) - float(max_rate) * (row["cap_size"] or 0)) / free


def copies(rate: Column, doc_id: Column, text: Column, seed: int = SEED) -> Column:
    """floor(rate) plus one with the fraction of the rate as probability."""
    draw = md5_unit(F.lit(seed), doc_id, F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
          weights: tuple[float, ...] = WEIGHTS, max_rate: float = MAX_RATE, seed: int = SEED) -> DataFrame:
    """``docs`` with ``__source_size``, ``__target`` and ``__copies`` per row."""
    table = broadcast_if_small(checkpointed(source_targets(docs, source, text, weights, max_rate)))
    return (docs.join(table, docs[source].eqNullSafe(table["__source"]), "left")
            .withColumn("__copies", copies(F.col("__rate"), F.col(doc_id), F.col(text), seed))
            .drop("__source", "__rate"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as it was drawn."""
    columns = columns_of(docs)
    return (mixed(docs, **options).filter(F.col("__copies") > 0)
            .withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))))
            .select(*columns))
