"""Place documents into shards by a hierarchical weighted hash tree.

A tree of regions, racks and shards is descended with weighted hash draws: at
each node a child with weight w scores ``-ln(u) / w`` for the key's hash u of
that child, and the lowest score wins. A child's draw depends on the key and
on the child alone, so a change of weights moves keys only into (or out of)
the subtrees whose weights change. Growing opens a new rack or region when
the last is full; with full regions one more shard is a region of its own and
takes keys only into itself.

Edge cases: a null text has 0 bytes and the checksum of the empty text; a
null document id is a key of its own; repeated rows go to the same shard and
get slots of their own; an empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import broadcast_if_small, checkpointed

SHARDS = 40
SHARDS_PER_RACK = 5
RACKS_PER_REGION = 2
ROWS_PER_SLOT_RANGE = 50_000
ROW_BYTES = 16

Tree = dict[str, list[tuple[str, float]]]


def uniform_tree(n_shards: int, per_rack: int = SHARDS_PER_RACK, racks: int = RACKS_PER_REGION,
                 weights: dict[int, float] | None = None) -> Tree:
    """Parent node -> [(child, weight)] for shards 0..n-1; a leaf is the shard's number.

    ``weights`` overrides the weight 1 of single shards; a node weighs the sum of its leaves.
    """
    tree: Tree = {}
    total: dict[str, float] = {}
    for shard in range(n_shards):
        weight = (weights or {}).get(shard, 1.0)
        region, rack = f"r{shard // (per_rack * racks)}", f"r{shard // (per_rack * racks)}k{shard // per_rack}"
        for parent, child in (("", region), (region, rack), (rack, str(shard))):
            if child not in total:
                tree.setdefault(parent, []).append((child, 0.0))
            total[child] = total.get(child, 0.0) + weight
    return {parent: [(c, total[c]) for c, _ in children] for parent, children in tree.items()}


def shard_of(key: Column, tree: Tree, levels: int = 3) -> Column:
    """The shard of a (possibly null) key: one weighted hash draw per level."""
    children = F.create_map(*[x for parent, nodes in tree.items() for x in (
        F.lit(parent), F.array(*[F.struct(F.lit(c).alias("node"), F.lit(float(w)).alias("weight")) for c, w in nodes]))])

    def draw(child: Column) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(key, child["node"]), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
        return F.struct((-F.log(u) / child["weight"]).alias("score"), child["node"].alias("node"))

    node = F.lit("")
    for _ in range(levels):
        node = F.array_min(F.transform(F.element_at(children, node), draw))["node"]
    return node.cast("int")


def placed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_shards: int = SHARDS) -> DataFrame:
    """``docs`` with ``__shard``, ``__grown_shard``, ``__size`` and ``__crc32``."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return (docs.withColumn("__size", (F.octet_length(body) + ROW_BYTES).cast("long"))
            .withColumn("__crc32", F.crc32(body))
            .withColumn("__shard", shard_of(F.col(doc_id), uniform_tree(n_shards)))
            .withColumn("__grown_shard", shard_of(F.col(doc_id), uniform_tree(n_shards + 1))))


def with_slots(rows: DataFrame, doc_id: str = "doc_id", n_shards: int = SHARDS,
               rows_per_range: int = ROWS_PER_SLOT_RANGE) -> DataFrame:
    """``rows`` (placed) with ``__slot``, gapless from 0 within each shard.

    A shard's rows are dealt into hash ranges, numbered within each and offset
    by the counts of the ranges before, so no task orders a whole shard. The
    number of ranges follows the number of rows.
    """
    ranges = max(1, math.ceil(rows.count() / (n_shards * rows_per_range)))
    rows = rows.withColumn("__range", F.pmod(F.xxhash64(doc_id, "__crc32", "__size"), F.lit(ranges)))
    before = Window.partitionBy("__shard").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = checkpointed(rows.groupBy("__shard", "__range").agg(F.count("*").alias("__n"))
                           .select("__shard", "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")))
    within = Window.partitionBy("__shard", "__range").orderBy(doc_id, "__crc32", "__size")
    return (rows.withColumn("__at", F.row_number().over(within) - 1)
            .join(broadcast_if_small(offsets), ["__shard", "__range"])
            .withColumn("__slot", F.col("__before") + F.col("__at"))
            .drop("__range", "__at", "__before"))


def shard_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_shards: int = SHARDS,
                rows_per_range: int = ROWS_PER_SLOT_RANGE) -> DataFrame:
    """Narrow rows (id, size, checksum, shards, slot); the texts are read once and not moved."""
    narrow = checkpointed(placed(docs.select(doc_id, text), doc_id, text, n_shards).drop(text))
    return with_slots(narrow, doc_id, n_shards, rows_per_range)
