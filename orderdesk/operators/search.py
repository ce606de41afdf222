"""Substring search through an index of trigrams.

The searches of the list pages are substring tests over a few columns, with
the user's ``%`` and ``_`` still wildcards. A scan answers them by testing
every row. The index holds, per searched text, its distinct trigrams
(lower-cased) with the row's id, laid out by trigram. A pattern's literal
stretches of three characters or more name trigrams that a matching text must
hold; the ids that hold the rarest few of them are candidates, and the
predicate itself then decides on these rows alone. A pattern without such a
stretch asks for a scan.

The index may hold more than is true now (trigrams of texts that have since
changed): a candidate is always tested. So it is only ever appended to.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from typing import Mapping, Optional

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Trigrams of a pattern that are looked up, the rarest first: each further one
# removes few candidates and costs reading its list.
LOOKED_UP = 4


def grams(text: Column) -> Column:
    """The distinct trigrams of a text, lower-cased."""
    low = F.lower(text.cast("string"))
    every = F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda i: F.substring(low, i, F.lit(3)))
    return F.array_distinct(F.when(F.length(low) >= 3, every).otherwise(F.array().cast("array<string>")))


def postings(df: DataFrame, id_col: str, texts: Mapping[str, Column]) -> DataFrame:
    """``gram_hash, place, gram, id``: one row per row, searched text (``place``: its name) and trigram."""
    places = F.array(*[F.struct(F.lit(name).alias("place"), grams(text).alias("grams")) for name, text in texts.items()])
    each = (df.select(F.col(id_col).alias("__row"), F.explode(places).alias("__p"))
            .select("__row", F.col("__p.place").alias("place"), F.explode("__p.grams").alias("gram")))
    return each.select(F.xxhash64("gram").alias("gram_hash"), "place", "gram", F.col("__row").alias("id"))


def lists(df: DataFrame, id_col: str, texts: Mapping[str, Column], a: "Asked") -> DataFrame:
    """The part of ``postings`` that a pattern asks for, made without the rest: for a search without a stored index."""
    wanted = F.array(*[F.lit(g) for g in a.grams])
    places = F.array(*[F.struct(F.lit(name).alias("place"), F.lower(text.cast("string")).alias("low")) for name, text in texts.items()])
    each = (df.select(F.col(id_col).alias("__row"), F.explode(places).alias("__p"))
            .select("__row", F.col("__p.place").alias("place"), F.explode(F.filter(
                wanted, lambda g: F.contains(F.col("__p.low"), g))).alias("gram")))
    return each.select(F.xxhash64("gram").alias("gram_hash"), "place", "gram", F.col("__row").alias("id"))


@dataclass(frozen=True)
class Asked:
    """What a pattern asks of the index: trigrams that every matching text holds; none: scan."""

    grams: tuple[str, ...]

    @property
    def scan(self) -> bool:
        return not self.grams


def asked(spark: SparkSession, pattern: str, wildcards: bool = True) -> Asked:
    """The trigrams of a search text; with ``wildcards`` its ``%`` and ``_`` stand for other characters."""
    low = spark.range(1).select(F.lower(F.lit(pattern))).first()[0]  # lower-cased as the texts are
    parts = re.split(r"[%_]", low) if wildcards else [low]
    return Asked(tuple(sorted({p[i:i + 3] for p in parts for i in range(len(p) - 2)})))


def hashes(spark: SparkSession, a: Asked) -> DataFrame:
    """The hashes of a pattern's trigrams (a handful of rows), to find the files that hold them."""
    return spark.createDataFrame([(g,) for g in a.grams], "gram string").select(F.xxhash64("gram").alias("gram_hash"))


def candidates(index: DataFrame, a: Asked) -> DataFrame:
    """``id`` of the rows with a text that holds the rarest trigrams of a pattern, all in one place.

    The lists are counted by partial aggregation; the counts, a row per trigram of the pattern, come to the driver."""
    lists = index.filter(F.col("gram").isin(*a.grams))
    counts = {r["gram"]: r["n"] for r in lists.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).collect()}
    if set(counts) != set(a.grams):  # some trigram is in no text
        return index.select("id").limit(0)
    rare = sorted(a.grams, key=lambda g: (counts[g], g))[:LOOKED_UP]
    held = (lists.filter(F.col("gram").isin(*rare)).groupBy("id", "place")
            .agg(F.bit_or(reduce(lambda other, k: F.when(F.col("gram") == rare[k], 1 << k).otherwise(other),
                                 range(len(rare)), F.lit(0))).alias("held")))
    return held.filter(F.col("held") == (1 << len(rare)) - 1).select("id").distinct()


def found(spark: SparkSession, index: DataFrame, pattern: str, wildcards: bool = True) -> Optional[DataFrame]:
    """The candidates of a pattern; None if it has to be answered by a scan."""
    a = asked(spark, pattern, wildcards)
    return None if a.scan else candidates(index, a)
