"""One-pass conditional aggregates (the reference runs one query per figure).

Every figure of a dashboard or stats strip becomes one ``count_if``/``sum``
inside a single global aggregation: one scan, partial aggregation per task,
one tiny final merge.
"""

from __future__ import annotations

from typing import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_where(pred: Column) -> Column:
    """``SUM(CASE WHEN pred THEN 1 ELSE 0 END)`` shown through ``?? 0``."""
    return F.count_if(F.coalesce(pred, F.lit(False)))


def sum_where(pred: Column, x: Column) -> Column:
    """``COALESCE(SUM(CASE WHEN pred THEN x ELSE 0 END), 0)``."""
    return F.coalesce(F.sum(F.when(pred, x).otherwise(F.lit(0))), F.lit(0))


def status_counts(df: DataFrame, status_col: str, buckets: Mapping[str, str],
                  total: str | None = None) -> DataFrame:
    """``{output name: status value}`` counts, plus ``COUNT(*)`` as ``total``."""
    s = F.col(status_col)
    aggs = [F.count(F.lit(1)).alias(total)] if total else []
    aggs += [count_where(s == value).alias(name) for name, value in buckets.items()]
    return df.select(status_col).agg(*aggs)


def one_row(*parts: DataFrame) -> DataFrame:
    """Glue single-row aggregates with disjoint columns into one row.

    Each part is a one-row global aggregate; they are unioned (missing columns
    NULL) and folded with ``max``, so no join between them is needed.
    """
    cols = [c for p in parts for c in p.columns]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p, allowMissingColumns=True)
    return u.agg(*[F.max(c).alias(c) for c in cols])
