"""Collation: equality, DISTINCT and keys that ignore case.

The reference's database compares texts under the collation of its server,
where ``ring`` equals ``Ring``: a category in two spellings is one, a login
name in another case collides. Spark compares bytes unless a column's type
names a collation. ``collated`` gives the text columns of the tables such
types; every equality, DISTINCT, GROUP BY, join and key audit on them then
follows it, with no change to the plans. Binary stays the default, as for the
other results; searches ignore case either way.

``UTF8_LCASE`` compares lower-cased texts and is pushed through aggregates by
a lower-cased sort key; ``UNICODE_CI`` follows the Unicode rules (``ß`` and
``SS``), ``UNICODE_CI_AI`` ignores accents too, as the server's default does.
The form patterns (regular expressions) take ``UTF8_LCASE`` only.
"""

from __future__ import annotations

from typing import Iterable, Optional

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import schemas as S
from ..sources.driver import Tables

DEFAULT = "UTF8_LCASE"


def collated_schema(schema: T.StructType, collation: str = DEFAULT, columns: Optional[Iterable[str]] = None) -> T.StructType:
    """A declared schema with collated text columns (all, or the named ones)."""
    wanted = None if columns is None else set(columns)
    return T.StructType([
        T.StructField(f.name, T.StringType(collation), f.nullable)
        if isinstance(f.dataType, T.StringType) and (wanted is None or f.name in wanted) else f for f in schema.fields])


def collated_frame(df: DataFrame, collation: str = DEFAULT, columns: Optional[Iterable[str]] = None) -> DataFrame:
    """A table with collated text columns (all, or the named ones); the texts stay as they are."""
    wanted = None if columns is None else set(columns)
    return df.select(*[
        F.collate(F.col(f.name), collation).alias(f.name)
        if isinstance(f.dataType, T.StringType) and (wanted is None or f.name in wanted) else F.col(f.name) for f in df.schema.fields])


def collated(t: Tables, collation: str = DEFAULT) -> Tables:
    """The six tables under a collation; nothing is read yet."""
    names = (*S.LOGICAL, "booking_core")
    return t.replace(**{n: (lambda n=n: collated_frame(getattr(t, n), collation)) for n in names if n != "booking_core"}).replace(
        booking_core=lambda: collated_frame(t.booking_core, collation))


def binary(c: Column) -> Column:
    """A collated text as a plain one, for outputs and exact comparisons."""
    return F.collate(c, "UTF8_BINARY")
