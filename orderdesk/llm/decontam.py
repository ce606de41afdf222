"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are compared lower-cased with every run of whitespace as
one space. An item of m characters may be matched with ``k = floor(m *
error_rate)`` edits. It is split into k + 1 pieces: an occurrence with at most
k edits leaves one piece untouched, so every occurrence is found by exact
search for the pieces (one Aho-Corasick automaton over all pieces) and then
confirmed by Myers' bit-parallel distance on the window the piece implies.

An item too short for an edit (under 13 characters) must stand as whole words;
items under ``MIN_CHARS`` characters say nothing and are not searched:
``skipped`` lists them.

The distinct normalized items are dealt into slices of a bounded number of
bytes by a hash of their text. One slice at a time is on the driver and in the
tasks: its hits are stored in the shared folder and its broadcast is destroyed
before the next one, and every document is read whole against every slice. A
benchmark of one slice needs no storing.

Defined results: a null or blank item matches nothing; a null or empty text
matches nothing; items without id are searched and reported with a null id;
equal items are reported each under its id; repeated documents are reported
alike; empty tables give an empty result; other columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, checkpointed, stored

ERROR_RATE = 0.08
MIN_CHARS = 5
SLICE_BYTES = 2 << 20

_HIT = pa.struct([("item", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("distance", pa.int64())])
_HIT_DDL = "array<struct<item: string, start: long, end: long, distance: long>>"


def normalized(text: str) -> str:
    return " ".join(text.lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece): ``budget + 1`` nearly equal parts."""
    cuts = [i * len(item) // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def char_masks(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def distances(masks: dict[str, int], size: int, text: str, anchored: bool = False) -> Iterator[int]:
    """Myers' distance of the pattern to the best substring of ``text`` that ends at each character.

    ``anchored``: substrings that start at the first character only.
    """
    full, top = (1 << size) - 1, 1 << (size - 1)
    up, down, score = full, 0, size
    for c in text:
        eq = masks.get(c, 0)
        vertical = eq | down
        across = (((eq & up) + up) ^ up) | eq
        plus, minus = down | (full & ~(across | up)), up & across
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus, minus = (plus << 1 | anchored) & full, (minus << 1) & full
        up, down = minus | (full & ~(vertical | plus)), plus & vertical
        yield score


def _place(body: str, item: str, whole_words: bool) -> int:
    """The first place of ``item`` in ``body``, -1 if none; with ``whole_words`` no letter or digit may go on beyond it."""
    at = body.find(item)
    while whole_words and at >= 0:
        end = at + len(item)
        if not (at and body[at - 1].isalnum() and item[0].isalnum()) and not (
                end < len(body) and body[end].isalnum() and item[-1].isalnum()):
            break
        at = body.find(item, at + 1)
    return at


class Matcher:
    """All pieces of a slice of items in one automaton."""

    def __init__(self, items: tuple[tuple[str, str], ...], error_rate: float):
        self.items = []
        where: dict[str, list[tuple[int, int]]] = {}
        for name, text in items:
            body = normalized(text)
            if len(body) < MIN_CHARS:
                continue
            budget = math.floor(len(body) * error_rate)
            for offset, piece in pieces(body, budget):
                where.setdefault(piece, []).append((len(self.items), offset))
            self.items.append((name, body, budget, char_masks(body)))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        if where:
            self.automaton.make_automaton()
        self.empty = not where

    def hits(self, text: str) -> list[dict]:
        """The best match of every item that occurs in ``text``, in characters of the normalized text."""
        if self.empty or not text:
            return []
        body = normalized(text)
        best: dict[int, tuple[int, int]] = {}
        starts: dict[int, set[int]] = {}
        for last, (size, places) in self.automaton.iter(body):
            for number, offset in places:
                starts.setdefault(number, set()).add(last + 1 - size - offset)
        for number, diagonals in starts.items():
            _, item, budget, masks = self.items[number]
            at = _place(body, item, whole_words=budget == 0)
            if at >= 0:
                best[number] = (0, at + len(item))
            if at >= 0 or budget == 0:
                continue
            lo = hi = None
            windows = []
            for start in sorted(diagonals):  # windows that overlap are searched as one
                a, b = max(0, start - budget), start + len(item) + budget
                if hi is not None and a <= hi:
                    hi = max(hi, b)
                else:
                    if hi is not None:
                        windows.append((lo, hi))
                    lo, hi = a, b
            windows.append((lo, hi))
            for a, b in windows:
                for j, score in enumerate(distances(masks, len(item), body[a:b])):
                    if score <= budget and (number not in best or score < best[number][0]):
                        best[number] = (score, a + j + 1)
        return [self._located(body, number, *best[number]) for number in sorted(best)]

    def _located(self, body: str, number: int, distance: int, end: int) -> dict:
        name, item, budget, _ = self.items[number]
        start = end - len(item)
        if distance:
            back = body[max(0, end - len(item) - budget):end][::-1]
            for j, score in enumerate(distances(char_masks(item[::-1]), len(item), back, True)):
                if score == distance:
                    start = end - j - 1
                    break
        return {"item": name, "start": start, "end": end, "distance": distance}


def _items(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    """``__item`` (id), ``__text`` and ``__name``, the name of the distinct text."""
    lower = F.trim(F.regexp_replace(F.lower(F.col(text).cast("string")), r"\s+", " "))
    return benchmark.select(F.col(item_id).cast("long").alias("__item"), F.col(text).cast("string").alias("__text"),
                            F.md5(lower.cast("binary")).alias("__name")).filter("__text IS NOT NULL")


def skipped(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """The items that are not searched, because they are blank or shorter than ``MIN_CHARS``."""
    def short(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array([len(normalized(t.as_py() or "")) < MIN_CHARS for t in batch], pa.bool_())

    short.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return benchmark.filter(F.arrow_udf(short, "boolean")(F.col(text).cast("string"))).select(F.col(item_id), F.col(text))


def _finder(held, error_rate: float):
    """A column function: text -> the hits of a slice of items (broadcast)."""
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        matcher = Matcher(held.value, error_rate)
        for batch in texts:
            yield pa.array([matcher.hits(t.as_py() or "") for t in batch], pa.list_(_HIT))

    run.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, _HIT_DDL)


def _over_slices(items: DataFrame, slice_bytes: int, error_rate: float, hits_of) -> DataFrame:
    """``hits_of(find)`` for all slices of the distinct items; of several slices each is stored before the next."""
    distinct = items.groupBy("__name").agg(F.min("__text").alias("__text"))
    total = distinct.agg(F.sum(F.octet_length("__text")).alias("b")).first()["b"] or 0
    n, out = max(1, math.ceil(total / slice_bytes)), None
    for k in range(n):
        part = distinct.filter(F.pmod(F.xxhash64("__name"), F.lit(n)) == k) if n > 1 else distinct
        held = items.sparkSession.sparkContext.broadcast(tuple(sorted((r["__name"], r["__text"]) for r in part.collect())))
        rows = hits_of(_finder(held, error_rate))
        if n > 1:
            rows = stored(rows)
            held.destroy()
        out = rows if out is None else out.union(rows)
    return out


def contaminations(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                   item_id: str = "item_id", item_text: str = "text", error_rate: float = ERROR_RATE,
                   slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """One row per document and item that occurs in it: ``doc_id, item_id, start, end, distance``."""
    items = _items(benchmark, item_id, item_text)
    hits = _over_slices(items, slice_bytes, error_rate, lambda find: docs.select(
        F.col(doc_id).alias("__id"), F.explode(find(F.col(text))).alias("__hit")).select("__id", "__hit.*"))
    names = broadcast_if_small(items.select("__item", F.col("__name").alias("item")))
    return hits.join(names, "item").select(F.col("__id").alias(doc_id), F.col("__item").alias("item_id"), "start", "end", "distance")


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
                   item_text: str = "text", error_rate: float = ERROR_RATE, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """``docs`` without the documents that hold a test item.

    With one slice rows are filtered where they are; with several, the texts that hold an item are gathered by a
    128-bit name, slice by slice, and taken out at the end."""
    items = _items(benchmark, item_id, item_text)
    body = F.col(text).cast("string")
    if (items.agg(F.sum(F.octet_length("__text")).alias("b")).first()["b"] or 0) <= slice_bytes:
        return _over_slices(items, slice_bytes, error_rate, lambda find: docs.filter(F.size(find(body)) == 0))
    name = (F.xxhash64(body).alias("__t1"), F.xxhash64(F.lit(1), body).alias("__t2"))
    bad = _over_slices(items, slice_bytes, error_rate, lambda find: docs.filter(F.size(find(body)) > 0).select(*name).distinct())
    bad = broadcast_if_small(checkpointed(bad.distinct()))
    return docs.join(bad, (name[0] == bad["__t1"]) & (name[1] == bad["__t2"]), "left_anti")
