r"""Removal of repeated line chunks with content-defined boundaries.

A text is cut into lines at ``\n``. A rolling hash runs over the hashes of the
lines, two at a time. A chunk ends after a line whose window with the next
line is found nowhere else in the corpus (or is blank): boundaries hang on the
nearby lines alone, so inserted or removed lines shift no other boundary, and
a chunk is a maximal run of lines in which every two neighbours are repeated.

A chunk of at least ``MIN_LINES`` lines that are not blank is removed when the
same lines stand elsewhere: as an equal chunk at an earlier place (smallest
document id, then place), or inside a longer chunk. Equal chunks meet by their
hash; a chunk looks for longer ones by its rarest window. Hashes only propose;
every removal compares the bytes of all lines.

Nothing repeated is lost: no window that crosses a chunk's edge is repeated, so
every run of two or more lines (not both blank) that occurs twice lies inside
chunks, and each chunk is kept, or stands whole in one that is: an earlier
equal one or a longer one, and so on up to one that is kept whole.

All work is DataFrame functions. Windows and chunks are counted with partial
aggregation and meet their counts and sources in salted joins, so a chunk
found in any share of the rows is no hot group; texts move to what they are
compared with.

Defined results: a null text stays null, an empty one empty. Rows alike in id
and text are one document and are treated alike; other rows that share an id
are documents of their own. A null id sorts first. A text whose chunks all
stand elsewhere becomes empty. Repeats of one document in itself count. An
empty table gives an empty table. Other columns are kept whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import ROWS_PER_SALT, salted_join
from .common import broadcast_if_small, checkpointed

MIN_LINES = 2

_DOC = ["__d1", "__d2"]


def _named(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``docs`` with a 128-bit name of its document (id and text)."""
    return docs.withColumns({"__d1": F.xxhash64(F.col(doc_id), F.col(text)),
                             "__d2": F.xxhash64(F.lit(1), F.col(text), F.lit("|"), F.col(doc_id))})


def _bodies(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return _named(docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text")).filter(
        F.contains(F.col("__text"), F.lit("\n"))), "__id", "__text").withColumn("__lines", F.split("__text", "\n", -1))


def _blank(line: Column) -> Column:
    return F.trim(F.translate(line, "\t\r\x0b\x0c", " ")) == ""


def windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``__id, __d1, __d2, __at, __window``: the rolling hash of every two lines in a row that are not both blank."""
    hashed = _bodies(docs, doc_id, text).withColumn(
        "__hashes", F.transform("__lines", lambda line: F.struct(F.xxhash64(line).alias("h"), _blank(line).alias("blank"))))
    rolling = F.transform(F.slice("__hashes", F.lit(1), F.size("__hashes") - 1), lambda h, i: F.struct(
        i.alias("at"), F.xxhash64(h["h"], F.get("__hashes", i + 1)["h"]).alias("w"),
        (h["blank"] & F.get("__hashes", i + 1)["blank"]).alias("blank")))
    return (hashed.select("__id", *_DOC, F.explode(F.filter(rolling, lambda r: ~r["blank"])).alias("__r"))
            .select("__id", *_DOC, F.col("__r.at").alias("__at"), F.col("__r.w").alias("__window")))


def _salted(large: DataFrame, small: DataFrame, key: str, count: str) -> DataFrame:
    """``large`` joined with the one row per key of ``small``; keys with many rows (``count``) are split."""
    hot = small.filter(F.col(count) > ROWS_PER_SALT).select(
        key, F.ceil(F.col(count) / ROWS_PER_SALT).cast("int").alias("__salts"))
    return salted_join(large, small, key, hot=hot)


def chunks(rows: DataFrame) -> DataFrame:
    """One row per chunk: its document, first line, number of lines, and its windows with how often each occurs."""
    counts = checkpointed(rows.groupBy("__window").agg(F.count("*").alias("__n")).filter("__n > 1"))
    found = _salted(rows, counts, "__window", "__n")
    marked = found.groupBy("__id", *_DOC).agg(F.array_sort(F.collect_set(F.struct("__at", "__window", "__n"))).alias("__w"))

    def edge(side: int):
        """Windows without a neighbour on one side."""
        def alone(w: Column, i: Column) -> Column:
            beside = F.get("__w", i + side)["__at"]
            return F.coalesce(beside != w["__at"] + side, F.lit(True))
        return F.transform(F.filter(F.transform("__w", lambda w, i: F.struct(alone(w, i).alias("edge"), i.alias("i"))),
                                    lambda e: e["edge"]), lambda e: e["i"])

    runs = F.zip_with(edge(-1), edge(1), lambda a, b: F.slice("__w", a + 1, b - a + 1))
    return (marked.select("__id", *_DOC, F.explode(runs).alias("__w"))
            .withColumns({"__start": F.element_at("__w", 1)["__at"], "__lines": F.size("__w") + 1}))


def _sources(found: DataFrame) -> DataFrame:
    """``chunk, source``: every chunk that may stand elsewhere, with that place (document and first line)."""
    place = F.struct("__id", *_DOC, "__start")
    named = checkpointed(found.withColumn("__hash", F.xxhash64(F.transform("__w", lambda w: w["__window"]), "__lines")))
    distinct = checkpointed(named.groupBy("__hash").agg(
        F.min(place).alias("__first"), F.count("*").alias("__many"), F.min_by("__w", place).alias("__w"),
        F.min_by("__lines", place).alias("__lines")))
    equal = (_salted(named.select("__hash", place.alias("__chunk"), "__lines"), distinct.select("__hash", "__first", "__many"),
                     "__hash", "__many")
             .filter(F.col("__chunk") != F.col("__first")).select("__chunk", "__lines", F.col("__first").alias("__source")))

    # Longer chunks: all that hold the rarest window of a chunk where it would have to stand, with the same windows beside it.
    def beside(i: Column, side: int) -> Column:
        return F.when(i + side >= 0, F.get("__w", i + side)["__window"])

    each = F.transform("__w", lambda w, i: F.struct(w["__n"].alias("n"), w["__window"].alias("w"), i.alias("i"),
                                                    beside(i, -1).alias("left"), beside(i, 1).alias("right")))
    asks = (distinct.select("__first", F.col("__lines").alias("__short"), F.array_min(each).alias("__a"))
            .select("__first", "__short", F.col("__a.w").alias("__window"), F.col("__a.i").alias("__off"),
                    F.col("__a.left").alias("__aleft"), F.col("__a.right").alias("__aright")))
    held = (distinct.select(F.col("__first").alias("__in"), "__lines", F.explode(each).alias("__h"))
            .select("__in", "__lines", F.col("__h.w").alias("__window"), F.col("__h.i").alias("__pos"),
                    F.col("__h.left").alias("__left"), F.col("__h.right").alias("__right")))
    inside = (asks.join(held, "__window").filter(
        (F.col("__lines") > F.col("__short")) & (F.col("__pos") >= F.col("__off"))
        & (F.col("__pos") - F.col("__off") + F.col("__short") <= F.col("__lines"))
        & (F.col("__aleft").isNull() | (F.col("__aleft") == F.col("__left")))
        & (F.col("__aright").isNull() | (F.col("__aright") == F.col("__right"))))
        .select(F.col("__first").alias("__chunk"), F.col("__short").alias("__lines"),
                F.col("__in").withField("__start", F.col("__in.__start") + F.col("__pos") - F.col("__off")).alias("__source")))
    return equal.unionByName(inside)


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_lines: int = MIN_LINES) -> DataFrame:
    """``docs`` with ``text`` without its repeated chunks, and ``__removed``: their first lines (from 0) and numbers of lines."""
    claims = checkpointed(_sources(chunks(checkpointed(windows(docs, doc_id, text)))))
    bodies = _bodies(docs, doc_id, text)

    # The text of every place that a chunk names as its source.
    places = checkpointed(claims.groupBy("__source", "__lines").agg(F.count("*").alias("__many"))
                          .withColumn("__place", F.xxhash64("__source", "__lines")))
    wanted = broadcast_if_small(places.groupBy(*[F.col(f"__source.{c}").alias(c) for c in _DOC]).agg(
        F.collect_list(F.struct(F.col("__source.__start").alias("at"), "__lines", "__source")).alias("__wanted")))
    slices = (bodies.join(wanted, _DOC)
              .select("__lines", F.explode("__wanted").alias("__p"))
              .select(F.col("__p.__source").alias("__source"), F.col("__p.__lines").alias("__n"),
                      F.array_join(F.slice("__lines", F.col("__p.at") + 1, F.col("__p.__lines")), "\n").alias("__original"))
              .withColumn("__place", F.xxhash64("__source", "__n")).dropDuplicates(["__place"]))
    originals = places.select("__place", "__many").join(slices.select("__place", "__original"), "__place")
    asked = claims.withColumn("__place", F.xxhash64("__source", "__lines"))
    answered = (_salted(asked, originals, "__place", "__many")
                .groupBy(*[F.col(f"__chunk.{c}").alias(c) for c in _DOC])
                .agg(F.collect_set(F.struct(F.col("__chunk.__start").alias("at"), F.col("__lines").alias("n"), "__original")).alias("__claims")))

    joined = _named(docs, doc_id, text).join(answered, _DOC, "left")
    body = F.split(F.when(F.col("__claims").isNotNull(), F.col(text)), "\n", -1)
    # Chunks of a document do not overlap; several sources of one chunk leave one entry.
    equal = F.filter("__claims", lambda x: F.array_join(F.slice("__body", x["at"] + 1, x["n"]), "\n") == x["__original"])
    long_enough = F.filter(equal, lambda x: F.size(F.filter(F.slice("__body", x["at"] + 1, x["n"]), lambda line: ~_blank(line))) >= min_lines)
    gone = F.array_sort(F.array_distinct(F.transform(long_enough, lambda x: F.struct(x["at"].alias("line"), x["n"].alias("lines")))))
    end = F.size("__body")
    # What is kept: from the end of each removed chunk to the start of the next.
    after = F.concat(F.array(F.lit(0)), F.transform("__removed", lambda r: r["line"] + r["lines"]))
    until = F.concat(F.transform("__removed", lambda r: r["line"]), F.array(end))
    kept = F.flatten(F.zip_with(after, until, lambda a, b: F.slice("__body", a + 1, b - a)))
    none = F.array().cast("array<struct<line: int, lines: int>>")
    return (joined.withColumn("__body", body)
            .withColumn("__removed", F.coalesce(gone, none))
            .withColumn(text, F.when(F.size("__removed") > 0, F.array_join(kept, "\n")).otherwise(F.col(text)))
            .drop("__body", "__claims", *_DOC))
