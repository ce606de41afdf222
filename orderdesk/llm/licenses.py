"""Licence scans: TF-IDF cosine to licence templates, then inheritance by directory.

A file's own licence is the template that one of its lines, a run of its lines
(a header, wrapped as it may be) or its whole text (a licence file) comes
closest to, if the cosine reaches ``MIN_COSINE``. Runs are those of consecutive
lines that hold terms, up to ``RUN`` times the terms of the longest template;
comment marks and empty lines hold none. Vectors are sparse: term weights are frequency times inverse
document frequency counted over all documents; words in no template weigh 1.
Only texts that hold one of a template's heavy terms are compared: without any
of them the cosine cannot reach the threshold, so nothing is lost. Likewise
only runs that may be closer than their lines are compared. A text is scored where it
is read; only paths and licences move.

A licence file is one whose whole text is close to a template, one that holds
the opening of a full licence text, one that is hardly longer than the short
licence text whose disclaimer it holds, or one named like a licence file
(``NAMED``) with a licence of its own. An opening of a full text counts before
notices, and these before a mere "All rights reserved."

A file without a licence of its own takes that of the nearest ancestor
directory that holds a licence file: paths are expanded to their ancestor
directories, joined with the directories' licences, and the deepest wins.

All work is DataFrame functions.

Edge cases: a null or empty text has no licence of its own; a null path has no
ancestors; ties go to the first licence name; of several licence files in a
directory the closest of the first kind counts, then the first name; rows that share a path
share what it inherits; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, checkpointed

MIN_COSINE = 0.7
RUN = 1.5
TOKEN = "[a-z0-9]+(?:[.-][a-z0-9]+)*"

# Licence names and the wording of their usual notices.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
                   "compliance with the License. You may obtain a copy of the License at"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation, either version 3 of the License, "
                "or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files, to deal in the Software without restriction, including without limitation the rights to "
            "use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("proprietary", "All rights reserved."),
)

_GNU = "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
_CC = ("International Creative Commons Corporation is not a law firm and does not provide legal services or legal advice. "
       "Distribution of Creative Commons public licenses does not create a lawyer-client or other relationship.")
# Fixed values: (licence, block, terms) that only full licence texts hold: openings of long texts (terms 0), and
# disclaimers of short ones with the number of terms of the full text.
TEXTS: tuple[tuple[str, str, int], ...] = (
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, "
                   "REPRODUCTION, AND DISTRIBUTION", 0),
    ("CC-BY-4.0", "Attribution 4.0 " + _CC, 0),
    ("CC-BY-NC-4.0", "Attribution-NonCommercial 4.0 " + _CC, 0),
    ("CC-BY-SA-4.0", "Attribution-ShareAlike 4.0 " + _CC, 0),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal CREATIVE COMMONS CORPORATION IS NOT A LAW FIRM AND DOES NOT "
                "PROVIDE LEGAL SERVICES. DISTRIBUTION OF THIS DOCUMENT DOES NOT CREATE AN ATTORNEY-CLIENT RELATIONSHIP.", 0),
    ("GFDL-1.2", "GNU Free Documentation License Version 1.2, November 2002 " + _GNU, 0),
    ("GFDL-1.3", "GNU Free Documentation License Version 1.3, 3 November 2008 " + _GNU, 0),
    ("GPL-1.0", "GNU GENERAL PUBLIC LICENSE Version 1, February 1989 " + _GNU, 0),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 " + _GNU, 0),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 " + _GNU, 0),
    ("LGPL-2.0", "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991 " + _GNU, 0),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 " + _GNU, 0),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 " + _GNU, 0),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions 1.1. Contributor means each individual or legal entity that "
                "creates, contributes to the creation of, or owns Covered Software.", 0),
    ("BSD-3-Clause", 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED '
                     "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
                     "PARTICULAR PURPOSE ARE DISCLAIMED.", 220),
    ("ISC", 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
            "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.", 120),
    ("MIT", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
            "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.", 170),
)
SPARE = 1.5  # a short licence text may be this much longer
NAMED = r"(?i)(?:^|/)(?:[\w.+-]+[-_.])?(?:(?:un)?licen[cs]es?|copying)(?:[-_][a-z0-9+-]+(?:\.[0-9]+)*|\.lesser)?(?:\.(?:txt|md|rst|html?))?$"


def terms_of(text: str) -> Counter:
    return Counter(re.findall(TOKEN, text.lower()))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def inverse_frequencies(docs: DataFrame, text: str, vocabulary: list[str]) -> dict[str, float]:
    """ln((1 + N) / (1 + df)) + 1 over all documents, for the terms of the templates."""
    held = F.array_intersect(tokens(F.coalesce(F.col(text), F.lit(""))), F.array(*[F.lit(t) for t in vocabulary]))
    rows = (docs.select(F.explode(F.concat(F.array(F.lit("")), held)).alias("__term"))  # "" counts the documents
            .groupBy("__term").agg(F.count("*").alias("__n")).collect())  # a row per term of the templates
    counts = {r["__term"]: r["__n"] for r in rows}
    n = counts.get("", 0)
    return {t: math.log((1 + n) / (1 + counts.get(t, 0))) + 1 for t in vocabulary}


def template_weights(idf: dict[str, float], templates: tuple[tuple[str, str], ...]) -> list[tuple[str, int, str, float]]:
    """(licence, template number, term, weight) with each template scaled to length 1."""
    out = []
    for number, (name, text) in enumerate(templates):
        weights = {t: k * idf[t] for t, k in terms_of(text).items()}
        norm = math.sqrt(sum(w * w for w in weights.values()))
        out += [(name, number, t, w / norm) for t, w in sorted(weights.items())]
    return out


def heavy_terms(weights: list[tuple[str, int, str, float]], least: float) -> list[str]:
    """Terms one of which every text with a cosine of ``least`` or more to a template must hold.

    Without any of a template's heavy terms the cosine is at most the length
    of its remaining part, which is kept below ``least``.
    """
    out: set[str] = set()
    for number in sorted({w[1] for w in weights}):
        rest = 1.0
        for _, _, term, weight in sorted((w for w in weights if w[1] == number), key=lambda w: (-w[3], w[2])):
            if rest < least * least * (1 - 1e-9):
                break
            out.add(term)
            rest -= weight * weight
    return sorted(out)


def own_licences(files: DataFrame, text: str, templates: tuple[tuple[str, str], ...] = TEMPLATES,
                 min_cosine: float = MIN_COSINE, texts: tuple[tuple[str, str, int], ...] = TEXTS) -> DataFrame:
    """``files`` with ``__own``: (kind, minus the cosine, licence, whole) of its close lines, runs and whole text, best first; or null."""
    marks = [(2 if name == "proprietary" else 1, 0) for name, _ in templates] + [(0 if not n else 1, n or -1) for _, _, n in texts]
    templates = templates + tuple((name, block) for name, block, _ in texts)
    vocabulary = sorted({t for _, body in templates for t in terms_of(body)})
    idf = inverse_frequencies(files, text, vocabulary)
    weights = template_weights(idf, templates)
    heavy = _any_of(heavy_terms(weights, min_cosine))
    most = int(RUN * max(sum(terms_of(t).values()) for _, t in templates))

    def scores(unit: Column) -> Column:
        return _scores(_vector(unit, vocabulary), idf, weights, templates)

    asked = files.withColumn("__body", F.when(F.rlike(F.lower(F.col(text)), heavy), F.col(text))).withColumn(
        "__size", F.size(tokens(F.col("__body"))))
    held = _with_runs(asked, scores, templates, heavy, vocabulary, marks, most, min_cosine)
    vectors = F.concat(
        F.array(F.struct(scores(F.col("__body")).alias("s"), F.lit(True).alias("whole"))),
        F.transform("__runs", lambda unit: F.struct(scores(unit).alias("s"), F.lit(False).alias("whole"))))
    found = F.sort_array(F.filter(F.concat("__best", F.transform(
        vectors, lambda u: _closest(u["s"], u["whole"], F.col("__size"), templates, marks))), lambda m: m["minus"] <= -min_cosine))
    return (held.withColumn("__own", F.when(F.col("__body").isNotNull(), found)).drop("__body", "__size", "__best", "__runs")
            .withColumn("__own", F.when(F.size("__own") > 0, F.col("__own"))))


def _any_of(terms: list[str]) -> Column:
    """One of the terms as a whole, tried by its first letter."""
    rest: dict[str, list[str]] = {}
    for t in sorted(terms):
        rest.setdefault(t[0], []).append(re.escape(t[1:]))
    return F.lit("(?<![a-z0-9])(?:" + "|".join(f"{c}(?:{'|'.join(r)})" for c, r in rest.items()) + ")(?![a-z0-9])")


def _with_runs(files: DataFrame, scores: Callable[[Column], Column], templates: tuple[tuple[str, str], ...], heavy: Column,
               vocabulary: list[str], marks: list[tuple[int, int]], most: int, min_cosine: float) -> DataFrame:
    """``files`` with ``__best`` of each line of ``__body`` and ``__runs``: the runs of two or more lines, up to ``most`` terms, that may be close.

    A run is left out only if a shorter one is closer (its first or last line
    has no term of a template) or if it cannot be closest: dot products add up
    over lines and squares at least add up, which bounds its cosine to each
    template. It must reach ``min_cosine``, and for notices the closest line
    that counts as much.
    """
    lines = F.filter(F.transform(F.split("__body", "\n", -1), lambda line: F.struct(
        line.alias("line"), F.size(tokens(line)).alias("n"), F.rlike(F.lower(line), heavy).cast("int").alias("heavy"),
        F.rlike(F.lower(line), _any_of(vocabulary)).alias("known"), scores(line).alias("s"))), lambda x: x["n"] > 0)
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("heavy"), F.lit(0.0).alias("square"),
                    F.array(*[F.lit(0.0)] * len(templates)).alias("dots"))

    def plus(last: Column, x: Column) -> Column:
        return F.struct((last["n"] + x["n"]).alias("n"), (last["heavy"] + x["heavy"]).alias("heavy"),
                        (last["square"] + x["s"]["square"]).alias("square"),
                        F.zip_with(last["dots"], x["s"]["dots"], lambda d, e: d + e).alias("dots"))
    sums = F.aggregate("__lines", F.array(zero), lambda acc, x: F.concat(acc, F.array(plus(F.element_at(acc, -1), x))))
    best = F.transform("__lines", lambda x: _closest(x["s"], F.lit(False), F.col("__size"), templates, marks))

    def reached(kind: int) -> Column:
        return F.greatest(F.lit(min_cosine), F.coalesce(F.array_max(F.transform(
            F.filter("__best", lambda m: m["kind"] <= kind), lambda m: -m["minus"])), F.lit(0.0))).alias(f"k{kind}")
    asked = F.array(*[F.lit(min_cosine) if terms or kind == 0 else F.col("__reached")[f"k{kind}"] for kind, terms in marks])

    def between(a: Column, b: Column, name: str) -> Column:  # of lines a .. b
        return F.element_at("__sums", b + 1)[name] - F.element_at("__sums", a)[name]

    def may_be_close(a: Column, b: Column) -> Column:
        length = F.sqrt(F.greatest(between(a, b, "square"), F.lit(1e-300)))
        return F.exists(F.zip_with(F.zip_with(F.element_at("__sums", b + 1)["dots"], F.element_at("__sums", a)["dots"],
                                              lambda x, y: (x - y) / length), F.col("__asked"), lambda c, k: c >= k - 1e-6), lambda x: x)
    n = F.size("__lines")
    firsts = F.filter(F.sequence(F.lit(1), n), lambda a: (
        F.element_at("__lines", a)["known"] & (between(a, F.least(a + most - 1, n), "heavy") > 0)))  # each line has a term
    runs = F.flatten(F.transform(firsts, lambda a: F.transform(
        F.filter(F.sequence(a, F.least(a + most - 1, n)), lambda b: (
            (b > a) & (between(a, b, "n") <= most) & F.element_at("__lines", b)["known"] & (between(a, b, "heavy") > 0)
            & may_be_close(a, b))),
        lambda b: F.array_join(F.transform(F.slice("__lines", a, b - a + 1), lambda x: x["line"]), "\n"))))
    return (files.withColumn("__lines", lines).withColumn("__sums", sums).withColumn("__best", best)
            .withColumn("__reached", F.struct(reached(1), reached(2))).withColumn("__asked", asked)
            .withColumn("__runs", F.when(n > 1, runs).otherwise(F.array().cast("array<string>")))
            .drop("__lines", "__sums", "__reached", "__asked"))


def _vector(text: Column, vocabulary: list[str]) -> Column:
    """Sparse counts of a text: (term, count) of the templates' terms, and the summed squares of all other counts."""
    zero = F.struct(F.lit("").alias("term"), F.lit(0.0).alias("k"), F.lit(0.0).alias("other"),
                    F.array().cast("array<struct<term: string, k: double>>").alias("held"))

    def flushed(acc: Column) -> tuple[Column, Column]:
        inside = acc["term"].isin(vocabulary)
        one = F.array(F.struct(acc["term"].alias("term"), acc["k"].alias("k")))
        return (F.when(inside, acc["other"]).otherwise(acc["other"] + acc["k"] * acc["k"]),
                F.when(inside, F.concat(acc["held"], one)).otherwise(acc["held"]))

    def step(acc: Column, token: Column) -> Column:
        other, held = flushed(acc)
        return F.when(acc["term"] == token, F.struct(token.alias("term"), (acc["k"] + 1).alias("k"), acc["other"].alias("other"),
                                                     acc["held"].alias("held"))).otherwise(
            F.struct(token.alias("term"), F.lit(1.0).alias("k"), other.alias("other"), held.alias("held")))

    def done(acc: Column) -> Column:
        other, held = flushed(acc)
        return F.struct(other.alias("other"), held.alias("held"))
    return F.aggregate(F.array_sort(tokens(text)), zero, step, done)


def _scores(vector: Column, idf: dict[str, float], weights: list[tuple[str, int, str, float]],
            templates: tuple[tuple[str, str], ...]) -> Column:
    """The square of a vector's length and its dot products with the templates."""
    rows: dict[str, list[float]] = {t: [0.0] * len(templates) for t in idf}
    for _, number, term, weight in weights:
        rows[term][number] = weight * idf[term]
    table = F.create_map(*[x for t, row in sorted(rows.items()) for x in (
        F.lit(t), F.struct(F.lit(idf[t]).alias("idf"), F.array(*[F.lit(w) for w in row]).alias("to")))])
    none = F.struct(vector["other"].alias("square"), F.array(*[F.lit(0.0)] * len(templates)).alias("dots"))

    def add(acc: Column, e: Column) -> Column:
        row = F.element_at(table, e["term"])
        return F.struct((acc["square"] + e["k"] * row["idf"] * e["k"] * row["idf"]).alias("square"),
                        F.zip_with(acc["dots"], row["to"], lambda d, w: d + e["k"] * w).alias("dots"))
    return F.aggregate(vector["held"], none, add)


def _closest(scores: Column, whole: Column, size: Column, templates: tuple[tuple[str, str], ...],
             marks: list[tuple[int, int]]) -> Column:
    """(kind, minus the cosine, licence, whole) of the closest template; ``marks``: kind, terms of the text it shows.

    ``whole`` is the unit's, or that the template shows the file of ``size`` terms to be a licence text.
    """
    names = F.array(*[F.struct(F.lit(name).alias("licence"), F.lit(kind).alias("kind"), F.lit(terms).alias("terms"))
                      for (name, _), (kind, terms) in zip(templates, marks, strict=True)])
    length = F.sqrt(F.greatest(scores["square"], F.lit(1e-300)))
    found = F.transform(F.array(F.array_min(F.zip_with(scores["dots"], names, lambda d, name: F.struct(
        (-F.round(d / length, 9)).alias("minus"), name.alias("name"))))), lambda m: F.struct(
            m["name"]["kind"].alias("kind"), m["minus"].alias("minus"), m["name"]["licence"].alias("licence"),
            (whole | (m["name"]["terms"] == -1) | (size <= m["name"]["terms"] * SPARE)).alias("whole")))
    return found[0]


def ancestors(path: Column) -> Column:
    """The directories above a path, nearest first: (depth, directory)."""
    parts = F.slice(F.split(path, "/", -1), F.lit(1), F.size(F.split(path, "/", -1)) - 1)
    depths = F.filter(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda d: d >= 0)
    return F.transform(depths, lambda d: F.struct(d.alias("depth"), F.array_join(F.slice(parts, F.lit(1), d), "/").alias("dir")))


def licensed(files: DataFrame, path: str = "path", text: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES,
             min_cosine: float = MIN_COSINE) -> DataFrame:
    """``files`` with ``__licence``, ``__cosine`` and ``__from`` (the directory it was inherited from, or null)."""
    # Texts are scored once: what they say is kept by a 128-bit name of path and text, and joined back.
    body = F.col(text).cast("string")
    file = (F.xxhash64(F.col(path), body).alias("__f1"), F.xxhash64(F.lit(1), body, F.lit("|"), F.col(path)).alias("__f2"))
    judged = own_licences(files.select(F.col(path).alias("__path"), body.alias("__text"), *file), "__text", templates, min_cosine)
    narrow = checkpointed(judged.select("__f1", "__f2", "__path", "__own"))
    above = F.explode(ancestors(F.col("__path"))).alias("__above")
    full = F.filter("__own", lambda o: o["whole"] | F.rlike(F.col("__path"), F.lit(NAMED)))
    directories = (narrow.filter(F.size(full) > 0)
                   .select(ancestors(F.col("__path"))[0]["dir"].alias("__dir"), "__path", full[0].alias("__best"))
                   .groupBy("__dir").agg(F.min(F.struct(F.col("__best.kind"), F.col("__best.minus"), F.col("__best.licence"), "__path")).alias("__best"))
                   .select("__dir", F.col("__best.licence").alias("__inherited"), (-F.col("__best.minus")).alias("__icosine")))
    directories = broadcast_if_small(checkpointed(directories))
    taken = (narrow.filter("__own IS NULL AND __path IS NOT NULL").select("__path").distinct().select("__path", above)
             .select("__path", F.col("__above.depth").alias("__depth"), F.col("__above.dir").alias("__dir"))
             .join(directories, "__dir")
             .groupBy(F.col("__path").alias("__heir"))
             .agg(F.max(F.struct("__depth", "__dir", "__inherited", "__icosine")).alias("__near")))
    taken = broadcast_if_small(checkpointed(taken))
    said = broadcast_if_small(narrow.filter("__own IS NOT NULL").select("__f1", "__f2", F.get("__own", F.lit(0)).alias("__own"))
                              .dropDuplicates(["__f1", "__f2"]))
    own = F.col("__own").isNotNull()
    judged = files.join(said, (file[0] == said["__f1"]) & (file[1] == said["__f2"]), "left").drop("__f1", "__f2")
    return (judged.join(taken, F.when(F.col("__own").isNull(), F.col(path)) == taken["__heir"], "left")
            .withColumn("__licence", F.when(own, F.col("__own.licence")).otherwise(F.col("__near.__inherited")))
            .withColumn("__cosine", F.when(own, -F.col("__own.minus")).otherwise(F.col("__near.__icosine")))
            .withColumn("__from", F.when(~own, F.col("__near.__dir")))
            .drop("__own", "__heir", "__near"))


def document_path(doc_id: Column, source: Column) -> Column:
    """A file tree over documents: source / thousands / fifties / id."""
    group = lambda n: F.floor(doc_id / n).cast("string")
    return F.concat_ws("/", F.coalesce(source, F.lit("none")), group(1000), group(50), F.concat(doc_id.cast("string"), F.lit(".txt")))
