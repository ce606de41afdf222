"""Secret scans with a trigram inverted index.

Each rule's regular expression is turned into a Boolean trigram query: the
literal runs that every match must hold, as alternatives of trigram sets. The
index lists, for every trigram that a query asks for, the documents whose
lower-cased text holds it; a rule's candidates are the documents in the
intersection of the postings of one alternative. Only candidates are searched
with the rule itself. A rule without mandatory trigrams (the hex rule) is
searched in every text. Postings only select texts, so null or repeated ids
cannot change a result.

All work is DataFrame functions; matches are placed by cutting the text at
them (``split``) and adding up lengths. Spans are code points, end exclusive.

Edge cases: a null text counts as empty and has no spans; repeated rows give
equal results; an empty table gives an empty table.
"""

from __future__ import annotations

import re._constants as C
import re._parser as P
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, checkpointed

MAX_ALTERNATIVES = 64


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0  # the group that ``least`` counts
    least: int = 0


ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (
    Rule("assign", ASSIGN, 2, 6),
    Rule("access", "AKIA[A-Z0-9]{16,}"),  # the runs of AKIA[A-Z0-9]+ with 20 characters or more
    Rule("hex", "[0-9a-f]{24,}"),  # the runs of [0-9a-f]+ with 24 characters or more
)
ADDED = (
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", "AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", "[rs]k_live_[A-Za-z0-9]{24,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Alternatives of trigrams of the lower-cased text, one of which every match holds whole; None: scan fully."""
    states = _walk(P.parse(pattern), {((), "")})
    if states is None:
        return None
    out = set()
    for runs, tail in states:
        grams = frozenset(run[i:i + 3] for run in (*runs, tail) for i in range(len(run) - 2))
        if not grams:
            return None
        out.add(grams)
    return sorted((q for q in out if not any(other < q for other in out)), key=sorted)


def _closed(states: set) -> set:
    return {(runs + ((tail,) if len(tail) > 2 else ()), "") for runs, tail in states}


def _walk(nodes, states: set | None) -> set | None:
    """States (finished literal runs, open run) after a sequence of parsed nodes."""
    for op, arg in nodes:
        if states is None or len(states) > MAX_ALTERNATIVES:
            return None
        if op is C.LITERAL:
            states = {(runs, tail + chr(arg).lower()) for runs, tail in states}
        elif op is C.IN and len(arg) <= 6 and all(o is C.LITERAL for o, _ in arg):
            states = {(runs, tail + chr(c).lower()) for runs, tail in states for _, c in arg}
        elif op is C.SUBPATTERN:
            states = _walk(arg[3], states)
        elif op is C.BRANCH:
            parts = [_walk(part, states) for part in arg[1]]
            states = None if any(p is None for p in parts) else set().union(*parts)
        elif op is C.MAX_REPEAT and arg[:2] == (0, 1) and arg[2][0][0] is C.LITERAL:
            taken = _walk(arg[2], states)
            states = None if taken is None else states | taken
        elif op is C.MAX_REPEAT and arg[0] > 0:
            for _ in range(min(arg[0], 3)):
                states = _walk(arg[2], states)
            states = states if states is None or arg[0] == arg[1] <= 3 else _closed(states)
        else:
            states = _closed(states)
    return states


def postings(docs: DataFrame, doc_id: str, text: str, grams: list[str]) -> DataFrame:
    """The index for the asked trigrams: one row ``__gram, __id`` per trigram and document that holds it."""
    low = docs.select(F.col(doc_id).alias("__id"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("__low"))
    held = F.array_compact(F.array(*[F.when(F.contains(F.col("__low"), F.lit(g)), F.lit(g)) for g in grams]))
    return low.select("__id", F.explode(held).alias("__gram"))


def candidates(docs: DataFrame, doc_id: str, text: str, rules: tuple[Rule, ...]) -> DataFrame | None:
    """``__key`` (document id) and ``__kinds``: the rules whose trigram query it satisfies."""
    asked = [(r.kind, n, g, len(q)) for r in rules for n, q in enumerate(trigram_query(r.pattern) or ()) for g in sorted(q)]
    if not asked:
        return None
    spark = docs.sparkSession
    query = spark.createDataFrame(asked, "__kind string, __way int, __gram string, __need int")  # as many rows as the rules have trigrams
    rows = postings(docs, doc_id, text, sorted({a[2] for a in asked}))
    return (rows.join(F.broadcast(query), "__gram")
            .groupBy("__id", "__kind", "__way", "__need").agg(F.count_distinct("__gram").alias("__n"))
            .filter("__n = __need").groupBy(F.col("__id").alias("__key")).agg(F.collect_set("__kind").alias("__kinds")))


_SPANS = "array<struct<start: int, rank: int, end: int, kind: string>>"


def spans(body: Column, rule: Rule, rank: int) -> Column:
    """Matches of a rule, leftmost first, as an array of (start, rank, end, kind)."""
    found = F.regexp_extract_all(body, F.lit(rule.pattern), F.lit(0))
    part = F.regexp_extract_all(body, F.lit(rule.pattern), F.lit(rule.group)) if rule.least else found
    rows = F.arrays_zip(F.slice(F.split(body, rule.pattern, -1), F.lit(1), F.size(found)).alias("gap"),
                        found.alias("found"), part.alias("part"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("out"))

    def step(acc: Column, row: Column) -> Column:
        begin = acc["at"] + F.length(row["gap"])
        end = begin + F.length(row["found"])
        one = F.array(F.struct(begin.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind")))
        keep = F.length(row["part"]) >= rule.least
        return F.struct(end.alias("at"), F.when(keep, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    return F.when(body.rlike(rule.pattern), F.aggregate(rows, start, step)["out"]).otherwise(F.array().cast(_SPANS))


def joined(found: Column) -> Column:
    """``kind:start:end`` by start, then rank, comma-joined."""
    return F.array_join(F.transform(F.array_sort(found), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scanned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", base: tuple[Rule, ...] = BASE,
            added: tuple[Rule, ...] = ADDED) -> DataFrame:
    """``docs`` with ``__base`` and ``__spans``: arrays of (start, rank, end, kind)."""
    rules = base + added
    body = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast(_SPANS)
    scan = {r.kind for r in rules if trigram_query(r.pattern) is None}
    which = candidates(docs, doc_id, text, rules)
    if which is not None:
        which = broadcast_if_small(checkpointed(which))
        docs = docs.join(which, docs[doc_id].eqNullSafe(which["__key"]), "left")
    columns = [spans(body, r, n) if r.kind in scan
               else F.when(F.array_contains("__kinds", r.kind), spans(body, r, n)).otherwise(none)
               for n, r in enumerate(rules)]
    docs = docs.withColumn("__base", F.concat(*columns[:len(base)])).withColumn("__added", F.concat(none, *columns[len(base):]))
    return docs.withColumn("__spans", F.concat("__base", "__added")).drop("__added", "__key", "__kinds")
