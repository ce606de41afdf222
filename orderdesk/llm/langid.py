"""Language identification by a bidirectional gated recurrent network over bytes.

The network (``gru.py``) is trained on a bounded sample of labelled documents:
about ``SAMPLE_DOCS`` documents per language drawn by a hash of their id, from
each an excerpt of at most ``SAMPLE_CHARS`` characters at a hash-chosen place.
Prediction reads every byte of every text: it labels each byte position and
averages the positions' probabilities per document; the language with the
highest average wins and that average is the score.

Edge cases: a null text or one without any letter is ``und`` with score 0; a
document without id is neither learned from nor held out; without labelled
documents every text is ``und``; ties go to the first language by code point;
an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gru
from .common import broadcast_if_small, checkpointed, columns_of

SAMPLE_DOCS = 400  # labelled documents per language that training may use
SAMPLE_CHARS = 768
FOLDS = 4
HELD_OUT = 2
MIN_SCORE = 0.3
UNKNOWN = "und"


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def sample(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
           per_lang: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> list[tuple[str, str]]:
    """(language, excerpt) pairs, at most ``per_lang`` per language; held-out documents are left out."""
    rows = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text"), F.col(lang).alias("__lang"))
    rows = rows.filter((fold(F.col("__id")) != HELD_OUT) & F.col("__lang").isNotNull())
    counts = broadcast_if_small(checkpointed(rows.groupBy("__lang").agg(F.count("*").alias("__n"))))
    draw = F.shiftrightunsigned(F.xxhash64("__id", F.lit("sample")), 11) / F.lit(float(1 << 53))
    place = F.pmod(F.xxhash64("__id", F.lit("place")), F.greatest(F.length("__text") - chars, F.lit(0)) + 1)
    picked = (rows.join(counts, "__lang").withColumn("__draw", draw)
              .filter((F.col("__draw") * F.col("__n") < 2.0 * per_lang) & F.col("__text").rlike(r"\p{L}"))
              .select("__lang", "__draw", "__id", F.substring("__text", (place + 1).cast("int"), F.lit(chars)).alias("__part"))
              .collect())  # about 2 * per_lang short excerpts per language
    taken: dict[str, int] = {}
    out = []
    for row in sorted(picked, key=lambda r: (r["__lang"], r["__draw"], r["__id"], r["__part"])):
        taken[row["__lang"]] = taken.get(row["__lang"], 0) + 1
        if taken[row["__lang"]] <= per_lang:
            out.append((row["__lang"], row["__part"]))
    return out


def fit(pairs: list[tuple[str, str]]) -> tuple[list[str], gru.Params] | None:
    langs = sorted({lang for lang, _ in pairs})
    if not langs:
        return None
    data, lengths, owner = gru.windows_of([part.encode() for _, part in pairs])
    target = np.array([langs.index(lang) for lang, _ in pairs])[owner]
    return langs, gru.train(data, lengths, target, len(langs))


def predictor(model: tuple[list[str], gru.Params] | None):
    """A column function: text -> struct(lang, score)."""
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64())])

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            bodies = [x.as_py() or b"" for x in batch.cast(pa.binary())]
            known = np.flatnonzero([bool(b) for b in bodies])
            names, scores = [UNKNOWN] * len(bodies), np.zeros(len(bodies))
            if model is not None and len(known):
                langs, params = model
                probs = gru.pooled(params, [bodies[i] for i in known])
                best = probs.argmax(axis=1)
                scores[known] = np.clip(probs[np.arange(len(known)), best], 0.0, 1.0)
                for i, b in zip(known, best, strict=True):
                    names[i] = langs[b]
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores)], fields=list(kind))

    run.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "lang string, score double")


def identified(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
               train_on: DataFrame | None = None) -> DataFrame:
    """``docs`` with ``__lang`` and ``__score``; a text without letter is ``und``."""
    model = fit(sample(train_on if train_on is not None else docs, doc_id, text, lang))
    body = F.when(F.col(text).rlike(r"\p{L}"), F.col(text))
    return (docs.withColumn("__found", predictor(model)(body))
            .withColumn("__lang", F.col("__found.lang")).withColumn("__score", F.col("__found.score")).drop("__found"))


def accepted(docs: DataFrame, min_score: float = MIN_SCORE, **options) -> DataFrame:
    """``docs`` whose language is known with at least ``min_score``."""
    return (identified(docs, **options).filter((F.col("__lang") != UNKNOWN) & (F.col("__score") >= min_score))
            .select(*columns_of(docs)))
