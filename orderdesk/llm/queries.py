"""The registered queries of the corpus operators and their DuckDB statements."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontam, embeddings, extraction, langid, licenses, lines, minhash, mixing, negatives, pii, secrets, sharding
from .common import read_table, word_count


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words each document contributes to the mix, with its source's size and target."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    size = word_count(F.col("text"))
    return mixing.mixed(docs).select(
        "doc_id", size.alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"),
        (F.col("__copies") * size).alias("taken"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, text, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         (1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::DOUBLE AS weight
  FROM d GROUP BY source),
r AS (
  SELECT *, row_number() OVER (ORDER BY source_size / weight, weight, source NULLS LAST) AS rk,
         coalesce(sum(source_size) OVER w, 0) AS capped_size, coalesce(sum(weight) OVER w, 0) AS capped_weight,
         sum(source_size) OVER () AS total, sum(weight) OVER () AS weights
  FROM s WINDOW w AS (ORDER BY source_size / weight, weight, source NULLS LAST
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (
  SELECT first(level ORDER BY rk) AS level FROM (
    SELECT rk, weight, source_size, (total::DOUBLE - 3.0::DOUBLE * capped_size::DOUBLE) / (weights - capped_weight) AS level FROM r)
  WHERE level * weight <= 3.0::DOUBLE * source_size),
t AS (
  SELECT source, source_size, least(coalesce(level, 0) * weight, 3.0::DOUBLE * source_size) AS target FROM s, l),
x AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, 3.0::DOUBLE) ELSE 1.0::DOUBLE END AS rate,
         ('0x' || substr(md5('20240|' || coalesce(d.doc_id::VARCHAR, '') || '|' || md5(coalesce(d.text, ''))), 1, 13))::BIGINT
           / 4503599627370496.0::DOUBLE AS draw
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       ((floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM x
"""


def op2_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard, slot and the shard after one more is added, by a weighted hash tree over doc_id."""
    return sharding.shard_table(read_table(spark, sf_dir, "documents")).select(
        "doc_id", F.col("__size").alias("size"), F.col("__crc32").alias("text_crc32"), F.lit("key").alias("law"),
        F.col("__shard").alias("shard"), F.col("__slot").cast("long").alias("slot"),
        F.col("__grown_shard").alias("grown_shard"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of the documents on 2-word shingles at 80 percent."""
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"), size=2)


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and classes of all vectors at cosine 0.95."""
    return embeddings.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text without its repeated chunks of lines, and how much went."""
    rows = lines.deduplicated(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(
        "doc_id", "text", F.size("__removed").cast("long").alias("n_chunks_removed"),
        F.aggregate("__removed", F.lit(0).cast("long"), lambda n, r: n + r["lines"]).alias("n_lines_removed"))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every whole text, learned from the documents outside the held-out fold."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.identified(docs).select(
        "doc_id", F.coalesce(langid.fold(F.col("doc_id")) == langid.HELD_OUT, F.lit(False)).alias("held_out"),
        F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence of every document: its own by TF-IDF cosine, or its nearest ancestor directory's."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    files = docs.withColumn("path", licenses.document_path(F.col("doc_id"), F.col("source")))
    return licenses.licensed(files).select(
        "doc_id", "path", F.col("__licence").alias("licence"), F.col("__cosine").alias("cosine"),
        F.col("__from").alias("inherited_from"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text with validated personal data replaced by pseudonyms, and what was replaced where.

    The key is the session's setting ``spark.orderdesk.pii.key``; without it a random one, which nobody keeps, so
    that the pseudonyms of a run cannot be undone."""
    named = spark.conf.get("spark.orderdesk.pii.key", None)
    key = named.encode() if named else os.urandom(32)
    rows = pii.pseudonymized(read_table(spark, sf_dir, "documents").select("doc_id", "text"), key)
    spans = F.transform("__spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    return rows.select("doc_id", "text", F.size("__spans").cast("long").alias("n_found"),
                       F.array_join(spans, ",").alias("spans"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text: counts, a digest of the base spans and all spans."""
    rows = secrets.scanned(read_table(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(kind: str):
        return F.size(F.filter("__base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return rows.select(
        "doc_id", *[count(r.kind) for r in secrets.BASE],
        F.sha2(secrets.joined(F.col("__base")).cast("binary"), 256).alias("base_sha256"),
        secrets.joined(F.col("__spans")).alias("spans"))


def _op9_sql() -> str:
    """Each rule searched in every text; places from the lengths of the cut text."""
    def spans(n: int, r: secrets.Rule) -> str:
        pattern = r.pattern.replace("'", "''")
        keep = f"AND length(regexp_extract_all(t, '{pattern}', {r.group})[i]) >= {r.least}" if r.least else ""
        return f"""
  SELECT doc_id, i, '{r.kind}' AS kind, {n} AS rank,
         (list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0))::BIGINT AS b,
         length(found[i]) AS size
  FROM (SELECT doc_id, t, string_split_regex(t, '{pattern}') AS gaps, regexp_extract_all(t, '{pattern}') AS found,
               unnest(range(1, len(regexp_extract_all(t, '{pattern}')) + 1)) AS i FROM d WHERE regexp_matches(t, '{pattern}'))
  WHERE true {keep}"""
    rules = secrets.BASE + secrets.ADDED
    each = "\n  UNION ALL".join(spans(n, r) for n, r in enumerate(rules))
    n_base = len(secrets.BASE)
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in secrets.BASE)
    text = "kind || ':' || b || ':' || (b + size)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS ({each}),
g AS (SELECT doc_id, {counts},
             string_agg({text}, ',' ORDER BY b, rank) FILTER (rank < {n_base}) AS base,
             string_agg({text}, ',' ORDER BY b, rank) AS spans
      FROM s GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secrets.BASE)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item, the place and the edit distance."""
    return decontam.contaminations(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor (ids divisible by 100) and positive among all vectors."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(read_table(spark, sf_dir, "embeddings"), F.col("__id") % 100 == 0, label=label)


OP11_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * x::DOUBLE) FOR x IN embedding] AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, r.label = a.label AS alike,
         list_inner_product(a.e, r.e)::BIGINT AS score
  FROM v a JOIN v r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id,
       row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)::INT AS rank,
       s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.alike
  AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY rank <= 10
"""


def op12_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every whole page."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extraction.extracted(pages).select("page_id", "url", F.col("__text").alias("text"),
                                              F.length("__text").cast("long").alias("n_chars"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of the tokens of two tokenizers over every whole text, and how common the links are."""
    rows = alignment.aligned(read_table(spark, sf_dir, "documents").select("doc_id", "text"),
                             written=lambda groups: hashlib.sha256(groups).hexdigest())
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
    return alignment.scored(rows).select(F.col("__id").alias("doc_id"), *[F.col(f"__{n}").alias(n) for n in names],
                                         F.col("__written").alias("groups_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_mix": op1_mix, "op2_shard": op2_shard, "op3_minhash": op3_minhash, "op4_embeddings": op4_embeddings, "op5_lines": op5_lines, "op6_langid": op6_langid,
            "op7_licenses": op7_licenses, "op8_pii": op8_pii, "op9_secrets": op9_secrets, "op10_decontaminate": op10_decontaminate,
            "op11_hard_negatives": op11_hard_negatives, "op12_html": op12_html, "op13_alignment": op13_alignment}


def oracle_sql() -> dict[str, str]:
    return {"op1_mix": OP1_SQL, "op9_secrets": _op9_sql(), "op11_hard_negatives": OP11_SQL}
