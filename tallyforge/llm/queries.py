"""The registered queries of the corpus operators, one an operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import filter_audit, hard_negatives, license_scan, mixing, secrets
from .common import table
from .embed_dedup import embedding_dedup
from .exact_dedup import exact_dedup
from .langid import language_id
from .mixing import mix_sources
from .quality import quality_classifier
from .secrets import secret_scan
from .sentencepiece_codec import codec_report
from .simhash_dedup import simhash_dedup
from .substring_dedup import substring_dedup
from .toxicity import toxicity


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec_report(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).drop("kept_text")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mix_sources, op2_embedding_dedup, op3_quality, op4_sentencepiece, op5_substring_dedup, op6_exact_dedup, op7_toxicity,
        op8_secret_scan, op9_language_id, op10_simhash_dedup, op11_filter_audit, op12_hard_negatives, op13_license_scan,
    )
}

#: All pairs by cosine and the closure of their links.
_OP2 = """
WITH RECURSIVE ok AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
comp AS (SELECT a, min(b) AS c FROM reach GROUP BY a), num AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(least(c.c, e.vec_id), e.vec_id) AS component_id,
  e.vec_id = coalesce(least(c.c, e.vec_id), e.vec_id) AS kept
FROM embeddings e LEFT JOIN comp c ON e.vec_id = c.a LEFT JOIN num n ON e.vec_id = n.a"""

_OP6 = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, (count(*) OVER w)::BIGINT AS group_size, coalesce(doc_id = min(doc_id) OVER w, false) AS kept, sha256(t) AS text_sha256
FROM t WINDOW w AS (PARTITION BY t)"""

_OP5 = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS MATERIALIZED (SELECT doc_id, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS x FROM docs),
win AS MATERIALIZED (SELECT doc_id, j, string_agg(x, ' ') OVER f AS s, count(*) OVER f AS n FROM words WINDOW f AS (PARTITION BY doc_id ORDER BY j ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
seq AS (SELECT doc_id, j, row_number() OVER (PARTITION BY s ORDER BY doc_id, j) > 1 AS again FROM win WHERE n = 20),
cov AS (SELECT w.doc_id, w.j, w.x, coalesce(bool_or(s.again) OVER (PARTITION BY w.doc_id ORDER BY w.j ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), false) AS gone FROM words w LEFT JOIN seq s USING (doc_id, j)),
kept AS (SELECT doc_id, coalesce(string_agg(x, ' ' ORDER BY j) FILTER (NOT gone), '') AS s, count(*) FILTER (gone) AS n FROM cov GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(kept.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.s, '')) AS kept_sha256
FROM docs d LEFT JOIN kept USING (doc_id)"""

ORACLES: dict[str, str] = {
    "op1_mix_sources": mixing.oracle(),
    "op2_embedding_dedup": _OP2,
    "op5_substring_dedup": _OP5,
    "op6_exact_dedup": _OP6,
    "op8_secret_scan": secrets.oracle(),
    "op11_filter_audit": filter_audit.oracle(),
    "op12_hard_negatives": hard_negatives.oracle(),
    "op13_license_scan": license_scan.oracle(),
}
