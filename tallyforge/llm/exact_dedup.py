"""Exact dedup: group by a 128-bit content hash, keep the smallest id, compare bytes inside groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW, SPACE_RUN, cut, hot_join, row_hash, whole_rows


def normalised(text: Column) -> Column:
    """Null counts as empty; each run of space, \\t, \\n, \\v, \\f, \\r becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " ")


def content_groups(docs: DataFrame, hash128: Callable[[Column], Column] = lambda c: F.unhex(F.md5(c))) -> DataFrame:
    """One row per different normalised text: (_h, _sha, keep_id, group_size).

    The hash leads the grouping key, the bytes of the text close it, so texts that share a hash stay apart.  The
    grouping is partial on the map side: of a text that fills a third of the corpus each task sends one row.
    """
    t = docs.select("doc_id", normalised(F.col("text")).cast("binary").alias("_t"))
    g = t.select("doc_id", "_t", hash128(F.col("_t")).alias("_h")).groupBy("_h", "_t").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return g.select("_h", F.sha2("_t", 256).alias("_sha"), "keep_id", "group_size")


def exact_dedup(docs: DataFrame, hash128: Callable[[Column], Column] = lambda c: F.unhex(F.md5(c))) -> DataFrame:
    """Per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Nulls and empty texts form one group.  A null doc_id is never the least id unless all of a group are null, and is
    not kept (kept is false).  Rows that repeat both id and text are one document: each of them says kept.  Other columns
    of docs are not read, whatever their names.
    """
    ids = docs.select("doc_id", normalised(F.col("text")).cast("binary").alias("_t")).select("doc_id", hash128(F.col("_t")).alias("_h"), F.sha2("_t", 256).alias("_sha"))
    g = cut(content_groups(docs, hash128))
    rows = g.agg(F.sum("group_size")).first()[0] or 0
    j = hot_join(ids, g, ["_h", "_sha"], "group_size", rows, F.xxhash64("doc_id"))
    return j.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), F.col("_sha").alias("text_sha256"))


def id_key(doc_id: Column) -> Column:
    """An id as text that is never null, so that it can be a key of joins and windows."""
    return F.coalesce(F.concat(F.lit("i"), doc_id.cast("string")), F.lit("n"))


def dedup_stage(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of equal texts, all columns kept whatever their names.

    The row of the least id stays (one without an id only if its group has no other); of rows that repeat both id and
    text one stays, that of the least hash of all columns.  Null and empty texts form one group.  Copies of one text
    are dealt by id and text, so a group that holds a third of the rows meets in no task.
    """
    h, t = lambda c: F.unhex(F.md5(c)), normalised(F.col("text")).cast("binary")
    rows = whole_rows(docs, id_key(F.col("doc_id")).alias("_id"), h(t).alias("_h"), F.sha2(t, 256).alias("_sha"), row_hash(docs).alias("_r"))
    keep = content_groups(docs, h).select(id_key(F.col("keep_id")).alias("_id"), "_h", "_sha")
    same = Window.partitionBy("_id", "_h", "_sha").orderBy("_r")
    return rows.join(keep, ["_id", "_h", "_sha"], "left_semi").withColumn("_n", F.row_number().over(same)).where("_n = 1").select(f"{ROW}.*")
