"""Labelled samples for the classifiers: bounded, chosen by hash, never from held-out rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold


def sample_ids(labels: DataFrame, label: str, bound: int, salt: int = 11) -> DataFrame:
    """(_id, _y): at most ``bound`` labelled ids of the learning fold, those with the least hashes.

    Null ids and labels other than 0 and 1 are left out; an id with several labels counts as 1 if any says so.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), 3) != 1))
    known = known.groupBy(F.col("doc_id").alias("_id")).agg(F.max(label).cast("int").alias("_y"))
    return known.orderBy(F.xxhash64("_id", F.lit(salt)), "_id").limit(bound)


def labelled_docs(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """(doc_id, text, _y) of the sample; the broadcast side has at most ``bound`` rows of two numbers."""
    s = F.broadcast(sample_ids(labels, label, bound))
    return docs.select("doc_id", "text").join(s, F.col("doc_id") == F.col("_id")).select("doc_id", "text", "_y")


def held_out(doc_id: Column) -> Column:
    return fold(doc_id, 3) == 1
