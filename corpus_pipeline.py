"""Corpus pipeline: quality, exact copies, near copies, mixture, token ids and their round trip.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again as the docs of the
next.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm.common import ensure_checkpoint_dir, table
from tallyforge.llm.exact_dedup import dedup_stage
from tallyforge.llm.mixing import mix_stage
from tallyforge.llm.near_dedup import near_dedup_stage
from tallyforge.llm.quality import quality_stage
from tallyforge.llm.sentencepiece_codec import codec_stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return quality_stage(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least id of each group of equal texts."""
    return dedup_stage(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more)."""
    return near_dedup_stage(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sample by raked probability, at most 1: cells that cannot fill their part leave the targets unmet."""
    return mix_stage(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids and whether decoding these gives the text back."""
    return codec_stage(docs)


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("mixture", mixture), ("tokens", tokens)]

#: The first stage is a learned model and the last a tokenizer: SQL expresses neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what lies between them is kept in the folder for checkpoints until it is not needed."""
    ensure_checkpoint_dir(spark)
    shared = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    out = f"{shared}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{out}/{k}-{name}")
            docs = spark.read.parquet(f"{out}/{k}-{name}")
            if k:  # the result of the last stage but one is read when the caller reads ours; the earlier ones go
                _delete(spark, f"{out}/{k - 1}-{STAGES[k - 1][0]}")
    return docs


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
