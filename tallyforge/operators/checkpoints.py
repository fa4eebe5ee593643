"""Cutting lineage through the shared folder of the cluster."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_folder(spark: SparkSession) -> None:
    """The shared folder the cluster names is used; only a single local process gets a folder of its own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tallyforge-checkpoint-"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path that the driver and all executors can reach."""
    ensure_folder(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write df to the checkpoint folder and go on from there."""
    ensure_folder(df.sparkSession)
    return df.checkpoint(eager=True)
