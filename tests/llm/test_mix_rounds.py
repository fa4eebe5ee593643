"""Raking goes over a small table, so its tasks must not follow the number of shuffle partitions."""

import pytest
from pyspark.sql import functions as F

from tallyforge.llm import mixing


@pytest.fixture
def docs(spark):
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    words = F.array_join(F.array_repeat(F.lit("w"), (F.col("id") % 7 + 1).cast("int")), " ")
    text = F.concat(words, F.element_at(F.array(*map(F.lit, ("", " a@b", " license"))), (F.col("id") % 3 + 1).cast("int")))
    yield spark.range(400).select(F.col("id").alias("doc_id"), text.alias("text"), (F.col("id") % 5).cast("string").alias("source"), (F.col("id") % 11 % 4).cast("string").alias("lang"))
    for k, v in held.items():
        spark.conf.set(k, v)


def test_rounds_do_not_run_a_task_a_partition(spark, docs):
    sc = spark.sparkContext
    sc.setJobGroup("raking", "")
    cells = mixing.raked_cells(docs)
    sc.setLocalProperty("spark.jobGroup.id", None)
    jobs = [sc.statusTracker().getJobInfo(j) for j in sc.statusTracker().getJobIdsForGroup("raking")]
    stages = [sc.statusTracker().getStageInfo(s) for j in jobs for s in j.stageIds]
    assert cells.count() == 60
    assert sum(s.numCompletedTasks for s in stages if s) < 1000  # some twenty rounds of three exchanges each


def test_few_cells_are_raked_as_many_are(docs, monkeypatch):
    rows = lambda: {tuple(r[d] for d in mixing.DIMS): r["w"] for r in mixing.raked_cells(docs).collect()}
    few = rows()
    monkeypatch.setattr(mixing, "FEW", 0)
    assert few == pytest.approx(rows(), rel=1e-9)
