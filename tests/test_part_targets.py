"""Lines summed by part key before they meet the parts are the lines of a part together."""

from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401
from tallyforge.plans.adapters import part_targets, table, target_items


def test_as_over_all_lines(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    p = table(spark, d, "part")
    # a part that is there twice counts its lines twice, as in the join of lines
    p.unionByName(p.where("p_partkey = 3")).write.parquet(f"{tmp_path}/part.parquet")
    table(spark, d, "lineitem").write.parquet(f"{tmp_path}/lineitem.parquet")
    keys = ["part", "code", "description", "unit", "bill", "size"]
    want = target_items(spark, str(tmp_path)).groupBy(*keys).agg(F.sum("quantity").cast("decimal(18,4)").alias("quantity"), F.min("original_rate").alias("rate"))
    got = part_targets(spark, str(tmp_path))
    assert got.schema == want.schema
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
