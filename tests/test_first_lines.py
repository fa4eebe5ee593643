"""The first lines of the reports: right, and nothing behind them is sorted or written."""

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import analytics, store


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.range(20_000).selectExpr("concat('i', id) as id", "case when id % 7 > 0 then concat('bill ', id % 3) end as bill", "case when id % 11 > 0 then cast(id * 7919 % 30011 as bigint) end as row", "cast(id % 5 as decimal(18,4)) as quantity", "cast(id % 4 = 0 as int) as g")


@pytest.mark.parametrize("n", [1, 500, 4999, 19_999, 20_000, 50_000])
def test_first_lines(pairs, monkeypatch, n):
    seen = []
    monkeypatch.setattr(analytics, "running", lambda df, *a, f=analytics.running: seen.append(df.count()) or f(df, *a))
    got = [r.id for r in store.first_lines(pairs, {"_g": F.col("g")}, n).orderBy("rank").collect()]
    key = lambda r: tuple((x is not None, x if x is not None else 0) for x in (r.g, r.bill, r.row, r.id, r.quantity))
    assert got == [r.id for r in sorted(pairs.collect(), key=key)][:n]
    assert seen[0] <= n + 1000  # a bill and stretch of rows has fewer
