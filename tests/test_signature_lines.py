"""JN1 of lines: keys that belong to a line's item meet the sources once an item."""

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import matching as M
from tallyforge.plans import registry


def _run(spark):
    lines = spark.createDataFrame([(1, "p", 5), (2, "p", 6), (3, "p", 7), (4, "q", 5), (5, "n", 5), (6, "x", 5), (7, "p", None), (8, None, 5), (9, "r", 6)], "id int, item string, qty int")
    items = spark.createDataFrame([("p", "A", ["a", "b"]), ("q", "A", ["a"]), ("n", None, ["a"]), ("r", "A", ["a", "b"])], "item string, code string, words array<string>")
    sources = spark.createDataFrame([("A", ["a", "b"], 5, 9), ("A", ["a", "b"], 5, 4), ("A", ["a", "b"], 6, 3), ("A", ["a", "b"], None, 1), (None, ["a"], 5, 2), ("A", ["b", "a"], 7, 8)], "code string, words array<string>, qty int, s int")
    return {r.id: r.s for r in M.signature_join_of_lines(lines, items, sources, "item", ["code", "words"], "qty", "s").collect()}


@pytest.mark.parametrize("own", [256, 1])
def test_first_source_of_each_line(spark, monkeypatch, own):
    monkeypatch.setattr(M, "OWN", own)
    assert _run(spark) == {1: 4, 2: 3, 3: None, 4: None, 5: None, 6: None, 7: None, 8: None, 9: 3}


def test_lines_carry_no_words(spark):
    """No array of words is dealt out beside a line's id."""
    plan = registry.QUERIES["jn1_content_signature"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    top = plan.splitlines()[1]
    assert "tokens" not in top and "Join LeftOuter" in plan and "part" in top
