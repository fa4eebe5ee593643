"""Sheets are read in many small tasks, whatever few bytes their file has."""

import pytest

from tallyforge.sources import sheets as X


@pytest.fixture()
def part(spark, monkeypatch):
    monkeypatch.setattr(X, "PARTS_AT_ONCE", 100)
    p = spark.range(1000).selectExpr("id as p_partkey", "concat('part ', id) as p_name", "concat('Brand#', id % 5) as p_brand", "'STANDARD' as p_type", "cast(id % 50 as int) as p_size", "cast(id as double) / 7 as p_retailprice")
    return p.coalesce(1)


@pytest.mark.parametrize("cells", [lambda p: X.demo_cells(p, True), X.demo_tree, X.demo_ledger])
def test_cells_are_made_in_many_tasks(part, cells):
    sizes = [n for n in cells(part).rdd.mapPartitions(lambda rows: [len({(r.row) for r in rows})]).collect() if n]
    assert len(sizes) >= 10 and max(sizes) < 700  # three or four rows a part


def test_rows_are_dealt_apart(spark, part):
    """One sheet of 801 rows with figures is no one task where its rows are gathered."""
    cells = X.demo_cells(part, False)
    w = X._wide(cells, X.resolve_headers(cells))
    sizes = [n for n in w.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    assert sum(sizes) == 1000 and max(sizes) < 300


def test_long_block(spark):
    """Codes, serial numbers and sections over a block that many rows share, a row that fails to close, and an item after it."""
    head = ["S/N", "Item No.", "Description", "Unit", "Qty", "Rate", "Amount"]
    lines = [head, ["1", None, "SECTION one"], ["7", None, "text"], [None, None, "SECTION two"], *[[None, None, f"note {k}"] for k in range(20)], ["8", None, "more"], [None, None, "item", "m2", "3", "2"], [None, None, "no code", None, "4"], [None, "A", "kept"], [None, None, "again", None, "5", "1"]]
    cells = [("W", "Bill 1", r, k + 1, v, None) for r, line in enumerate(lines, 1) for k, v in enumerate(line) if v is not None]
    got = [r.asDict() for r in X.hierarchical_items(spark.createDataFrame(cells, X.CELLS)).orderBy("row").collect()]
    assert [(r["code"], r["serial"], r["section"], float(r["quantity"]), r["start_row"]) for r in got] == [("7", "8", "SECTION two", 3.0, 3), ("A", "A", "SECTION two", 5.0, 28)]
    assert got[0]["description"].startswith("text note 0") and got[0]["description"].endswith("more item") and got[1]["description"] == "kept again"
