"""Stored layouts, workbook files and archives."""

import zipfile

from tallyforge.operators import packages as P
from tallyforge.plans.adapters import pairs
from tallyforge.sources import sheets as X

SF = "/root/testdata/sf0.001"


def test_layouts(spark, tmp_path):
    assert "InvoiceName" not in P.layout("Snapshots", 1) and "InvoiceName" in P.layout("Snapshots")
    assert P.layout("ItemAuditTrail", 2) == {} and len(P.layout("MappingPresets")) == 13
    spark.createDataFrame([(1, "P")], "RevisionId bigint, ProjectCode string").write.parquet(str(tmp_path / "Snapshots" / "v=1"))
    spark.createDataFrame([(2, "Q", "inv")], "RevisionId bigint, ProjectCode string, InvoiceName string").write.parquet(str(tmp_path / "Snapshots" / "v=2"))
    got = {r.RevisionId: r.InvoiceName for r in P.read_store(spark, str(tmp_path), "Snapshots").collect()}
    assert got == {1: None, 2: "inv"}


def test_workbook_round_trip():
    b = P.workbook_bytes({"A & <b>": [["Item", "Qty"], ["x & y", 2.5], [None, 3]], "بند": [["ط"]]})
    assert list(X.parse_workbook("f", b)) == [("f", "A & <b>", 1, 1, "Item", None), ("f", "A & <b>", 1, 2, "Qty", None), ("f", "A & <b>", 2, 1, "x & y", None), ("f", "A & <b>", 2, 2, "2.5", None), ("f", "A & <b>", 3, 2, "3", None), ("f", "بند", 1, 1, "ط", None)]


def test_batch_and_archive(spark, tmp_path):
    p = pairs(spark, SF).selectExpr("*", "false as has_formula")
    P.write_batch(p, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == p.count()
    files = P.priced_workbooks(p, sheet_rows=3000).selectExpr("concat(part, '-', target_workbook) as name", "content")
    n = P.archive(files, str(tmp_path / "all.zip"))
    with zipfile.ZipFile(tmp_path / "all.zip") as z:
        assert n == len(set(z.namelist())) >= 3
        cells = [c for x in z.namelist() for c in X.parse_workbook(x, z.read(x))]
    assert sum(c[3] == 1 and c[2] > 1 for c in cells) == p.count()


def test_linked_sheets(spark):
    cells = spark.createDataFrame([("a/B.xlsx", "One", 1, 1, "x", None), ("a/B.xlsx", "Two", 1, 1, "x", "[1]S!A1")], X.CELLS)
    m = spark.createDataFrame([("b.XLSX", "ONE"), ("b.xlsx", "Three"), ("b.xlsx", " ")], "workbook string, sheet string")
    assert {(r.workbook, r.sheet) for r in X.external_sheets(cells, m).collect()} == {("b.xlsx", "One"), ("b.xlsx", "Two"), ("b.xlsx", "Three")}
    assert [r.sheet for r in X.external_formulas(cells).collect()] == ["Two"]


def test_parts_of_a_workbook_count_every_row(spark, monkeypatch):
    """sk8 with targets that fill several files: rows of the same number in two parts are two rows."""
    import duckdb

    from tallyforge.plans.registry import ORACLES, QUERIES

    whole = P.priced_workbooks
    monkeypatch.setattr(P, "priced_workbooks", lambda p: whole(p, sheet_rows=300))
    c = duckdb.connect()
    for t in ("part", "lineitem"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = c.execute(ORACLES["sk8_workbook_files"]).fetchall()
    assert sorted(map(tuple, QUERIES["sk8_workbook_files"](spark, SF).collect())) == sorted(want)


def test_cells_come_in_slices(spark, monkeypatch):
    monkeypatch.setattr(X, "AT_ONCE", 7)
    b = P.workbook_bytes({"S": [[k, f"t{k}"] for k in range(25)], "T": [["x"]]})
    files = spark.createDataFrame([("a/b.xlsx", bytearray(b))], "path string, content binary")
    assert X.cells_of(files).count() == 51
