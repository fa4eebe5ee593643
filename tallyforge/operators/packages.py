"""Table layouts, the analytics bundle, the dashboard and the packages of priced workbooks."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from functools import reduce
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import analytics as A
from .checkpoints import cut
from .store import rate_cell_action

# The stored tables and the layout version that brings each group of columns (DB1-DB4).
SCHEMAS: dict[int, dict[str, str]] = {
    1: {
        "Snapshots": "RevisionId bigint, ProjectCode string, RevisionCode string, SnapshotDate string, TotalValueEgp double, TotalValueUsd double, TotalItemsCount bigint, ContentHash string",
        "SnapshotItems": "Id string, RevisionId bigint, BillNumber string, SectionName string, ItemCode string, Description string, NormalizedDescription string, Unit string, Quantity double, UnitRate double, TotalAmount double, Currency string, ItemType int",
    },
    2: {"Snapshots": "InvoiceName string, SourceFileName string, TargetFileName string, ExportFilePath string"},
    3: {
        "MappingPresets": "PresetName string, ContractorName string, SourceRateCol int, TargetRateCol int, SourceDescCol int, TargetDescCol int, SourceCodeCol int, TargetCodeCol int, SourceQtyCol int, TargetQtyCol int, SourceUnitCol int, TargetUnitCol int, CreatedAt string",
        "ItemAuditTrail": "AuditId bigint, ItemId string, BillNumber string, ItemCode string, Description string, OldRate double, NewRate double, Action string, Reason string, Engineer string, Timestamp string",
    },
}
LATEST = max(SCHEMAS)


def layout(name: str, version: int = LATEST) -> dict[str, str]:
    """Column -> type of a stored table at a layout version; empty before the table exists."""
    return dict(c.split(" ") for v in range(1, version + 1) if name in SCHEMAS[v] for c in SCHEMAS[v][name].split(", "))


def migrated(df: DataFrame, name: str, version: int = LATEST) -> DataFrame:
    """DB1, DB3: rows of an older layout in a newer one; names are compared without case, new columns are null."""
    have = {c.lower(): c for c in df.columns}
    known = layout(name, version)
    cols = [(F.col(f"`{have[c.lower()]}`") if c.lower() in have else F.lit(None)).cast(t).alias(c) for c, t in known.items()]
    extra = [F.col(f"`{c}`") for c in df.columns if c.lower() not in {k.lower() for k in known}]
    return df.select(*cols, *extra)


def read_store(spark: SparkSession, folder: str, name: str, version: int = LATEST) -> DataFrame:
    """SC8: a stored table in the asked layout, whatever layouts its files were written in."""
    return migrated(spark.read.option("mergeSchema", "true").parquet(f"{folder}/{name}"), name, version)


def variance_columns(base: Column, now: Column) -> tuple[Column, Column]:
    """AG3: difference, and its percentage of the base (0 for a base of 0)."""
    d = now - base
    return d, F.when(base != 0, d.cast("double") / base.cast("double") * 100).otherwise(0.0)


def analytics_bundle(pairs: DataFrame, audited: DataFrame) -> dict[str, DataFrame]:
    """AG22: all analyses of a tender, each a plan over the same pairs; the anomalies, which two of them need, are found once.

    audited: id, unit_rate, quantity, total_amount of the priced items.
    """
    anomalies = cut(A.rate_audit(audited))
    n = F.lit(anomalies.count())
    return {
        "pareto": A.pareto(pairs), "trades": A.trade_breakdown(pairs), "variance": A.variance(pairs), "distribution": A.distribution(pairs, "injected_rate", "bill"),
        "anomalies": anomalies, "currencies": A.fx_sensitivity(pairs), "scorecard": A.scorecard(pairs, n),
    }


def dashboard(pairs: DataFrame, top: int = 10) -> dict[str, DataFrame]:
    """SK4: the blocks of the dashboard: totals per bill, counts, trades and the largest lines."""
    priced = pairs.where("injected_rate > 0")
    bills = pairs.groupBy("bill").agg(F.count("*").alias("items"), F.count_if(F.col("injected_rate") > 0).alias("priced"), A.total(A.amount()).cast("double").alias("total"))
    lines = priced.select("id", "bill", A.amount().alias("amount")).orderBy(F.desc("amount"), "id").limit(top)
    return {"bills": bills, "counts": A.match_counts(pairs), "trades": A.trade_breakdown(pairs), "drivers": lines.withColumn("amount", F.col("amount").cast("double"))}


# Marks of sheets that hold no bill and of provisional sums, the longest code that a name without one gives.
NO_BILLS, PS_PARTS, PS_END, CODE_LENGTH = ["audit", "dashboard"], ["provisional", " ps"], "ps", 12
# Categories of bills: name, parts of codes, parts of descriptions, codes shown, class.
TRADE_CATEGORIES = [
    ("Civil Infrastructure Networks", ["05"], ["infra", "civil", "network"], 3, "Class A (Core Driver)"),
    ("Residential Townhouses", ["03"], ["townhouse", "plex", "th"], 5, "Class A (Core Driver)"),
    ("Residential Villas", ["02"], ["villa"], 5, "Class B (Secondary Scope)"),
    ("Commercial Retail Center", ["04"], ["retail", "commercial"], 3, "Class C (Operational Scope)"),
]
OTHER_WORKS, OTHER_CODES, OTHER_CLASS = "General & Other Measured Works", 4, "Class C (Operational Scope)"
PROTECTED, PROTECTED_CLASS = "Provisional Sums (Protected Scope)", "Contingency Reserve"
#: Categories whose name tells the number of their bills.
COUNTED = ["Residential Townhouses", "Residential Villas", OTHER_WORKS]


def structured_bills(pairs: DataFrame, key: str = "bill") -> DataFrame:
    """AG13, AG15: one row a bill with code, description, items, priced total, status and whether it holds provisional sums.

    The code is what stands before the first dash, else Bill and its number, else the name's beginning.
    """
    c, k = F.col, F.coalesce(F.col(key), F.lit(""))
    low = F.lower(k)
    g = pairs.where(~reduce(lambda a, b: a | b, [low.contains(w) for w in NO_BILLS])).groupBy(k.alias("bill")).agg(F.count("*").alias("items"), F.count_if(c("injected_rate") > 0).alias("priced"), A.total(A.amount(), c("injected_rate") > 0).alias("total"))
    name, dash = F.lower("bill"), F.instr("bill", "-")
    numbered = F.trim(F.regexp_extract("bill", r"(?i)^(Bill\s*[0-9]+(?:\.[0-9]+)?[A-Za-z]*)", 1))
    rest = F.trim(F.expr("substring(bill, length(_n) + 1)"))
    ps = reduce(lambda a, b: a | b, [name.contains(w) for w in PS_PARTS]) | name.endswith(PS_END)
    g = g.withColumns({"_n": numbered, "is_ps": ps})
    code = F.when(dash > 1, F.trim(F.expr("left(bill, instr(bill, '-') - 1)"))).when(c("_n") != "", c("_n")).when(F.length("bill") > CODE_LENGTH, F.trim(F.left("bill", F.lit(CODE_LENGTH)))).otherwise(c("bill"))
    described = F.when(dash > 1, F.trim(F.expr("substring(bill, instr(bill, '-') + 1)"))).when(c("_n") != "", F.when(rest == "", c("_n")).otherwise(rest)).otherwise(c("bill"))
    status = F.when(c("is_ps"), "Provisional Sum (Shielded)").when(c("priced") > 0, "Priced & Approved").otherwise("Tender Scope (Manual)")
    return g.select("bill", code.alias("code"), described.alias("description"), "items", "total", status.alias("status"), "is_ps")


def trade_categories(bills: DataFrame, categories: list[tuple] | None = None) -> DataFrame:
    """AG15: bills by category, each with the number of its bills, its first codes in natural order, total and class.

    categories: like TRADE_CATEGORIES.  A bill may be in several of them; what is in none is other works, provisional sums
    are a category of their own, and a category without bills has no row.  A sole bill of other works names them.
    """
    c, categories = F.col, categories or TRADE_CATEGORIES
    any_of = lambda x, words: reduce(lambda a, b: a | b, [F.lower(x).contains(w.lower()) for w in words])
    found = F.filter(F.array(*[F.when(any_of("code", codes) | any_of("description", words), F.lit(n)) for n, codes, words, _, _ in categories]), lambda x: x.isNotNull())
    place = F.when(c("is_ps"), F.array(F.lit(PROTECTED))).when(F.size(found) == 0, F.array(F.lit(OTHER_WORKS))).otherwise(found)
    b = bills.withColumn("category", F.explode(place))
    sums = b.groupBy("category").agg(F.count("*").alias("bills"), F.sum("items").alias("items"), A.total(c("total")).cast("double").alias("total"), F.min("description").alias("_one"))
    shown = {n: k for n, _, _, k, _ in categories} | {OTHER_WORKS: OTHER_CODES, PROTECTED: 0}
    classes = {n: k for n, _, _, _, k in categories} | {OTHER_WORKS: OTHER_CLASS, PROTECTED: PROTECTED_CLASS}
    of = lambda table: F.coalesce(*[F.when(c("category") == n, F.lit(v)) for n, v in table.items()])
    # the rank lets each task keep its first few rows of a category only
    order = Window.partitionBy("category").orderBy(T.natural_key(c("code")), "bill")
    first = b.withColumn("_n", F.row_number().over(order)).where(c("_n") <= max(shown.values())).where(c("_n") <= of(shown))
    codes = first.groupBy("category").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "code"))), lambda x: x["code"]), ", ").alias("codes"))
    name = F.when((c("category") == OTHER_WORKS) & (c("bills") == 1), c("_one")).when(c("category").isin(COUNTED), F.concat("category", F.lit(" ("), c("bills").cast("string"), F.lit(" Bills)"))).otherwise(c("category"))
    packages = F.concat(c("bills").cast("string"), F.lit(" Shielded Packages"))
    return sums.join(codes, "category", "left").select("category", name.alias("name"), "bills", "items", "total", F.when(c("category") == PROTECTED, packages).otherwise(c("codes")).alias("codes"), of(classes).alias("class"))


def reconciled_name(workbook: Column) -> Column:
    """SK7: file name of a target's priced workbook."""
    return F.concat(F.regexp_replace(F.element_at(F.split(workbook, r"[/\\]"), -1), r"\.[^.]*$", ""), F.lit("_Reconciled.xlsx"))


def priced_rows(pairs: DataFrame) -> DataFrame:
    """SK1, SK7: per target line its workbook's file, the action on its rate cell and the rate that the cell then holds."""
    act = rate_cell_action()
    rate = F.when(act == "inject", F.col("injected_rate")).when(act != "clear", F.col("original_rate"))
    return pairs.select(reconciled_name(F.col("workbook")).alias("target_workbook"), "sheet", "row", "id", "code", "description", "unit", F.col("quantity").cast("double"), act.alias("action"), rate.cast("double").alias("rate"))


def write_batch(pairs: DataFrame, path: str) -> None:
    """SK7: priced rows as Parquet, one folder a target workbook."""
    priced_rows(pairs).write.mode("overwrite").partitionBy("target_workbook").parquet(path)


HEADS = ["Item", "Description", "Unit", "Qty", "Rate", "Amount"]


class _Workbook:
    """A plain .xlsx file written row by row and compressed as it grows, so that no sheet is held as text."""

    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"

    def __init__(self):
        self.out, self.sheets, self.open = io.BytesIO(), [], None
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_DEFLATED)

    def start(self, sheet: str) -> None:
        self.end()
        self.sheets.append(sheet)
        self.open, self.rows, self.text = self.zip.open(f"xl/worksheets/sheet{len(self.sheets)}.xml", "w", force_zip64=True), 0, [f'<worksheet xmlns="{self.main}"><sheetData>']

    def row(self, values: list) -> None:
        self.rows += 1
        self.text.append(f'<row r="{self.rows}">{"".join(self._cell(k, v) for k, v in enumerate(values))}</row>')
        if len(self.text) >= 1000:
            self._flush()

    def _cell(self, k: int, v) -> str:
        ref = f"{chr(65 + k)}{self.rows}"
        if v is None or v != v:
            return ""
        return f'<c r="{ref}"><v>{v!r}</v></c>' if isinstance(v, (int, float)) else f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    def _flush(self) -> None:
        self.open.write("".join(self.text).encode())
        self.text = []

    def end(self) -> None:
        if self.open is not None:
            self.text.append("</sheetData></worksheet>")
            self._flush()
            self.open.close()
            self.open = None

    def close(self) -> bytes:
        """The whole file, after its last sheet."""
        self.end()
        kinds, package = "http://schemas.openxmlformats.org/package/2006/content-types", "http://schemas.openxmlformats.org/package/2006/relationships"
        doc = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        n = range(1, len(self.sheets) + 1)
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{doc}.worksheet+xml"/>' for k in n)
        with self.zip as z:
            z.writestr("[Content_Types].xml", f'<Types xmlns="{kinds}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{doc}.sheet.main+xml"/>{parts}</Types>')
            z.writestr("_rels/.rels", f'<Relationships xmlns="{package}"><Relationship Id="rId1" Type="{self.rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
            z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}">' + "".join(f'<Relationship Id="rId{k}" Type="{self.rel}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in n) + "</Relationships>")
            z.writestr("xl/workbook.xml", f'<workbook xmlns="{self.main}" xmlns:r="{self.rel}"><sheets>' + "".join(f'<sheet name={quoteattr(s)} sheetId="{k}" r:id="rId{k}"/>' for k, s in zip(n, self.sheets)) + "</sheets></workbook>")
        return self.out.getvalue()


def workbook_bytes(sheets: dict[str, list[list]]) -> bytes:
    """A plain .xlsx file: sheet name -> rows of cells."""
    book = _Workbook()
    for name, rows in sheets.items():
        book.start(name)
        for values in rows:
            book.row(values)
    return book.close()


def priced_workbooks(pairs: DataFrame, sheet_rows: int = 1_000_000) -> DataFrame:
    """SK1, SK7 as files: (target_workbook, part, content), plain .xlsx files without styles.

    One task writes one file, row by row as they come sorted; it holds the compressed file only.  A target of more rows
    than a sheet can hold in all is split into parts by row number, so no task gathers an unbounded target.
    """
    rows = priced_rows(pairs).withColumn("part", F.floor(F.col("row") / sheet_rows).cast("int"))
    file = ["target_workbook", "part"]
    rows = rows.repartition(*file).sortWithinPartitions(*[F.asc_nulls_last(c) for c in (*file, "sheet", "row", "id")])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, book = None, None
        done = lambda: pd.DataFrame({"target_workbook": [at[0]], "part": [at[1]], "content": [book.close()]})
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                key = (r.target_workbook, None if pd.isna(r.part) else int(r.part))
                if key != at:
                    if book is not None:
                        yield done()
                    at, book = key, _Workbook()
                if not book.sheets or book.sheets[-1] != r.sheet:
                    book.start(r.sheet)
                    book.row(HEADS)
                rate = None if pd.isna(r.rate) else float(r.rate)
                book.row([r.code, r.description, r.unit, float(r.quantity), rate, None if rate is None else rate * float(r.quantity)])
        if book is not None:
            yield done()

    return rows.mapInPandas(run, "target_workbook string, part int, content binary")


def archive(files: DataFrame, target: str) -> int:
    """SK8: a zip of files (name, content) on the driver's disk, one file in memory at a time; how many it holds."""
    n = 0
    with zipfile.ZipFile(target, "w", zipfile.ZIP_STORED) as z:
        for r in files.select("name", "content").toLocalIterator():
            z.writestr(r["name"], bytes(r["content"]))
            n += 1
    return n
