"""Workbooks as cells, headers, items and profiles.

A workbook file is read whole by one task (``binaryFile``, so any path Spark can read) and becomes rows (workbook,
sheet, row, col, raw).  Only parsing and the resolution of flat headers, per file and sheet, are Python.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from functools import reduce
from itertools import islice
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..operators.checkpoints import cut

SHEET = ["workbook", "sheet"]
CELLS = "workbook string, sheet string, row int, col int, raw string, formula string"
#: Cells that a task hands over at once.
AT_ONCE = 10_000
#: Parts that one task turns into cells: a few bytes of a file become many cells.
PARTS_AT_ONCE = 50_000
#: Rows in which a header is looked for.
FLAT_ROWS, TREE_ROWS = 40, 60
ORDER = ["serial", "code", "description", "unit", "quantity", "composite", "partial", "rate", "amount", "bill", "section"]
_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}


def parse_workbook(name: str, content: bytes) -> Iterator[tuple]:
    """Cells of an .xlsx or .xlsm file: shared, inline and plain values, and formulas."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS)]
        rels = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ET.fromstring(z.read("xl/workbook.xml")).findall("m:sheets/m:sheet", _NS):
            target = rels[sheet.get(f"{{{_NS['r']}}}id")]
            path = target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")
            for c in _sheet_cells(z, path):
                m = re.fullmatch(r"([A-Z]+)(\d+)", c.get("r") or "")
                v, f = c.find("m:v", _NS), c.find("m:f", _NS)
                text = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t")) if c.get("t") == "inlineStr" else v.text if v is not None else None
                if c.get("t") == "s" and text is not None:
                    text = shared[int(text)]
                if m and (text is not None or f is not None):
                    col = 0
                    for ch in m[1]:
                        col = col * 26 + ord(ch) - 64
                    yield name, sheet.get("name"), int(m[2]), col, text, f.text if f is not None else None


def _sheet_cells(z: zipfile.ZipFile, path: str) -> Iterator[ET.Element]:
    """The cells of a sheet in order, each dropped with its row."""
    cell, row, data = (f"{{{_NS['m']}}}{x}" for x in ("c", "row", "sheetData"))
    rows = None
    with z.open(path) as f:
        for event, e in ET.iterparse(f, ("start", "end")):
            if event == "start":
                rows = e if e.tag == data else rows
            elif e.tag == cell:
                yield e
            elif e.tag == row and rows is not None:
                rows.clear()


def read_workbooks(spark: SparkSession, *paths: str) -> DataFrame:
    """SC1, SC6, SC9, SC10: cells of all workbooks under the paths (each distinct path once, whatever its case)."""
    return cells_of(spark.read.format("binaryFile").load(list({p.lower(): p for p in paths}.values())))


def cells_of(files: DataFrame) -> DataFrame:
    """Cells of workbook files (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                cells = parse_workbook(posixpath.basename(path), bytes(content))
                while rows := list(islice(cells, AT_ONCE)):
                    yield pd.DataFrame(rows, columns=["workbook", "sheet", "row", "col", "raw", "formula"])

    return files.select("path", "content").mapInPandas(run, CELLS)


def dealt(part: DataFrame) -> DataFrame:
    """Parts in tasks of at most PARTS_AT_ONCE rows or so, however small their file is."""
    return part.repartition(-(-max(1, part.count()) // PARTS_AT_ONCE), "p_partkey")


def apart(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by the keys to as many tasks as there are shuffle partitions; these are not joined up by their bytes,
    of which a row has few in a shuffle and many in a task."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def demo_cells(part: DataFrame, hierarchical: bool) -> DataFrame:
    """Parts as cells of three workbooks: one sheet a type, a heading row, then one row a part (its number is the row).

    Some quantities are in Arabic digits, some amounts formulas or broken cells.
    """
    part = dealt(part)
    heads = ["Item", "Description", "Unit", "Qty", "Rate" if hierarchical else "Unit Rate", "Amount"]
    size, gap = F.col("p_size"), (F.col("p_size") % 5 == 0) if hierarchical else F.lit(False)
    quantity = F.when(size % 6 == 0, F.translate(size.cast("string"), "0123456789", "٠١٢٣٤٥٦٧٨٩")).otherwise(size.cast("string"))
    row = (F.col("p_partkey") + 2).cast("int")
    cell = lambda raw, formula=None: F.struct(raw.alias("raw"), (F.lit(None).cast("string") if formula is None else formula).alias("formula"))
    formula = F.when(size % 4 == 0, F.concat(F.lit("D"), row.cast("string"), F.lit("*E"), row.cast("string")))
    broken = F.when((size % 4 != 0) & (size % 7 == 0), "#REF!")
    cells = F.array(cell(F.col("p_brand")), cell(F.col("p_name")), cell(F.when(~gap, "m2")), cell(F.when(~gap, quantity)), cell(F.col("p_retailprice").cast("decimal(18,2)").cast("string")), cell(broken, formula))
    key = [F.concat(F.lit("W"), (F.col("p_partkey") % 3).cast("string")).alias("workbook"), F.col("p_type").alias("sheet")]
    rows = part.select(*key, row.alias("row"), cells.alias("v")).unionByName(part.select(*key).distinct().select("workbook", "sheet", F.lit(1).alias("row"), F.array(*[cell(F.lit(h)) for h in heads]).alias("v")))
    out = rows.select("workbook", "sheet", "row", F.posexplode("v").alias("col", "c")).where("c.raw is not null or c.formula is not null")
    return out.select("workbook", "sheet", "row", (F.col("col") + 1).alias("col"), "c.raw", "c.formula")


#: Headings of the three kinds of demo sheets: bill and section columns, levels, Arabic.
LISTED = ["Bill No", "Section", "Item", "Description", "Unit", "Qty", "Unit Rate", "Amount"]
LEVELLED = ["Level 1", "Level 2", "Level 3", "Item", "Description", "Unit", "Qty", "Unit Rate", "Amount"]
ARABIC = ["الباب", "مجموعة", "رقم البند", "الوصف", "الوحدة", "الكمية", "سعر الوحدة", "الإجمالي"]


def demo_ledger(part: DataFrame) -> DataFrame:
    """Parts as cells of flat sheets of three kinds, with texts and section rows between the items.

    A part k takes rows 3 k + 5 (a text), + 6 (a section) and + 7 (the item); headings are in row 3, with levels the rate
    and the amount have theirs in row 4.
    """
    c, k = F.col, F.col("p_partkey")
    kind = F.when(c("p_type") == "STANDARD", "levels").when(c("p_type") == "PROMO", "arabic").otherwise("listed")
    p = dealt(part).select("*", F.concat(F.lit("W"), (k % 3).cast("string")).alias("workbook"), c("p_type").alias("sheet"), kind.alias("kind"))
    text = lambda cond, v: F.when(cond, F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in v]))
    listed = [text(k % 5 == 0, ["Bill ", k % 7]), text(k % 8 == 0, ["Class ", k % 4])]
    levels = [text(k % 2 == 0, ["Works"]), F.when(k % 10 == 0, "WORKS").otherwise(text(k % 3 != 0, ["Zone ", k % 3])), text(k % 4 == 0, ["Part ", k % 5])]
    description = F.when(k % 37 == 0, "Description").when(k % 11 == 0, F.concat(F.lit("Provisional sum for "), c("p_name"))).otherwise(c("p_name"))
    figures = [F.when(k % 6 != 0, c("p_brand")), description, F.lit("m2"), F.when(k % 13 != 0, c("p_size").cast("string")), F.when(k % 17 != 0, c("p_retailprice").cast("decimal(18,2)").cast("string")), F.when(k % 19 == 0, "123.45")]
    put = lambda front, shown: F.when(c("kind") == "levels", F.array(*front[1], *shown)).otherwise(F.array(*front[0], *shown))
    null = F.lit(None).cast("string")
    alone = lambda v: put(([null] * 2, [null] * 3), [null, v])
    rows = [(3 * k + 5, c("p_size") % 4 == 1, alone(F.concat(F.lit("Note "), c("p_name")))), (3 * k + 6, c("p_size") % 9 == 0, alone(F.concat(F.lit("SECTION "), c("p_brand")))), (3 * k + 7, F.lit(True), put((listed, levels), figures))]
    body = [p.where(when).select("workbook", "sheet", row.cast("int").alias("row"), v.alias("v")) for row, when, v in rows]
    words = lambda ws: F.array(*[F.lit(w) if w else null for w in ws])
    head = p.select("workbook", "sheet", "kind").distinct()
    first = F.when(c("kind") == "levels", words([*LEVELLED[:-2], None, None])).when(c("kind") == "arabic", words(ARABIC)).otherwise(words(LISTED))
    heads = [head.select("workbook", "sheet", F.lit(3).alias("row"), first.alias("v")), head.where("kind = 'levels'").select("workbook", "sheet", F.lit(4).alias("row"), words([None] * 7 + LEVELLED[-2:]).alias("v"))]
    every = reduce(DataFrame.unionByName, [*body, *heads])
    return every.select("workbook", "sheet", "row", F.posexplode("v").alias("col", "raw")).where("raw is not null").select("workbook", "sheet", "row", (c("col") + 1).alias("col"), "raw", null.alias("formula"))


def demo_tree(part: DataFrame) -> DataFrame:
    """Parts as cells of hierarchical sheets: sections, code rows, notes and sums between the rows with figures.

    A part k takes rows 4 k + 5 (a section), + 6 (its code), + 7 (a note or a sum) and + 8 (its figures); a title is in row 1,
    headings are in row 3.  One type's sheets hold provisional sums, one's have no headings, one's are no bills.
    """
    c, k = F.col, F.col("p_partkey")
    sheet = F.when(c("p_type") == "PROMO", "Provisional Sums").when(c("p_type") == "SMALL", "Cover").otherwise(c("p_type"))
    p = dealt(part.where("p_type is not null")).select("*", F.concat(F.lit("W"), (k % 3).cast("string")).alias("workbook"), sheet.alias("sheet"))
    null = F.lit(None).cast("string")
    figure = lambda x: F.format_string("%.2f", x)
    section = [F.when(k % 18 == 0, F.concat(F.lit("S"), (k % 4).cast("string"))), null, F.concat(F.lit("SECTION "), c("p_brand")), null, null, null, null]
    coded = [null, F.when(k % 15 == 1, F.concat(F.lit("much too long "), c("p_brand"))).otherwise(c("p_brand")), F.lit("Supply of"), null, null, null, null]
    note = [F.when(k % 20 == 1, (k % 100).cast("string")), null, F.when(k % 4 == 1, F.concat(F.lit("Note "), c("p_name"))).otherwise("Total of works"), null, null, null, null]
    quantity = F.when(k % 12 == 0, "Ignored").when(k % 6 != 0, c("p_size").cast("string"))
    rate = F.when(k % 22 == 0, "0").when(k % 11 != 0, figure(c("p_retailprice")))
    amount = F.when(k % 13 == 0, "Rate only").when(k % 33 == 11, figure(c("p_size") * F.lit(2.5)))
    figures = [F.when(k % 5 == 0, (k % 50).cast("string")), null, F.when(k % 10 != 7, c("p_name")), F.when(k % 7 != 0, "m2"), quantity, rate, amount]
    rows = [(5, k % 9 == 0, section), (6, k % 3 != 0, coded), (7, k % 4 % 2 == 1, note), (8, F.lit(True), figures)]
    body = [p.where(when).select(*SHEET, (4 * k + n).cast("int").alias("row"), F.array(*v).alias("v")) for n, when, v in rows]
    names = p.select(*SHEET, "p_type").distinct()
    words = lambda ws: F.array(*[F.lit(w) if w else null for w in ws])
    heads = F.when(c("p_type") == "LARGE", words(["S/N", "Item No.", "Description of works", "UOM", "Quantity", "Rate (EUR)", "Total"])).otherwise(words(["م", "كود", "البيان", "الوحدة", "الكمية", "سعر", "جملة"]))
    body += [names.select(*SHEET, F.lit(1).alias("row"), words(["Project", "Description"]).alias("v")), names.where("p_type <> 'ECONOMY'").select(*SHEET, F.lit(3).alias("row"), heads.alias("v"))]
    every = reduce(DataFrame.unionByName, body)
    return every.select(*SHEET, "row", F.posexplode("v").alias("col", "raw")).where("raw is not null").select(*SHEET, "row", (c("col") + 1).alias("col"), "raw", null.alias("formula"))


def demo_runs(part: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parts as cells of source workbooks (bills in the third column, one without bills, one without headings) and of target
    workbooks (one with many bill sheets, one with few), and runs over them, some with a source that is not there."""
    c, k = F.col, F.col("p_partkey")
    p = part.select("*", F.concat(F.lit("S"), (k % 3).cast("string")).alias("source"), F.concat(F.lit("T"), (k % 2).cast("string")).alias("target"))
    bill = F.when((k % 3 == 1) | (k % 4 == 0), "Class").otherwise(F.concat(F.lit(" bill "), (k % 5).cast("string")))
    line = F.array(k.cast("string"), c("p_brand"), bill, c("p_type"), c("p_name"))
    head = F.array(*[F.lit(x) for x in ("No", "Class", "Bill", "Section", "Description", "Unit", "Qty", "Rate", "Total")])
    rows = p.select(c("source").alias("workbook"), F.lit("Rates").alias("sheet"), (k + 4).cast("int").alias("row"), line.alias("v"))
    heads = p.where("source <> 'S2'").select(c("source").alias("workbook")).distinct().select("workbook", F.lit("Rates").alias("sheet"), F.lit(2).alias("row"), head.alias("v"))
    number = F.concat(F.lit("Bill "), (k % 24).cast("string"))
    sheet = F.when(k % 2 == 1, F.concat(F.lit("Bill "), (k % 3).cast("string"))).when(k % 24 == 6, F.concat(number, F.lit(" Provisional Sum"))).otherwise(number)
    names = p.select(c("target").alias("workbook"), sheet.alias("sheet"), (k + 1).cast("int").alias("row"), F.array("p_name").alias("v"))
    every = rows.unionByName(heads).unionByName(names)
    cells = every.select("workbook", "sheet", "row", F.posexplode("v").alias("col", "raw")).where("raw is not null").select("workbook", "sheet", "row", (c("col") + 1).alias("col"), "raw", F.lit(None).cast("string").alias("formula"))
    return cells, p.select(F.when(k % 7 == 0, "S9").otherwise(c("source")).alias("source"), "target").distinct()


def header_roles(x: Column) -> Column:
    """NR7: roles whose pattern the cell fits, as an array."""
    t = F.trim(F.coalesce(x, F.lit("")))
    return F.filter(F.array(*[F.when(t.rlike("(?i)" + R.HEADERS[r]), F.lit(r)) for r in ORDER]), lambda v: v.isNotNull())


COLUMNS = ["code", "serial", "description", "unit", "quantity", "rate", "amount", "bill", "section"]
HEADERS = "workbook string, sheet string, header int, found boolean, currency string, " + ", ".join(f"{c} int" for c in COLUMNS) + ", hierarchy array<int>"
# Default columns (from 1), roles that make a header row, headings that are a rate whatever else they fit.
DEFAULTS = {"description": 3, "quantity": 5, "unit": 6, "rate": 7, "amount": 8}
HEADER_HITS = ["code", "serial", "description", "unit", "quantity", "rate", "amount"]
RATE_NAMES = ["u.r", "ur", "unit rate", "tender rate", "سعر الوحدة"]
RATE_PARTS = ["uplifted unit rate", "unit rate\nuplifted", "ccc unit rate uplifted"]
# Beginnings of cells that tell a column of bills or of sections.
BILL_CELLS, SECTION_CELLS = ("bill ", "schedule ", "الباب ", "جدول "), ("section ", "قسم ", "بند رئيسي")
_FITS = {role: re.compile(pattern, re.IGNORECASE) for role, pattern in R.HEADERS.items()}


def _is_number(text: str) -> bool:
    return re.fullmatch(r"\s*[-+]?[\d,]*\.?\d+\s*|\s*[-+]?[\d,]+\.\s*", text) is not None


def _claim(row: dict[int, str], at: dict[str, int], tree: list[int]) -> None:
    """Columns that the cells of one header row name; the first of a role stays, but a better rate replaces a rate."""
    whole = False
    for c in sorted(row):
        text, low = row[c], row[c].lower()
        fits = {role for role, pattern in _FITS.items() if pattern.search(text)}
        if "composite" in fits:
            at["rate"], whole = c, True
            continue
        named = low in RATE_NAMES or any(w in low for w in RATE_PARTS)
        if not whole and "amount" not in low and (named or "rate" in fits):
            if named or "rate" not in at or "partial" not in fits:
                at["rate"] = c
            continue
        for role in ("amount", "quantity", "unit", "description", "serial", "code", "bill", "section"):
            if role in fits and role not in at and not (role == "unit" and ("rate" in low or "price" in low)):
                at[role] = c
                break
        else:
            if "hierarchy" in fits and c not in tree:
                tree.append(c)


def resolve_grid(grid: dict[int, dict[int, str]], rows: int) -> dict:
    """NR6: header row, columns by role and currency of one sheet, from its first ``rows`` rows (row -> column -> text)."""
    grid = {r: {c: t.strip() for c, t in v.items() if t and t.strip()} for r, v in grid.items() if r <= rows}
    currency, hits = "EGP", {}
    for r in sorted(grid):
        for text in grid[r].values():
            if "usd" in text.lower() or "($)" in text:
                currency = "USD"
            elif "eur" in text.lower() or "(€)" in text:
                currency = "EUR"
        hits[r] = sum(any(_FITS[role].search(t) for role in HEADER_HITS) for t in grid[r].values())
    best = max(sorted(hits), key=lambda r: hits[r], default=1)
    found = hits.get(best, 0) >= 2
    header, at, tree = best if found else 1, {}, []
    if found:
        for r in (best, best + 1, best - 1):  # headings may take two rows; a row of numbers is no heading
            if r == best or sum(map(_is_number, grid.get(r, {}).values())) <= 1:
                _claim(grid.get(r, {}), at, tree)
    below = [v for r, v in grid.items() if r > header]
    wide = max((max(v) for v in grid.values() if v), default=0)
    units = dict.fromkeys(R.KNOWN_UNITS)
    for c in range(1, wide + 1):
        texts = [v[c] for v in below if c in v]
        starts = lambda words: [t for t in texts if t.lower().startswith(words)]  # noqa: B023, E731
        bills, known = len(starts(BILL_CELLS)), sum(t.lower() in units for t in texts)
        if "description" not in at and sum(map(len, texts)) > 60 and not bills and not any(map(_is_number, texts)):
            at["description"] = c
        elif "unit" not in at and known >= 2:
            at["unit"] = c
        if "bill" not in at and bills >= 2:
            at["bill"] = c
        if "section" not in at and len([t for t in starts(SECTION_CELLS) if not t.lower().startswith(BILL_CELLS)]) >= 2:
            at["section"] = c
    if "unit" not in at:
        at |= {"unit": c for c in range(wide, 0, -1) if any(v.get(c, "").lower() in units for v in below)}
    if not tree and at.get("description", 0) > 2:
        end = min(at["description"], at.get("code", at["description"]))
        tree = [c for c in range(1, end) if c not in (at.get("serial"), at.get("code"), at.get("bill"), at.get("section"))]
    for a, b in (("code", "serial"), ("serial", "code")):
        if a not in at and b in at and at[b] not in tree:
            at[a] = at[b]
    at = DEFAULTS | at
    if "code" not in at and 1 not in tree:
        at["code"] = 1
    if at.get("code") in tree:
        del at["code"]
    return {"header": header if found else 1, "found": found, "currency": currency, **{c: at.get(c) for c in COLUMNS}, "hierarchy": sorted(set(tree))}


def resolve_headers(cells: DataFrame, rows: int = FLAT_ROWS) -> DataFrame:
    """NR6, SC5, WN9: per sheet the header row (most hits, at least two, first wins), the column of each role, the currency.

    Neighbouring rows add headings, the cells below tell missing columns, defaults fill the rest; a sheet without a
    header row is read by these alone.  Only the first ``rows`` rows of a sheet reach its task.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        grid: dict[int, dict[int, str]] = {}
        for r, c, t in zip(pdf["row"], pdf["col"], pdf["raw"]):
            grid.setdefault(int(r), {})[int(c)] = t
        found = {"workbook": pdf["workbook"].iloc[0], "sheet": pdf["sheet"].iloc[0], **resolve_grid(grid, rows)}
        return pd.DataFrame([found]).astype({c: "Int32" for c in COLUMNS})

    return cells.where((F.col("row") <= rows) & F.col("raw").isNotNull()).select("workbook", "sheet", "row", "col", "raw").groupBy("workbook", "sheet").applyInPandas(one, HEADERS)


# Beginnings of a text that names a section, texts that repeat a heading, words that tell an item's type.
SECTION_STARTS = ["section", "bill no", "part ", "division", "باب", "قسم"]
HEADING_TEXTS = ["description", "الوصف", "البيان", "bill item description"]
RATE_ONLY, PROVISIONAL, LUMP = ["rate only", "سعر فقط"], ["provisional sum", "مبلغ احتياطي"], "مقطوعية"
VALUES = ["code", "serial", "description", "unit", "quantity", "rate", "amount", "bill", "section", "number_off", "note"]


def _wide(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """One row per sheet row below its header: each role's text, and the texts of the hierarchy columns from left to right.

    headers: one row a sheet.  Rows are dealt one by one, so neither a sheet nor a file is one task.
    """
    j = cells.join(F.broadcast(headers), ["workbook", "sheet"]).where(F.col("row") > F.when(F.col("found"), F.col("header")).otherwise(0))
    level = F.when(F.array_contains("hierarchy", F.col("col")) & (F.trim("raw") != ""), F.struct("col", F.trim("raw").alias("raw")))
    known = [r for r in VALUES if r in headers.columns]
    roles = [F.max(F.when(F.col("col") == F.col(r), F.col("raw"))).alias(f"v_{r}") for r in known]
    w = apart(j, "workbook", "sheet", "row").groupBy("workbook", "sheet", "row").agg(*roles, F.array_sort(F.collect_list(level)).alias("levels"), F.first("currency").alias("currency"))
    return w.select("workbook", "sheet", "row", "currency", F.transform("levels", lambda x: x["raw"]).alias("levels"), *[F.col(f"v_{r}").alias(r) for r in known])


def _once(levels: Column) -> Column:
    """The levels without repetitions, whatever their case."""
    low = F.transform(levels, F.lower)
    return F.filter(levels, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def flat_items(cells: DataFrame, columns: dict[str, int] | None = None) -> DataFrame:
    """SC1, SC3, NR13, WN3, WN4: the items of flat sheets, whose rows are read in order.

    Bill and section are carried down: a bill from its column or the last hierarchy level, a section from its column, the
    level above or a row that names one.  Texts without figures gather in front of the next item of their section.  A
    missing amount is rate x quantity x number off.  Non-bill sheets, metadata rows and repeated headings are no items.
    columns: column numbers (from 1) by role that replace what the headings say; number_off and note are known this way only.

    All by columns: what is carried down runs along a sheet, which the format limits to 1,048,576 rows, and texts meet
    their item in a grouping by block.
    """
    c = F.col
    none = F.lit(None).cast("int")
    headers = resolve_headers(cells).withColumns({r: F.lit(k) for r, k in {**{r: none for r in VALUES if r not in COLUMNS}, **(columns or {})}.items()})
    w = _wide(cells.where(~R.non_bill(c("sheet"))), headers)
    text = lambda x: F.trim(F.coalesce(c(x), F.lit("")))
    number = lambda x: F.coalesce(T.parse_decimal(c(x)).cast("decimal(18,4)"), F.lit(0).cast("decimal(18,4)"))
    w = w.select(
        "workbook", "sheet", "row", "currency", _once(c("levels")).alias("levels"), F.coalesce(F.nullif(text("code"), F.lit("")), text("serial")).alias("code"), text("serial").alias("serial"), text("description").alias("description"), R.canonical_unit(c("unit")).alias("unit"),
        number("quantity").alias("quantity"), number("rate").alias("rate"), number("amount").alias("amount"), text("bill").alias("bill"), text("section").alias("section"), F.greatest(F.bround(T.parse_decimal(c("number_off"))).cast("int"), F.lit(0)).alias("off"), F.lower(text("note")).alias("note"),
    )
    w = w.withColumn("number_off", F.when(c("off") > 0, c("off")).otherwise(1)).drop("off")
    low, n = F.lower("description"), F.size("levels")
    blank = (c("description") == "") & (c("rate") == 0) & (c("quantity") == 0)
    read = ~(blank | low.isin(HEADING_TEXTS) | R.metadata_row(c("code"), c("description")))
    words = read & (c("quantity") == 0) & (c("rate") == 0) & (c("amount") == 0) & (c("description") != "")
    names = words & low.rlike("^(" + "|".join(SECTION_STARTS) + ")")
    w = w.withColumns({"_item": read & ~words, "_names": names, "_words": words & ~names})
    level = lambda k: F.element_at("levels", k)
    w = w.withColumns({
        "_bill": F.coalesce(F.nullif("bill", F.lit("")), F.when(n > 0, F.get("levels", n - 1))), "_section": F.coalesce(F.when(c("_names"), c("description")), F.nullif("section", F.lit("")), F.when(n >= 3, F.get("levels", n - 2)).when(n == 2, level(1))),
        "path": F.array_join("levels", " / "),
    })
    down = Window.partitionBy("workbook", "sheet").orderBy("row")
    so_far, before = down.rowsBetween(Window.unboundedPreceding, 0), down.rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumns({"bill": F.coalesce(F.last("_bill", ignorenulls=True).over(so_far), c("sheet")), "section": F.coalesce(F.last("_section", ignorenulls=True).over(so_far), F.lit("")), "block": F.coalesce(F.sum((c("_item") | c("_names")).cast("int")).over(before), F.lit(0))})
    item = F.struct("row", "bill", "section", "path", "code", "serial", c("description").alias("line"), "unit", "quantity", "rate", "amount", "number_off", "note", "currency")
    g = w.groupBy("workbook", "sheet", "block").agg(F.array_sort(F.collect_list(F.when(c("_words"), F.struct("row", "description")))).alias("texts"), F.max(F.when(c("_item"), item)).alias("i")).where("i is not null").select("workbook", "sheet", "texts", "i.*")
    full = F.trim(F.concat_ws(" ", F.transform("texts", lambda x: x["description"]), F.array("line")))
    has = lambda x, words: reduce(lambda p, q: p | q, [x.contains(v) for v in words])
    line = F.lower("line")
    kind = F.when(has(c("note"), RATE_ONLY) | ((c("quantity") == 0) & (c("rate") > 0)), "RateOnly").when(has(line, PROVISIONAL) | (line.contains(LUMP) & (c("rate") == 0)), "ProvisionalSum").otherwise("Normal")
    amount = F.when((c("amount") == 0) & (c("rate") > 0) & (c("quantity") > 0), (c("rate") * c("quantity") * c("number_off")).cast("decimal(28,4)")).otherwise(c("amount").cast("decimal(28,4)"))
    kept = lambda x: F.when(c(x) >= 0, c(x)).alias(x)
    return g.withColumns({"description": full, "amount": amount}).select(
        F.concat_ws("_", F.lit("U"), "workbook", "sheet", "row", "code").alias("id"), "workbook", "sheet", "row", "bill", "section", "path", "code", "serial", "line", "description", T.normalise_description(c("description")).alias("normalised"), "unit", "quantity", kept("rate"), kept("amount"), "number_off", "currency", kind.alias("item_type"),
    )


def carried_blocks(rows: DataFrame, sheet: list[str], order: list[str], priced: Column, heading: Column) -> DataFrame:
    """NR13, WN3, WN4: the last heading carried down, and the number of the block that each priced row closes."""
    w = Window.partitionBy(*sheet).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumns({"heading": F.last(heading, ignorenulls=True).over(w), "block": (F.sum(priced.cast("int")).over(w) - priced.cast("int")).cast("long")})


# Headings of hierarchical sheets by role, in the order in which a cell is tried, and how a cell must meet them.
TREE_HEADS = [
    ("serial", "is", ["SN", "S/N", "S.N.", "S.N", "S.NO", "S.NO.", "مسلسل", "م"]),
    ("code", "is", ["ITEM", "ITEM NO.", "ITEM NO", "ITEM CODE", "رقم", "كود", "بند"]),
    ("description", "holds", ["DESCRIPTION", "PARTICULAR", "الوصف", "البيان", "تفاصيل", "المواصفات"]),
    ("quantity", "starts", ["QTY", "QUANTITY", "الكمية", "الكميات"]),
    ("unit", "is", ["UNIT", "UOM", "الوحدة", "وحدة", "وحدة القياس"]),
    ("rate", "starts", ["RATE", "PRICE", "السعر", "الفئة", "سعر", "فئة"]),
    ("amount", "starts", ["AMOUNT", "TOTAL", "الإجمالي", "القيمة", "المبلغ", "جملة"]),
]
# Beginnings of section rows; beginnings, parts and whole texts of rows that sum up; texts that repeat a heading.
TREE_SECTIONS = ["SECTION", "BILL NO", "PART ", "CLASS ", "DIVISION", "قسم", "باب", "بند رئيسي", "أعمال", "مجموعة"]
SUM_STARTS, SUM_PARTS, SUM_WHOLE = ["SUMMARY OF", "TOTAL OF", "إجمالي ", "GRAND TOTAL", "VAT "], ["EXCLUDING VAT", "INCLUDING VAT", "ضريبة"], ["VAT"]
NO_SERIAL, NO_CODE, NO_TEXT, NO_UNIT = ["SN", "م"], ["ITEM", "م", "بند"], ["DESCRIPTION", "الوصف", "البيان"], ["unit", "الوحدة"]
#: Longest serial number and code; sheet names and texts of provisional sums.
SERIAL_LENGTH, CODE_LENGTH = 10, 12
PS_NAMES, PS_TEXTS = ["provisional", "contingenc", "الاحتياطية", "احتياطي"], ["provisional sum", "مبلغ احتياطي", "مبالغ احتياطية"]


def _meets(x: Column, how: str, words: list[str]) -> Column:
    """Whether an upper-case text is, starts with or holds one of the words."""
    if how == "is":
        return x.isin(words)
    one = {"starts": lambda w: x.startswith(w), "holds": lambda w: x.contains(w)}[how]
    return reduce(lambda a, b: a | b, map(one, words))


def tree_headers(cells: DataFrame) -> DataFrame:
    """SC2: the header row, columns and currency of each hierarchical sheet; sheets without a header in 60 rows have no row.

    The first row with a unit and a quantity or description, or with a description, a quantity and a rate or amount; of two
    cells of a role in it the last counts.  The currency is the last one that a cell down to that row names.
    """
    c, roles = F.col, [r for r, _, _ in TREE_HEADS]
    t = F.upper(F.trim("raw"))
    role = F.coalesce(*[F.when(_meets(t, how, words), F.lit(r)) for r, how, words in TREE_HEADS])
    money = F.when((t == "USD") | t.contains("(USD)"), "USD").when((t == "EUR") | t.contains("(EUR)") | t.contains("€"), "EUR")
    top = cells.where((c("row") <= TREE_ROWS) & (F.trim("raw") != "")).select(*SHEET, "row", "col", role.alias("role"), money.alias("money"))
    at = top.groupBy(*SHEET, "row").agg(*[F.max(F.when(c("role") == r, c("col"))).alias(r) for r in roles], F.max_by("money", F.when(c("money").isNotNull(), c("col"))).alias("money"))
    has = {r: c(r).isNotNull() for r in roles}
    whole = (has["unit"] & (has["quantity"] | has["description"])) | (has["description"] & has["quantity"] & (has["rate"] | has["amount"]))
    # at most 60 rows a sheet
    rows = at.groupBy(*SHEET).agg(F.array_sort(F.collect_list(F.struct("row", whole.alias("whole"), "money", *roles))).alias("rows"))
    h = rows.withColumn("h", F.get(F.filter("rows", lambda r: r["whole"]), F.lit(0))).where("h is not null")
    named = F.filter("rows", lambda r: (r["row"] <= c("h.row")) & r["money"].isNotNull())
    h = h.select(*SHEET, c("h.row").alias("header"), F.lit(True).alias("found"), F.coalesce(F.try_element_at(named, F.lit(-1))["money"], F.lit("EGP")).alias("currency"), *[c(f"h.{r}").alias(r) for r in roles])
    code = F.coalesce("code", "serial", F.lit(1))
    serial = F.coalesce("serial", F.when(c("code") > 1, 1))
    return h.select(*SHEET, "header", "found", "currency", code.alias("code"), serial.alias("serial"), *[F.coalesce(r, F.lit(DEFAULTS[r])).alias(r) for r in ("description", "quantity", "unit", "rate", "amount")], F.array().cast("array<int>").alias("hierarchy"))


def hierarchical_items(cells: DataFrame) -> DataFrame:
    """SC2, NR12: items of hierarchical sheets, whose descriptions run over rows.

    Text gathers until a row with a quantity or a unit closes an item: it needs both, or one of them and a code or serial
    number seen since the last item, or a unit and the words rate only.  A new code forgets the text before it; an item
    forgets code, serial number and text, but not the section.  Rows that sum up and rows of a tender's data are passed over.
    Non-bill sheets are skipped unless they are their workbook's only sheet (of those with cells).

    No machine runs over the rows.  A row with a quantity or unit ends what is known of codes and serial numbers whether it
    closes an item or not (it fails only if nothing is known), so blocks between such rows are told first; then which of
    them are items follows, and texts meet their item by the last item before and the last code so far.  All of it are
    running windows along a sheet, which the format limits to 1,048,576 rows, over narrow rows in one order.
    """
    c = F.col
    sheets = cells.select(*SHEET).distinct().groupBy("workbook").agg(F.count("*").alias("_sheets"))
    bills = cells.select(*SHEET).distinct().join(sheets, "workbook").where(~R.non_bill(c("sheet")) | (c("_sheets") == 1)).select(*SHEET)
    w = _wide(cells, tree_headers(cells).join(bills, SHEET))
    text = lambda x: F.trim(F.coalesce(c(x), F.lit("")))
    raw = {x: text(x).alias(f"raw_{x}") for x in ("unit", "quantity", "rate", "amount")}
    w = w.select(*SHEET, "row", "currency", text("serial").alias("serial"), text("code").alias("code"), text("description").alias("text"), R.canonical_unit(c("unit")).alias("unit"), *raw.values(), *[T.parse_decimal(c(x)).alias(x) for x in ("quantity", "rate", "amount")])
    up = F.upper("text")
    sums = _meets(up, "starts", SUM_STARTS) | _meets(up, "holds", SUM_PARTS) | _meets(up, "is", SUM_WHOLE)
    w = w.where(~(R.metadata_row(c("code"), c("text")) | sums))
    holds = lambda x, word: F.lower(x).contains(word)
    w = w.withColumns({"_rate_only": holds("raw_amount", "rate only") | holds("raw_unit", "rate only"), "_unit": (c("unit") != "") & ~c("unit").isin(NO_UNIT), "_section": (c("code") == "") & (c("quantity") == 0) & (c("unit") == "") & _meets(up, "starts", TREE_SECTIONS)})
    w = w.withColumns({
        "_serial": F.when((c("serial") != "") & ~F.upper("serial").isin(NO_SERIAL) & (F.length("serial") <= SERIAL_LENGTH), c("serial")),
        "_code": F.when(~c("_section") & (c("code") != "") & (F.length("code") <= CODE_LENGTH) & ~F.upper("code").isin(NO_CODE), c("code")),
        "_text": F.when(~c("_section") & (c("text") != "") & ~up.isin(NO_TEXT), c("text")), "_closes": c("_unit") | (c("quantity") > 0),
    })
    # what runs along a sheet goes by narrow rows in one order; the texts and figures come back row by row
    w = cut(w)
    down = Window.partitionBy(*SHEET).orderBy("row")
    so_far, before = down.rowsBetween(Window.unboundedPreceding, 0), down.rowsBetween(Window.unboundedPreceding, -1)
    last = lambda x, over: F.last(x, ignorenulls=True).over(over)
    at = lambda x: F.when(c(x).isNotNull(), F.struct("row", c(x).alias("v")))
    n = apart(w.select(*SHEET, "row", F.when(c("_section"), c("text")).alias("named"), "_section", "_closes", "_unit", (c("quantity") > 0).alias("_counted"), "_rate_only", "_code", "_serial"), *SHEET)
    # a block is named by the row that closed the one before
    n = n.withColumns({"section": F.coalesce(last("named", so_far), F.lit("")), "_block": F.coalesce(last(F.when(c("_closes"), c("row")), before), F.lit(0)), "_c": last(at("_code"), so_far), "_s": last(at("_serial"), so_far)})
    inside = lambda x: F.when(c(f"{x}.row") > c("_block"), c(f"{x}.v"))
    n = n.withColumns({"_last_code": inside("_c"), "_last_serial": inside("_s")})
    # without a code the serial number known at the first row that is no section stands for it
    known = ~c("_section") & c("_last_serial").isNotNull()
    n = n.withColumn("_known", F.when(known, c("row")))
    n = n.withColumn("_first", F.when(known & (F.coalesce(last("_known", before), F.lit(0)) <= c("_block")), F.struct("row", c("_last_serial").alias("v"))))
    n = n.withColumn("_f", last("_first", so_far))
    n = n.withColumn("item_code", F.coalesce("_last_code", inside("_f")))
    n = n.withColumn("_item", c("_closes") & ((c("_unit") & c("_counted")) | (c("_unit") & c("_rate_only")) | c("item_code").isNotNull()))
    # a piece is named by the last item before and the last code so far
    n = n.withColumns({"_after": F.coalesce(last(F.when(c("_item"), c("row")), before), F.lit(0)), "_from": F.coalesce("_c.row", F.lit(0))})
    w = w.join(n.select(*SHEET, "row", "section", "_last_serial", "item_code", "_item", "_after", "_from"), [*SHEET, "row"])
    item = F.struct("row", "section", "item_code", F.coalesce("_last_serial", "item_code").alias("serial"), c("text").alias("line"), "unit", "quantity", "rate", "amount", "raw_quantity", "raw_rate", "raw_amount", "_rate_only", "currency")
    g = apart(w, *SHEET, "_after", "_from").groupBy(*SHEET, "_after", "_from").agg(
        F.array_sort(F.collect_list(F.when(c("_text").isNotNull(), F.struct("row", "_text")))).alias("texts"),
        F.min(F.when(c("_code").isNotNull() | c("_text").isNotNull(), c("row"))).alias("start"), F.max(F.when(c("_item"), item)).alias("i"),
    ).where("i is not null").select(*SHEET, "texts", "start", "i.*")
    whole = F.array_join(F.transform("texts", lambda x: x["_text"]), " ")
    g = g.withColumns({"description": F.when(whole == "", c("line")).otherwise(whole), "code": F.coalesce("item_code", F.lit("")), "ignored": holds("raw_rate", "ignored") | holds("raw_amount", "ignored") | holds("raw_quantity", "ignored")})
    number = lambda x: c(x).rlike(r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$")
    money = lambda x: x.cast("decimal(28,8)")
    nought = money(F.lit(0))
    rate = F.when(c("rate") > 0, c("rate")).when(number("raw_rate"), nought).when((c("amount") > 0) & (c("quantity") > 0), money(c("amount") / c("quantity"))).when(number("raw_amount") | c("ignored"), nought)
    any_of = lambda x, words: reduce(lambda a, b: a | b, [F.lower(x).contains(v) for v in words])
    kind = F.when(any_of("sheet", PS_NAMES) | any_of("description", PS_TEXTS), "ProvisionalSum").when(c("_rate_only") | ((c("quantity") == 0) & ~c("ignored")), "RateOnly").otherwise("Normal")
    g = g.withColumns({"_read": rate, "item_type": kind})
    total = F.when(c("_read").isNotNull(), money(c("_read") * c("quantity"))).when(c("amount") > 0, c("amount")).when(c("raw_amount") != "", nought)
    return g.select(
        F.concat_ws("_", F.lit("B"), "sheet", "row", "code").alias("id"), *SHEET, "row", F.coalesce("start", "row").alias("start_row"), c("sheet").alias("bill"), "section", F.concat_ws(" / ", F.regexp_replace("workbook", r"\.[^.]*$", ""), "sheet").alias("path"),
        "code", F.coalesce("serial", "code").alias("serial"), "line", "description", T.normalise_description(c("description")).alias("normalised"), "unit", "quantity", c("_read").alias("rate"), total.alias("amount"), "currency", "item_type",
    )


#: Words above a header that tell a tender; column names and beginnings of sheet names of the pre-flight check.
TENDER_WORDS = ["employer", "tender no", "tender title", "project", "engineer", "consultant", "owner", "client", "المالك", "الاستشاري", "المناقصة"]
REQUIRED = ["Bill", "Section", "Description", "Unit", "Qty", "Rate", "Total"]
PS_SHEETS = ["provisional sum", "مبلغ احتياطي", "مبالغ احتياطية"]


def profile(cells: DataFrame) -> DataFrame:
    """SC4, AG12: per sheet of each workbook rows, priced rows, rows below the header, headings, and tender words above it."""
    h = resolve_headers(cells)
    w = _wide(cells, h).groupBy(*SHEET).agg(F.count_if(T.parse_positive(F.col("rate")).isNotNull()).alias("priced"))
    low, top = F.lower("raw"), F.when(F.col("found"), F.col("header")).otherwise(0)
    j = cells.join(F.broadcast(h.select(*SHEET, "found", "header")), SHEET, "left")
    tender = (F.col("row") < top) & reduce(lambda a, b: a | b, [low.contains(x) for x in TENDER_WORDS])
    heading = F.when((F.col("row") == top) & (F.length("raw") <= 40), F.col("raw"))
    # row by row first, in figures of fixed width
    each = apart(j.select(*SHEET, "row", top.alias("top"), tender.alias("tender")), *SHEET, "row").groupBy(*SHEET, "row").agg(F.max("top").alias("top"), F.bool_or("tender").alias("tender"))
    rows = each.groupBy(*SHEET).agg(F.count("*").alias("rows"), F.greatest(F.lit(0), F.max("row") - F.coalesce(F.max("top"), F.lit(0))).cast("long").alias("estimated"), F.coalesce(F.bool_or("tender"), F.lit(False)).alias("metadata"))
    heads = j.select(*SHEET, heading.alias("heading")).where("heading is not null").groupBy(*SHEET).agg(F.array_sort(F.collect_set("heading")).alias("headers"))
    rows = rows.join(heads, SHEET, "left").withColumn("headers", F.coalesce("headers", F.array().cast("array<string>")))
    return rows.join(w, SHEET, "left").fillna(0, ["priced"]).select(*SHEET, "rows", "priced", "estimated", "headers", "metadata")


def preflight(cells: DataFrame) -> DataFrame:
    """SC7, AG23: per workbook whether one of its first rows names four of the required columns, its rows of bills and status,
    and its sheets, bill sheets and sheets of provisional sums.

    A workbook without a row whose third cell begins with Bill fails.
    """
    top = cells.where("row <= 3").groupBy("workbook", "sheet", "row").agg(*[F.bool_or(F.lower("raw").contains(c.lower())).cast("int").alias(c) for c in REQUIRED])
    named = top.groupBy("workbook").agg((F.max(sum(F.coalesce(F.col(c), F.lit(0)) for c in REQUIRED)) >= 4).alias("header"))
    name = F.lower(F.trim("sheet"))
    bill = name.startswith("bill")
    ps = bill & reduce(lambda a, b: a | b, [name.contains(x) for x in PS_SHEETS])
    c = cells.groupBy("workbook").agg(
        F.count_if((F.col("row") > 2) & (F.col("col") == 3) & F.lower(F.trim("raw")).startswith("bill")).alias("bill_rows"),
        F.count_distinct("sheet").alias("sheets"), F.count_distinct(F.when(bill, F.col("sheet"))).alias("bill_sheets"), F.count_distinct(F.when(ps, F.col("sheet"))).alias("ps_sheets"),
    )
    return c.join(named, "workbook", "left").select("workbook", F.coalesce("header", F.lit(False)).alias("header"), "bill_rows", F.when(F.col("bill_rows") > 0, "Passed").otherwise("FailedCorrupted").alias("status"), "sheets", "bill_sheets", "ps_sheets")


#: Fixed value: sheets of bills that a target is expected to have at least.
BILL_SHEETS = 10


def preflight_verdict(runs: DataFrame, checks: DataFrame) -> DataFrame:
    """SC7, AG23: per run its status with the checks that passed, the warnings and the errors.

    runs: source, target (names of workbooks); checks: what ``preflight`` tells of them.  A workbook without cells and a
    source without rows of bills are errors, which fail the run; a heading that is not met, few bill sheets and no sheet
    of provisional sums are warnings.
    """
    c = F.col
    a = checks.select(c("workbook").alias("source"), "header", "bill_rows")
    b = checks.select(c("workbook").alias("target"), "sheets", "bill_sheets", "ps_sheets")
    j = runs.select("source", "target").join(a, "source", "left").join(b, "target", "left")
    said = lambda *told: F.filter(F.array(*[F.when(cond, text if isinstance(text, Column) else F.lit(text)) for cond, text in told]), lambda x: x.isNotNull())
    count = lambda k, words: F.concat(c(k).cast("string"), F.lit(f" {words}"))
    j = j.withColumns({
        "passed": said((c("header").isNotNull(), "source opened"), (c("header"), "source headings"), (c("bill_rows") > 0, count("bill_rows", "rows of bills")), (c("sheets").isNotNull(), "target opened"), (c("bill_sheets") >= BILL_SHEETS, count("bill_sheets", "bill sheets")), (c("ps_sheets") > 0, count("ps_sheets", "sheets of provisional sums"))),
        "warnings": said((~c("header"), "source headings not met"), (c("bill_sheets") < BILL_SHEETS, F.concat(F.lit("only "), count("bill_sheets", "bill sheets"))), (c("ps_sheets") == 0, "no sheet of provisional sums")),
        "errors": said((c("header").isNull(), "source not found"), (c("bill_rows") == 0, "source without rows of bills"), (c("sheets").isNull(), "target not found")),
    })
    return j.select("source", "target", F.when(F.size("errors") == 0, "Passed").otherwise("FailedCorrupted").alias("status"), "passed", "warnings", "errors", F.coalesce("bill_rows", F.lit(0)).alias("source_rows"), F.coalesce("sheets", F.lit(0)).alias("target_sheets"))


def output_audit(cells: DataFrame) -> DataFrame:
    """AG29: per sheet of each workbook rates, their value by quantity, formulas, broken cells and cells with Arabic digits."""
    rate, quantity = (T.parse_decimal(F.col(c)).cast("double") for c in ("rate", "quantity"))
    w = _wide(cells, resolve_headers(cells)).groupBy(*SHEET).agg(F.count_if(T.parse_positive(F.col("rate")).isNotNull()).alias("rates"), F.sum(rate * quantity).alias("value"))
    c = cells.groupBy(*SHEET).agg(F.count_if(F.col("formula").isNotNull()).alias("formulas"), F.count_if(F.col("raw").rlike("^#(REF|VALUE|N/A|DIV/0)")).alias("broken"), F.count_if(F.col("raw").rlike("[٠-٩۰-۹]")).alias("arabic_digits"))
    return c.join(w, SHEET, "left").fillna(0, ["rates", "value"]).select(*SHEET, "rates", "value", "formulas", "broken", "arabic_digits")


def distinct_paths(paths: DataFrame) -> DataFrame:
    """FL12: each path once, whatever its case (the first by order of characters); blank ones go.  paths: path."""
    return paths.where(F.trim("path") != "").groupBy(F.lower("path").alias("key")).agg(F.min("path").alias("path")).select("path")


def external_formulas(cells: DataFrame) -> DataFrame:
    """SC9: formulas that point into another workbook, which hold a name in brackets."""
    return cells.where(F.col("formula").rlike(r"\[.*\]")).select("workbook", "sheet", "row", "col", "formula")


def external_sheets(cells: DataFrame, matched: DataFrame) -> DataFrame:
    """SC10: sheet names of each workbook: those in its cells and those that matched items name; case does not count.

    matched: workbook, sheet of the matched source items.  A name in the file wins over its spelling elsewhere.
    """
    file = lambda c: F.element_at(F.split(F.col(c), r"[/\\]"), -1)
    names = cells.select(file("workbook").alias("workbook"), "sheet", F.lit(0).alias("o")).unionByName(matched.select(file("workbook").alias("workbook"), "sheet", F.lit(1).alias("o")))
    names = names.where(F.trim("sheet") != "").groupBy(F.lower("workbook").alias("w"), F.lower("sheet").alias("s"))
    return names.agg(F.min(F.struct("o", "sheet"))["sheet"].alias("sheet")).select(F.col("w").alias("workbook"), "sheet")
