"""Operators on fixtures, and a plain-Python check of the assignment."""

import datetime
import io
import random
import zipfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import analytics as A
from tallyforge.operators import matching as M
from tallyforge.operators import packages as P
from tallyforge.operators import reconcile as C
from tallyforge.operators import store as S
from tallyforge.sources import sheets as X

PAIRS = "id string, bill string, description string, quantity decimal(18,4), unit string, original_rate decimal(18,4), injected_rate decimal(18,4), confidence string, approved boolean, currency string, item_type string, is_vo boolean, sheet string"


@pytest.fixture(scope="module")
def tender(spark):
    """Amounts 600, 250, 60, 50, 40 of 1,000 in all, and a protected item that does not count."""
    rows = [("a", "B1", "Concrete wall", 6, "m3", 90, 100), ("b", "B2", "Chiller pump", 5, "nr", 60, 50), ("c", "B1", "Cable tray", 20, "m", 3, 3), ("d", "B3", "Door", 5, "nr", 8, 10), ("e", "B4", "Tile", 8, "m2", 5, 5)]
    out = [(i, x, t, Decimal(n), u, Decimal(o), Decimal(r), "Exact", True, "EGP", "Normal", False, x) for i, x, t, n, u, o, r in rows]
    return spark.createDataFrame([*out, ("p", "B9", "Reserve", Decimal(1), "sum", Decimal(900), None, "Exact", True, "EGP", "ProvisionalSum", False, "B9")], PAIRS)


def test_pareto(tender):
    got = {r.id: (r.rank, r.share, r["class"]) for r in A.pareto(tender).collect()}
    # shares .60 .85 .91 .96 1.00: the first is A, the one that crosses .80 still B, then up to .95
    assert got == {"a": (1, 0.6, "A"), "b": (2, 0.85, "B"), "c": (3, 0.91, "B"), "d": (4, 0.96, "C"), "e": (5, 1.0, "C")}


@pytest.mark.parametrize("amounts,classes", [([99, 1], "AB"), ([50, 46, 4], "ABC"), ([30, 30, 36, 4], "AABC"), ([1], "A"), ([20, 20, 20, 20, 20], "AAAAB")])
def test_pareto_against_plain(spark, tender, amounts, classes):
    one = tender.where("id = 'a'")
    rows = spark.createDataFrame([(k, Decimal(v)) for k, v in enumerate(amounts)], "k int, v decimal(18,4)")
    p = rows.crossJoin(one.drop("id", "quantity", "injected_rate")).selectExpr("cast(k as string) as id", "v as quantity", "cast(1 as decimal(18,4)) as injected_rate", "bill", "item_type")
    assert "".join(r["class"] for r in A.pareto(p).orderBy("rank").collect()) == classes


def test_variance_and_trades(tender):
    v = A.variance(tender).first()
    assert (v.escalation, v.savings, v.reconciled) == (60 + 10, 50, 1000)
    assert {"Civil & Structural", "MEP Services"} <= {r.trade for r in A.trade_breakdown(tender).collect()}
    s = A.scorecard(tender, F.lit(0)).first()
    assert s.score == 100 and s.risk == "Low"


def test_fx(spark):
    p = spark.createDataFrame([("USD", Decimal(2), Decimal(100000)), ("EGP", Decimal(1), Decimal(1))], "currency string, quantity decimal(18,4), injected_rate decimal(18,4)")
    r = A.fx_sensitivity(p).collect()
    assert len(r) == 1 and r[0].foreign_total == 200000 and r[0].impact_10 == pytest.approx(2 * r[0].impact_5)


def test_currencies_are_not_mixed(spark, tender):
    src = spark.createDataFrame([("usd", Decimal(10), Decimal(2)), ("", Decimal(1), Decimal(1))], "s_currency string, s_rate decimal(18,4), s_quantity decimal(18,4)")
    got = {r.currency: (r.base, r.remeasured, r["items"]) for r in A.currency_summary(src, tender).collect()}
    assert got == {"USD": (20.0, 0.0, 0), "EGP": (1.0, 1000.0, 6)}  # the protected item has no rate


def test_outliers(spark):
    rates = [2500, 2550, 2480, 2520, 2510, 25000]
    i = spark.createDataFrame([(str(k + 1), Decimal(r), Decimal(1), Decimal(r)) for k, r in enumerate(rates)], "id string, unit_rate decimal(18,4), quantity decimal(18,4), total_amount decimal(28,4)")
    assert [(r.id, r.shift) for r in A.rate_audit(i).collect()] == [("6", True)]
    assert A.rate_audit(i.limit(3)).count() == 0


def test_order_statistics(spark):
    """Quantiles by rank against sorted lists: hot values, a null group, groups over many partitions and of one row."""
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), 7.0 if rng.random() < 0.3 else rng.randrange(400) / 4) for _ in range(5000)] + [("one", 3.5), ("none", None)]
    got = A.order_statistics(spark.createDataFrame(rows, "g string, v double").repartition(6), "g", "v", {"low": 0.1, "mid": 0.5, "top": 1.0}, slices=9).collect()
    want = {}
    for g in ("a", "b", None, "one"):
        v = sorted(x for k, x in rows if k == g)
        cuts = [(len(v) - 1) * q for q in (0.1, 0.5, 1.0)]
        want[g] = tuple(v[int(h)] + (v[min(int(h) + 1, len(v) - 1)] - v[int(h)]) * (h % 1) for h in cuts)
    assert {r.g: (r.low, r.mid, r.top) for r in got} == {g: pytest.approx(w) for g, w in want.items()}


def augmented(spark, edges):
    got = M.assign_scoped(spark.createDataFrame([("x", *e) for e in edges], "scope string, t int, s int, weight double")).collect()
    return sorted(tuple(r)[1:] for r in got)


def test_assignment_example(spark):
    assert [(t, s) for t, s, _ in augmented(spark, [(0, 0, 0.90), (0, 1, 0.85), (1, 0, 0.95)])] == [(0, 1), (1, 0)]


def plain_greedy(edges):
    out, ts, ss = [], set(), set()
    for t, s, w in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        if t not in ts and s not in ss:
            ts.add(t)
            ss.add(s)
            out.append((t, s, w))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_greedy_rounds(spark, seed):
    rng = random.Random(seed)
    edges = list({(t, s): (t, s, rng.choice([0.6, 0.7, 0.8, 0.9])) for t in range(25) for s in rng.sample(range(25), 6)}.values())
    got = M.assign_greedy(spark.createDataFrame(edges, "t int, s int, weight double")).collect()
    assert sorted(map(tuple, got)) == plain_greedy(edges)


def test_running_is_global(spark):
    df = spark.createDataFrame([(i, Decimal(i % 17)) for i in range(500)], "id int, v decimal(18,4)")
    want, total = [], 0
    for n, (v, i) in enumerate(sorted(((-(i % 17), i) for i in range(500))), 1):
        total -= v
        want.append((i, n, total))
    assert sorted((r.id, r.rank, int(r.running)) for r in A.running(df, "v", "id", 7).collect()) == sorted(want)


def test_running_over_many_rows(spark):
    """More rows than a range partitioning samples, several input partitions, ties and another column."""
    n = 400_000
    df = spark.range(0, n, 1, 16).selectExpr("id", "cast(hash(id) % 1000 + 1000 as decimal(18,4)) as v", "cast(id as string) as more")
    got = A.running(df, "v", "id", 16).agg(F.count_distinct("rank").alias("d"), F.min("rank").alias("a"), F.max("rank").alias("b"), F.max("running").alias("r"), F.max("total").alias("t")).first()
    total = df.agg(F.sum("v")).first()[0]
    assert (got.d, got.a, got.b) == (n, 1, n) and got.r == got.t == total


def plain_augmented(edges):
    """Greedy, then over the edges again: a free target may displace a holder that has a free source left."""
    order, own, held = sorted(edges, key=lambda e: (-e[2], e[0], e[1])), {}, {}
    for e in order:
        if e[0] not in own and e[1] not in held:
            own[e[0]] = held[e[1]] = e
    for t, s, w in order:
        if t not in own:
            old = held[s]
            free = [e for e in order if e[0] == old[0] and e[1] not in held]
            if free and w + free[0][2] > old[2] + 0.05:
                own[old[0]] = held[free[0][1]] = free[0]
                own[t] = held[s] = (t, s, w)
    return sorted(own.values())


@pytest.mark.parametrize("seed", range(6))
def test_augmented(spark, seed):
    rng = random.Random(seed)
    edges = list({(t, s): (t, s, rng.choice([0.6, 0.7, 0.8, 0.9])) for t in range(30) for s in rng.sample(range(24), 4)}.values())
    assert augmented(spark, edges) == plain_augmented(edges)


def test_augmentation_goes_by_edges(spark):
    """One spare source, two free targets: the heavier edge is served first, whatever its target."""
    edges = [(0, 0, 0.90), (0, 2, 0.80), (1, 1, 0.95), (1, 2, 0.85), (2, 0, 0.70), (3, 1, 0.75)]
    assert augmented(spark, edges) == [(0, 0, 0.90), (1, 2, 0.85), (3, 1, 0.75)]


CELL_ROWS = "workbook string, sheet string, row int, col int, raw string, formula string"


def grid(spark, rows, sheet="s"):
    return spark.createDataFrame([("w", sheet, r, c, v, None) for r, row in rows.items() for c, v in enumerate(row, 1) if v], CELL_ROWS)


def test_two_line_headings(spark):
    rows = {3: ["Item", "Description", "Unit", "Quantity"], 4: ["", "", "", "", "Unit Rate", "Total Amount (USD)"], 5: ["1.1", "Blinding", "m3", "4", "10", "40"]}
    h = X.resolve_headers(grid(spark, rows)).first()
    assert (h.header, h.code, h.description, h.unit, h.quantity, h.rate, h.amount, h.currency, h.found) == (3, 1, 2, 3, 4, 5, 6, "USD", True)


def test_sheet_without_headings(spark):
    text = "A long description of works that runs on and on, with more than sixty letters in all"
    rows = {k: [f"1.{k}", "", text, "m2", "7", "", "12.5"] for k in range(1, 5)}
    h = X.resolve_headers(grid(spark, rows)).first()
    assert (h.found, h.description, h.unit, h.quantity, h.rate) == (False, 3, 4, 5, 7)
    got = X.flat_items(grid(spark, rows)).collect()
    assert len(got) == 4 and all((float(r.quantity), float(r.rate), r.unit) == (7, 12.5, "m2") for r in got)


def test_workbooks_stay_apart(spark):
    rows = {1: ["Item", "Description", "Unit", "Qty", "Rate", "Amount"], 2: ["1", "x", "m", "2", "3", "6"]}
    cells = grid(spark, rows).unionByName(grid(spark, {**rows, 3: ["2", "y", "m", "٤", "5", "#REF!"]}).withColumn("workbook", F.lit("v")))
    assert {(r.workbook, r.rows, r.priced) for r in X.profile(cells).collect()} == {("w", 2, 1), ("v", 3, 2)}
    assert {(r.workbook, r.rates, r.value, r.broken, r.arabic_digits) for r in X.output_audit(cells).collect()} == {("w", 1, 6.0, 0, 0), ("v", 2, 26.0, 1, 1)}
    assert {(r.workbook, r.header, r.status) for r in X.preflight(cells).collect()} == {("w", True, "FailedCorrupted"), ("v", True, "FailedCorrupted")}


def test_reconcile(spark):
    kinds = "code string, description string, unit string, quantity decimal(18,4), rate decimal(18,4), currency string"
    t = [(1, "A1", "Hollow block wall 20 cm", "m2", 40, None, "EGP", "Normal"), (2, "A2", "Copper cable 16 mm in conduit", "m", 100, 50, "EGP", "Normal"), (3, "A3", "Reserve", "sum", 1, 900, "EGP", "ProvisionalSum"), (4, "Z9", "Marble statue of a horse", "nr", 1, None, "EGP", "Normal"), (5, "Z8", "Fountain jets", "nr", 3, 70, "EGP", "Normal")]
    s = [(1, "A1", "Hollow block wall 20 cm", "m2", 40, 95, None, "EGP"), (2, "A2", "Copper cables 16mm in conduits", "lm", 100, 51, None, "EGP"), (3, "A7", "Ignored scope", "sum", 1, None, None, "EGP"), (4, "Q1", "Steel door", "nr", 9, None, None, "EGP")]
    d = lambda v: None if v is None else Decimal(v)
    targets = spark.createDataFrame([(k, c, x, u, d(q), d(r), cur, kind) for k, c, x, u, q, r, cur, kind in t], f"t int, {kinds}, item_type string")
    sources = spark.createDataFrame([(k, c, x, u, d(q), d(r), d(o), cur) for k, c, x, u, q, r, o, cur in s], f"s int, {kinds.replace('rate decimal(18,4)', 'rate decimal(18,4), original decimal(18,4)')}")
    for scoped in (False, True):
        both = [x.withColumn("scope", F.lit("b")) if scoped else x for x in (targets, sources)]
        got = {r.t: (r.s, r.rate, r.confidence, r.item_type) for r in C.reconcile(*both, scoped=scoped).collect()}
        assert got[1] == (1, 95.0, "Exact", "Normal") and got[3] == (None, 900.0, "Exact", "ProvisionalSum")
        assert got[2][:2] == (2, 51.0)
        assert got[4] == (None, None, "VariationOrder", "VariationOrder") and got[5] == (None, 70.0, "Exact", "Normal")


def test_sheet_links(spark):
    t = spark.createDataFrame([("Bill 03B - North Halls", False), ("Bill 07.2K - Pump House PS", True), ("Unknown works", False), ("Bill 09 - PS", True)], "t_sheet string, t_ps boolean")
    s = spark.createDataFrame([("03B North Halls",), ("7.2K-Pumping Station PS",)], "s_sheet string")
    got = {r.t_sheet: (r.s_sheet, r.status) for r in M.link_sheets(t, s).collect()}
    assert got["Bill 03B - North Halls"] == ("03B North Halls", "AutoMatched")
    assert got["Bill 07.2K - Pump House PS"] == ("7.2K-Pumping Station PS", "AutoMatched")
    assert got["Unknown works"][1] == "GlobalSearch" and got["Bill 09 - PS"][1] == "ShieldedPS"


def test_paging(spark):
    df = spark.range(1, 251)
    assert [[S.page(df, ["id"], n).first().id, S.page(df, ["id"], n).count()] for n in (1, 2, 3)] == [[1, 100], [101, 100], [201, 50]]


def test_upsert_and_merge(spark):
    e = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "key int, value string, version int")
    assert sorted((r.key, r.value) for r in S.upserted(e, "key", "version").collect()) == [(1, "b"), (2, "c")]
    old, new = (spark.createDataFrame(x, "k int, v string") for x in ([(1, "o"), (2, "o")], [(2, "n"), (3, "n")]))
    assert sorted(map(tuple, S.merged(old, new, "k").collect())) == [(1, "o"), (2, "n"), (3, "n")]


def test_snapshot_round_trip(spark, tmp_path):
    S.append_snapshot(spark.createDataFrame([(1, "x")], "id int, d string"), str(tmp_path / "s"), "P1", 1)
    S.append_snapshot(spark.createDataFrame([(1, "x")], "id int, d string"), str(tmp_path / "s"), "P1", 2)
    r = spark.read.parquet(str(tmp_path / "s"))
    assert r.count() == 2 and r.select("content_hash").distinct().count() == 1


def workbook(sheets):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        rns = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
        z.writestr("xl/workbook.xml", f"<workbook {ns} {rns}><sheets>" + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        for i, rows in enumerate(sheets.values(), 1):
            cells = "".join(f'<row r="{r}">' + "".join(f'<c r="{chr(64 + c)}{r}" t="inlineStr"><is><t>{v}</t></is></c>' for c, v in enumerate(vs, 1) if v != "") + "</row>" for r, vs in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {ns}><sheetData>{cells}</sheetData></worksheet>")
    return out.getvalue()


def test_workbooks_end_to_end(spark, tmp_path):
    flat = {"Bill 01 - Civil": [["Quantity", "Unit Rate", "Item Code", "Unit", "Description", "Amount"], ["100", "18.50", "1.1", "m3", "Excavation", ""], ["50", "٢٤٫٠", "1.2", "م3", "Backfill", "1200"], ["10", "24.00", "1.3", "sqm", "Paving", ""]], "Grand Summary": [["Description", "Amount"], ["x", "1"]]}
    (tmp_path / "a.xlsx").write_bytes(workbook(flat))
    cells = X.read_workbooks(spark, str(tmp_path / "a.xlsx"))
    h = {r.sheet: r for r in X.resolve_headers(cells).collect()}["Bill 01 - Civil"]
    assert (h.quantity, h.rate, h.code, h.unit, h.description, h.amount) == (1, 2, 3, 4, 5, 6)
    got = {r.code: (float(r.rate), r.unit, float(r.amount)) for r in X.flat_items(cells).collect()}
    assert got == {"1.1": (18.5, "m3", 1850.0), "1.2": (0.0, "m3", 1200.0), "1.3": (24.0, "m2", 240.0)}


def test_header_prefers_composite_rate(spark):
    heads = ["Item", "Description", "Unit", "Qty", "Supply Rate", "Install Rate", "Total Unit Rate", "Total Amount"]
    cells = spark.createDataFrame([("w", "s", 1, c, h, None) for c, h in enumerate(heads, 1)], X.CELLS)
    h = X.resolve_headers(cells).first()
    assert (h.code, h.description, h.unit, h.quantity, h.rate, h.amount) == (1, 2, 3, 4, 7, 8)


def walked(rows):
    """Row machine of one sheet, row by row: (row, start, section, code, serial, description)."""
    section = code = serial = ""
    text, start, out = [], 0, []
    for r, sn, cd, tx, unit, q, note in rows:
        if tx.startswith("Grand total"):
            continue
        serial = sn if sn and len(sn) <= 10 else serial
        if not cd and not unit and not q and tx.lower().startswith("section"):
            section = tx
            continue
        if cd and len(cd) <= 12:
            code, text, start = cd, [], r
        elif not code:
            code = serial
        if tx:
            text.append(tx)
            start = start or r
        if (q and unit) or (unit and (code or note)) or (q and code):
            out.append((r, start or r, section, code, serial or code, " ".join(text) or tx))
            code, serial, text, start = "", "", [], 0
    return out


def test_row_machine(spark):
    rng, sheets = random.Random(5), {}
    for s in range(12):
        sheets[f"S{s}"] = [(r, rng.choice(["", "", "", f"n{r}", "a serial too long"]), rng.choice(["", "", f"c{r}", "a code that is too long"]), rng.choice(["", "Section A", "Grand total", f"text {r}", f"text {r}"]), rng.choice(["", "", "m3"]), rng.choice([0, 0, 5]), rng.choice(["", "", "Rate only"])) for r in range(4, 4 + 12 * s)]
    heads = ["S/N", "Item", "Description", "Unit", "Qty", "Rate", "Amount"]
    cells = [("b.xlsx", s, 2, c, h) for s in sheets for c, h in enumerate(heads, 1)]
    for s, rows in sheets.items():
        for r, sn, cd, tx, unit, q, note in rows:
            cells += [("b.xlsx", s, r, c, v) for c, v in ((1, sn), (2, cd), (3, tx), (4, unit), (5, str(q) if q else ""), (7, note)) if v]
    df = spark.createDataFrame(cells, "workbook string, sheet string, row int, col int, raw string").withColumn("formula", F.lit(None).cast("string"))
    got = {}
    for x in X.hierarchical_items(df).collect():
        got.setdefault(x["sheet"], []).append((x["row"], x["start_row"], x["section"], x["code"], x["serial"], x["description"]))
    for s, rows in sheets.items():
        assert sorted(got.get(s, [])) == walked(rows)
    assert sum(map(len, got.values())) > 100


def test_tree_rates_and_headers(spark):
    rows = [("1.1", "Concrete", "m3", "5", "10", ""), ("1.2", "Provisional sum", "sum", "1", "", "500"), ("1.3", "Pipe", "m", "", "0", "Rate only"), ("1.4", "Pump", "no", "2", "Ignored", ""), ("1.5", "Cable", "m", "4", "", "10"), ("1.6", "Lamp", "no", "3", "", ""), ("1.7", "Duct", "m", "3", "-4", "")]
    cells = [("b.xlsx", "Cover", 3, c, h) for c, h in enumerate(["Item", "Description", "Unit", "Qty", "Rate ($)", "Amount (EUR)"], 1)]
    cells += [("b.xlsx", "Cover", 4 + r, c, v) for r, row in enumerate(rows) for c, v in enumerate(row, 1) if v]
    schema = "workbook string, sheet string, row int, col int, raw string"
    df = spark.createDataFrame(cells, schema).withColumn("formula", F.lit(None).cast("string"))
    # a sheet that is no bill is read where it is the only one
    got = {x["code"]: (None if x["rate"] is None else float(x["rate"]), None if x["amount"] is None else float(x["amount"]), x["item_type"], x["currency"]) for x in X.hierarchical_items(df).collect()}
    assert got == {"1.1": (10, 50, "Normal", "EUR"), "1.2": (500, 500, "ProvisionalSum", "EUR"), "1.3": (0, 0, "RateOnly", "EUR"), "1.4": (0, 0, "Normal", "EUR"), "1.5": (2.5, 10, "Normal", "EUR"), "1.6": (None, None, "Normal", "EUR"), "1.7": (0, 0, "Normal", "EUR")}
    more = df.unionByName(spark.createDataFrame([("b.xlsx", "Bill 1", 70, 1, "Item"), ("b.xlsx", "Bill 1", 70, 2, "Description"), ("b.xlsx", "Bill 1", 70, 3, "Unit")], schema).withColumn("formula", F.lit(None).cast("string")))
    assert X.hierarchical_items(more).count() == 0


def test_history_search(spark):
    snap = spark.createDataFrame([(1, datetime.date(2024, 1, 1), "P"), (2, datetime.date(2024, 2, 1), "P")], "rev int, day date, invoice string").withColumn("source", F.lit("f.xlsx"))
    items = spark.createDataFrame([(1, "a", "oak beam", 5.0), (2, "b", "oka plank", 6.0), (2, "c", "brick", 0.0), (2, "d", "oak", None)], "rev int, id string, description string, rate double").withColumns({"code": F.col("id"), "normalised": F.col("description")})
    h = S.history(snap, items)
    assert [r.id for r in S.recent(h).collect()] == ["b", "c", "a"]
    assert [r.id for r in S.search(h, "oak", ["description"]).collect()] == ["a"]
    # the direct hit, then the word two edits away: 1 - 2 / 5
    assert [(r.id, round(r.score, 3)) for r in S.fuzzy_search(h, "plonc-zz", ["description"]).collect()] == [("b", 0.6)]
    assert [(r.id, r.score) for r in S.fuzzy_search(h, "oak_beam", ["description"]).collect()] == [("a", 1.0)]
    assert [r.id for r in S.fuzzy_search(h, "oak beams", ["description"]).collect()] == ["a"]


def test_reports(spark):
    p = spark.createDataFrame([("a", "in/Tower's.xlsx", "Bill 'A'", "B1", 12, 3, "[source_priced]_rates.xlsx", "S'1", 9, 28, "1", "c1", True, Decimal(2), "Exact", "Normal", False, "x" * 121, "y" * 101, "by code"), ("b", "T_RECONCILED.XLSX", " ", "B2", 5, None, None, None, None, None, None, "c2", False, None, "Unmatched", "ProvisionalSum", False, "x" * 120, None, None), ("c", "t.xlsx", "S", "B3", 0, 0, None, None, 0, 0, "2", "c3", False, Decimal(0), "ManualReviewNeeded", "Normal", True, "z", "w" * 100, " ")],
        "id string, workbook string, sheet string, bill string, row int, rate_column int, s_workbook string, s_sheet string, s_row int, s_rate_column int, s_id string, code string, approved boolean, injected_rate decimal(18,4), confidence string, item_type string, is_vo boolean, description string, s_description string, rationale string").withColumns({"quantity": F.lit(4).cast("decimal(18,4)"), "unit": F.lit("m"), "currency": F.lit("EGP"), "s_code": F.when(F.col("s_id").isNotNull(), "sc")})
    a = {r["id"]: r for r in S.audit_report(p).collect()}
    assert [(a[k]["line"], a[k]["sheet_row"]) for k in "acb"] == [(1, 8), (2, 10), (3, 11)]
    assert a["a"]["jump"] == "=HYPERLINK(\"Tower's_Reconciled.xlsx#'Bill ''A'''!C12\", \"[ C12 ] المقايسة\")"
    assert a["a"]["source_jump"] == "=HYPERLINK(\"rates.xlsx#'S''1'!AB9\", \"[ AB9 ] عرض سعر المقاول\")"
    assert a["b"]["sheet"] == "=HYPERLINK(\"T_RECONCILED.XLSX#'B2'!G5\", \"B2\")" and "محمي" in a["b"]["jump"] and "معاينة" in a["c"]["jump"]
    assert (a["a"]["amount_cell"], a["a"]["amount"], a["b"]["amount_cell"], a["c"]["rate"]) == ("=J8*L8", 8.0, "-", None)
    assert [a[k]["status"] for k in "abc"] == ["Injected & Approved", "Shielded (PS)", "New Scope (VO)"] and a["a"]["description"] == "x" * 117 + "..." and a["b"]["description"] == "x" * 120
    m = {r["id"]: r for r in S.linkage_map(p).collect()}
    assert [m[k]["line"] for k in "acb"] == [1, 2, 3]
    assert (m["a"]["source_file"], m["a"]["source_row"], m["a"]["match"], m["a"]["source_text"]) == ("rates.xlsx", "9", "Exact (by code)", "y" * 97 + "...")
    assert (m["c"]["jump"], m["c"]["sheet"], m["c"]["source_file"], m["c"]["source_sheet"], m["c"]["source_code"], m["c"]["match"]) == ("-", "S", "-", "-", "sc", "ManualReviewNeeded")
    # pairs without the sources' places
    assert {r["source_jump"] for r in S.audit_report(p.drop("s_workbook", "s_sheet", "s_row", "s_rate_column", "s_code", "rationale", "rate_column")).collect()} == {"-"}
    assert S.audit_report(p.limit(0)).count() == 0
    d = {(r["section"], r["name"]): r["items"] for r in S.diagnostics(p.selectExpr("currency as s_currency", "injected_rate as s_rate", "quantity as s_quantity"), p).collect()}
    assert (d["metrics", "total"], d["status", "WARNING"], d["metrics", "sources"], d["currency", "EGP"]) == (3, 1, 3, 3)
    t = {r["id"]: (r["rate_text"], r["source_table"]) for r in S.pair_display(p.withColumns({"similarity": F.lit(0.876), "s_bill": F.lit(" ")})).collect()}
    assert t == {"a": ("2.00", "S'1"), "b": ("محمي (PS)", "محمي تلقائياً (PS)"), "c": ("0.00", None)}


def test_bills_by_category(spark):
    p = spark.createDataFrame([("Bill 05 - Roads", 2), ("Bill 5.1a Villa", None), ("Bill 12", 1), ("Bill 2 - Infra Retail", 3), ("Works PS", 1), ("Audit 1", 9), (None, 1), ("A rather long name", 1)], "bill string, injected_rate int").withColumns({"quantity": F.lit(2).cast("decimal(18,4)"), "injected_rate": F.col("injected_rate").cast("decimal(18,4)")})
    b = {r["bill"]: (r["code"], r["description"], float(r["total"]), r["status"]) for r in P.structured_bills(p).collect()}
    assert b["Bill 05 - Roads"] == ("Bill 05", "Roads", 4, "Priced & Approved") and b["Bill 5.1a Villa"] == ("Bill 5.1a", "Villa", 0, "Tender Scope (Manual)") and b["Bill 12"][:2] == ("Bill 12", "Bill 12")
    assert b["Works PS"][3] == "Provisional Sum (Shielded)" and "Audit 1" not in b and b["A rather long name"][:2] == ("A rather lon", "A rather long name")
    t = {r["category"]: (r["name"], r["bills"], r["codes"], r["total"]) for r in P.trade_categories(P.structured_bills(p)).collect()}
    # a bill may be in two categories
    assert t["Civil Infrastructure Networks"] == ("Civil Infrastructure Networks", 2, "Bill 2, Bill 05", 10.0) and t["Commercial Retail Center"][1:3] == (1, "Bill 2")
    assert t["Residential Villas"][:2] == ("Residential Villas (1 Bills)", 1) and t[P.PROTECTED][2] == "1 Shielded Packages"
    assert t[P.OTHER_WORKS][0] == "General & Other Measured Works (2 Bills)" or t["Residential Townhouses"][1] > 0
    assert P.trade_categories(P.structured_bills(p.limit(0))).count() == 0


def test_partition_keys(spark):
    t = spark.createDataFrame([(1, "Bill 1", "BILL-1", "W / Zone A//w"), (2, None, " ", None), (3, "باب 2", None, "")], "id int, bill string, sheet string, path string")
    assert sorted((r["id"], r["key"]) for r in M.partition_keys(t, ["bill", "sheet"], "path").collect()) == [(1, "bill1"), (1, "w"), (1, "zonea"), (3, "باب2")]


def test_verdict(spark):
    runs = spark.createDataFrame([("S", "T"), ("S", "X"), ("X", "T")], "source string, target string")
    checks = spark.createDataFrame([("S", False, 3, 1, 0, 0), ("T", False, 0, 12, 10, 1)], "workbook string, header boolean, bill_rows long, sheets long, bill_sheets long, ps_sheets long")
    v = {(r["source"], r["target"]): (r["status"], r["warnings"], r["errors"]) for r in X.preflight_verdict(runs, checks).collect()}
    assert v == {("S", "T"): ("Passed", ["source headings not met"], []), ("S", "X"): ("FailedCorrupted", ["source headings not met"], ["target not found"]), ("X", "T"): ("FailedCorrupted", [], ["source not found"])}
