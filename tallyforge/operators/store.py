"""Reports, paging, approvals, history and presets over Parquet tables."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .checkpoints import cut

#: Rows of a sheet that are counted together where the first rows of a report are looked for.
STRETCH = 1024
#: Fixed value: rows a worksheet can show below its headings.
SHEET_ROWS = 1_048_490


def grid_search(term: str, *columns: str) -> Column:
    """FL9: case-insensitive containment in any of the columns."""
    return reduce(lambda a, b: a | b, [F.contains(F.lower(c), F.lit(term.lower())) for c in columns])


def rate_cell_action() -> Column:
    """SK1: what the priced schedule writes into a rate cell."""
    c = F.col
    return (
        F.when(c("item_type") == "ProvisionalSum", "skip_protected").when(c("row") <= 0, "skip_no_anchor").when(c("approved") & c("injected_rate").isNotNull(), "inject")
        .when(c("has_formula"), "keep_formula").when(c("original_rate").isNotNull(), "keep_baseline").otherwise("clear")
    )


def status() -> Column:
    """NR37."""
    c = F.col
    return F.when(c("item_type") == "ProvisionalSum", "Shielded (PS)").when(c("is_vo"), "New Scope (VO)").when(c("approved") & (c("injected_rate") > 0), "Injected & Approved").otherwise("Unpriced / Note")


#: Rate columns where none is known, longest texts of the two reports, the row of their headings, a sheet's name.
TARGET_RATE, SOURCE_RATE, AUDIT_TEXT, LINK_TEXT, HEAD_ROW, NO_SHEET = 7, 18, 120, 100, 7, "Sheet1"
#: What the links of the reports say, and the mark of a copied source file.
SAYS_PRICED, SAYS_SHIELDED, SAYS_LOOK, SAYS_SOURCE, SAYS_OPEN = "المقايسة", "محمي", "معاينة", "عرض سعر المقاول", "فتح وتحديد سعر المقاول"
COPIED = "[Source_Priced]_"


def shortened(x: Column, n: int) -> Column:
    """A text of at most n characters, the last three of a longer one are dots."""
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n - 3), F.lit("..."))).otherwise(x)


def _linked(pairs: DataFrame, source_file: str) -> DataFrame:
    """Pairs with the texts that both reports share: the rate cells of either side and references to them.

    Columns used where present: rate_column, s_workbook, s_sheet, s_row, s_rate_column, s_code, rationale; without them a
    source has no place that can be linked.
    """
    absent = {"rate_column": "int", "s_workbook": "string", "s_sheet": "string", "s_row": "int", "s_rate_column": "int", "s_code": "string", "rationale": "string"}
    p = pairs.withColumns({k: F.lit(None).cast(t) for k, t in absent.items() if k not in pairs.columns})
    c = F.col
    filled = lambda x: F.nullif(F.trim(x), F.lit(""))
    file = lambda x: F.element_at(F.split(x, r"[/\\]"), -1)
    quoted = lambda x: F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("''")), F.lit("'"))
    place = lambda letter, row: F.concat(letter, row.cast("string"))
    column = lambda x, default: T.column_letter(F.when(c(x) > 0, c(x)).otherwise(default))
    target = filled(file(c("workbook")))
    target = F.when(F.lower(target).endswith("_reconciled.xlsx"), target).otherwise(F.concat(F.regexp_replace(target, r"\.[^.]*$", ""), F.lit("_Reconciled.xlsx")))
    source = F.coalesce(filled(file(c("s_workbook"))), F.lit(source_file))
    p = p.withColumns({
        "_sheet": F.coalesce(filled(c("sheet")), c("bill")), "_at": place(column("rate_column", TARGET_RATE), c("row")), "_has_source": c("s_id").isNotNull(), "_linked": c("s_id").isNotNull() & F.coalesce(c("s_row") > 0, F.lit(False)),
        "_file": F.when(F.lower(source).startswith(COPIED.lower()), F.substr(source, F.lit(len(COPIED) + 1))).otherwise(source), "_s_at": place(column("s_rate_column", SOURCE_RATE), c("s_row")),
    })
    return p.withColumns({
        "_ref": F.concat(F.coalesce(target, F.lit("")), F.lit("#"), quoted(c("_sheet")), F.lit("!"), c("_at")),
        "_s_ref": F.concat(c("_file"), F.lit("#"), quoted(F.coalesce(filled(c("s_sheet")), F.lit(NO_SHEET))), F.lit("!"), c("_s_at")),
    })


def _jump(ref: str, shown: Column) -> Column:
    """A cell that leads to a reference."""
    return F.concat(F.lit('=HYPERLINK("'), F.col(ref), F.lit('", "'), shown, F.lit('")'))


def _says(at: str, *words: Column) -> Column:
    return F.concat(F.lit("[ "), F.col(at), F.lit(" ] "), *words)


def first_lines(pairs: DataFrame, groups: dict[str, Column], n: int) -> DataFrame:
    """The first n pairs by (groups, bill, row, id, quantity) with their number, ``rank``; ranked per range partition.

    Groups, bills and stretches of rows are counted first, so that pairs behind the stretch in which the n-th stands are
    neither sorted nor written.
    """
    from .analytics import running

    c = F.col
    named = {**groups, "_bill": c("bill"), "_rows": F.floor(c("row") / STRETCH)}
    place = [x.alias(k) for k, x in named.items()]
    counts = cut(pairs.select(*place).groupBy(*named).agg(F.count("*").alias("_n")))
    whole = list(named)[:-1]
    before = lambda over: F.coalesce(F.sum("_n").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bills = counts.groupBy(*whole).agg(F.sum("_n").alias("_n")).withColumn("_before", before(Window.orderBy(*whole)))  # one row a bill
    last = bills.where((c("_before") < n) & (c("_before") + c("_n") >= n)).first()
    if last is not None:
        same = [c(k).eqNullSafe(F.lit(last[k])) for k in whole]
        stretches = counts.where(reduce(lambda a, b: a & b, same)).withColumn("_before", before(Window.orderBy("_rows")))
        end = stretches.where(c("_before") < n - last["_before"]).agg(F.max(F.struct("_rows"))["_rows"].alias("_rows")).first()
        types = dict(counts.dtypes)
        limit = F.struct(*[F.lit(v).cast(types[k]).alias(k) for k, v in {**{k: last[k] for k in whole}, "_rows": end["_rows"]}.items()])
        pairs = pairs.where(F.struct(*place) <= limit)
    key = F.struct(*[x.alias(k) for k, x in groups.items()], "bill", "row", "id", "quantity")
    out = running(pairs.withColumns({"_k": key, "_one": F.lit(1)}), "_one", "_k").where(c("rank") <= n)
    return out.drop("_k", "_one", "running", "total")


def audit_report(pairs: DataFrame, source_file: str = "Contractor_Priced_BOQ.xlsx") -> DataFrame:
    """SK2, SO1, LM3: the fifteen columns of the audit report with each line's number and row in its sheet.

    Approved prices first, then the rest behind one separating row, provisional sums last.  Links are formulas as text; an
    amount that follows from a price is the product of the cells of its row.  Texts are made for the lines that are shown only.
    """
    c = F.col
    priced = F.coalesce(c("approved") & (c("injected_rate") > 0), F.lit(False))
    first = first_lines(pairs, {"_a": F.when(priced, 0).otherwise(1), "_b": (c("item_type") == "ProvisionalSum").cast("int")}, SHEET_ROWS)
    p = _linked(first, source_file).withColumn("_priced", priced)
    dash = F.lit("-")
    said = F.when(c("_priced"), SAYS_PRICED).when(c("item_type") == "ProvisionalSum", SAYS_SHIELDED).otherwise(SAYS_LOOK)
    rate = c("injected_rate").cast("double")
    at = (c("rank") + HEAD_ROW + F.when(c("_priced"), 0).otherwise(1)).cast("long")
    cell = F.when(rate > 0, F.concat(F.lit("=J"), at.cast("string"), F.lit("*L"), at.cast("string"))).otherwise(dash)
    return p.select(
        c("rank").cast("long").alias("line"), at.alias("sheet_row"), "id", _jump("_ref", _says("_at", said)).alias("jump"), F.when(c("_linked"), _jump("_s_ref", _says("_s_at", F.lit(SAYS_SOURCE)))).otherwise(dash).alias("source_jump"), _jump("_ref", c("_sheet")).alias("sheet"), _jump("_ref", c("row").cast("string")).alias("row"),
        "code", shortened(c("description"), AUDIT_TEXT).alias("description"), F.when(c("_has_source"), F.coalesce("s_sheet", dash)).otherwise(dash).alias("source_sheet"), F.when(c("_linked"), c("s_row").cast("string")).otherwise(dash).alias("source_row"), "unit", c("quantity").cast("double").alias("quantity"), "currency",
        F.when(rate > 0, rate).alias("rate"), F.when(rate > 0, (c("injected_rate") * c("quantity")).cast("double")).alias("amount"), cell.alias("amount_cell"), "confidence", status().alias("status"),
    )


def linkage_map(pairs: DataFrame, rows: int = SHEET_ROWS, source_file: str = "Contractor_Priced_BOQ.xlsx") -> DataFrame:
    """SK3, SO2: the sixteen columns of the first ``rows`` links, matched and exact ones first."""
    c = F.col
    first = lambda cond: F.when(cond, 0).otherwise(1)
    lines = first_lines(pairs, {"_a": first(c("s_id").isNotNull()), "_b": first(c("confidence") == "Exact")}, rows)
    dash = F.lit("-")
    known, linked = (c("row") > 0), lambda x: F.when(c("_linked"), x).otherwise(dash)
    of_source = lambda x: F.when(c("_has_source"), F.coalesce(x, dash)).otherwise(dash)
    why = F.nullif(F.trim("rationale"), F.lit(""))
    return _linked(lines, source_file).select(
        c("rank").cast("long").alias("line"), "id", F.when(known, _jump("_ref", _says("_at", F.lit(SAYS_PRICED)))).otherwise(dash).alias("jump"), linked(_jump("_s_ref", _says("_s_at", F.lit(SAYS_OPEN)))).alias("source_jump"), F.when(known, _jump("_ref", c("_sheet"))).otherwise(c("_sheet")).alias("sheet"), F.when(known, _jump("_ref", c("row").cast("string"))).otherwise(dash).alias("row"),
        "code", shortened(c("description"), LINK_TEXT).alias("description"), "unit", c("quantity").cast("double").alias("quantity"), linked(c("_file")).alias("source_file"), of_source(c("s_sheet")).alias("source_sheet"), linked(c("s_row").cast("string")).alias("source_row"), linked(_jump("_s_ref", c("_s_at"))).alias("source_cell"),
        of_source(c("s_code")).alias("source_code"), of_source(shortened(c("s_description"), LINK_TEXT)).alias("source_text"), F.when(c("injected_rate") > 0, c("injected_rate").cast("double")).alias("rate"), F.when(why.isNotNull(), F.concat("confidence", F.lit(" ("), "rationale", F.lit(")"))).otherwise(c("confidence")).alias("match"),
    )


def pair_display(pairs: DataFrame) -> DataFrame:
    """NR35: pairs with the texts that a grid shows: rate, confidence with its similarity, source table and source code."""
    c = F.col
    ps, new = c("item_type") == "ProvisionalSum", "بند مستحدث (VO)"
    percent = F.concat(F.round(c("similarity") * 100).cast("int").cast("string"), F.lit("%)"))
    confidence = F.when(ps, "مبلغ احتياطي محمي").when(c("confidence") == "Exact", "تطابق تام (100%)").when(c("confidence") == "HighFuzzy", F.concat(F.lit("تطابق ذكي ("), percent)).when(c("confidence") == "ManualReviewNeeded", "مراجعة فنية")
    return pairs.withColumns({
        "rate_text": F.when(c("injected_rate").isNotNull(), F.format_number(F.round("injected_rate", 2), 2)).when(ps, "محمي (PS)").otherwise(new), "confidence_text": confidence.when(c("is_vo"), new).otherwise("غير مطابق"),
        "source_table": F.when(ps, "محمي تلقائياً (PS)").when(c("s_id").isNotNull(), F.coalesce(F.nullif(F.trim("s_bill"), F.lit("")), "s_sheet")).when(c("is_vo"), new).otherwise("-"), "source_code": F.coalesce("s_code", F.lit("-")),
    })


def diagnostics(sources: DataFrame, pairs: DataFrame) -> DataFrame:
    """SK9: the figures of the diagnostic report as rows (section, name, items, percent, base, remeasured, variance).

    Sections: metrics (counts, and of the four grades of confidence their share of all pairs), status (WARNING if a pair
    needs review, with their number) and currency (values of either side, never added over currencies).  Without pairs the
    shares are 0.  Timings and file data are the caller's.
    """
    from .analytics import currency_summary

    c = F.col
    grades = {"exact": "Exact", "high": "HighFuzzy", "review": "ManualReviewNeeded", "unmatched": "Unmatched"}
    counts = pairs.agg(F.count("*").alias("total"), F.count_distinct("sheet").alias("sheets"), *[F.count_if(c("confidence") == v).alias(k) for k, v in grades.items()], F.count_if(c("item_type") == "ProvisionalSum").alias("shielded"), F.count_if("is_vo").alias("variation"), F.count_if("approved").alias("approved"))
    none = F.lit(None).cast("double")
    share = lambda k: F.round(F.when(c("total") > 0, c(k) * 100.0 / c("total")).otherwise(0.0), 6) if k in grades else none
    row = lambda section, name, items, percent: F.struct(F.lit(section).alias("section"), name.alias("name"), items.alias("items"), percent.cast("double").alias("percent"))
    rows = [row("metrics", F.lit(k), c(k), share(k)) for k in counts.columns] + [row("status", F.when(c("review") > 0, "WARNING").otherwise("SUCCESS"), c("review"), none)]
    figures = counts.select(F.inline(F.array(*rows))).unionByName(sources.agg(F.count("*").alias("items")).select(F.lit("metrics").alias("section"), F.lit("sources").alias("name"), "items", none.alias("percent")))
    money = currency_summary(sources, pairs).select(F.lit("currency").alias("section"), c("currency").alias("name"), "items", F.when(c("base") > 0, c("variance_pct")).otherwise(0.0).alias("percent"), "base", "remeasured", "variance")
    return figures.unionByName(money, allowMissingColumns=True)


def page(df: DataFrame, order: list, number: int, size: int = 100) -> DataFrame:
    """LM4: page ``number`` (from 1) of an ordered view."""
    return df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def overridden(df: DataFrame, overrides: DataFrame, key: str, column: str) -> DataFrame:
    """MU3: values set by hand win."""
    return df.join(overrides.withColumnRenamed("value", "_v"), key, "left").withColumn(column, F.coalesce("_v", column)).drop("_v")


def baseline_fallback(pairs: DataFrame) -> DataFrame:
    """MU4, MU5: an unmatched target keeps its own rate as exact; without one it becomes a variation order."""
    free = F.col("s_id").isNull()
    none = free & F.col("original_rate").isNull()
    out = pairs.withColumn("rate", F.coalesce("injected_rate", "original_rate"))
    return out.withColumns({"confidence": F.when(none, "VariationOrder").when(free, "Exact").otherwise(F.col("confidence")), "item_type": F.when(none, "VariationOrder").otherwise(F.col("item_type"))})


def preset_column(saved: Column, current: Column) -> Column:
    """MU7: only saved ordinals from 0 override."""
    return F.when(saved >= 0, saved).otherwise(current)


def manual_link(text: Column, ps: Column) -> Column:
    """MU8."""
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return F.when(ps, "ShieldedPS").when(t.rlike("skip|exclude"), "Excluded").when((t == "") | t.contains("global"), "GlobalSearch").otherwise("ManualMatched")


def history(snapshots: DataFrame, items: DataFrame) -> DataFrame:
    """JN14: items with the header of their revision."""
    return items.join(snapshots, "rev")


def recent(h: DataFrame, n: int = 200) -> DataFrame:
    """DB8, SO5: every rate that is known, zero ones too."""
    return h.where("rate is not null").orderBy(F.desc("rev"), "id").limit(n)


def latest_per_item(h: DataFrame, keys: list[str], n: int = 10) -> DataFrame:
    """DB7, LM1: the latest n rates of each item."""
    return h.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("rev"), "id"))).where(F.col("_n") <= n).drop("_n")


def search(h: DataFrame, term: str, columns: list[str], n: int = 200) -> DataFrame:
    """DB9: known rates whose texts hold the term, which may have % and _ as wildcards."""
    return h.where("rate is not null").where(reduce(lambda a, b: a | b, [F.col(c).ilike(f"%{term}%") for c in columns])).orderBy(F.desc("rev"), "id").limit(n)


def word_score(term: str, within: list[str], words: str) -> Column:
    """.75 if a text of ``within`` holds a part of the term, else the best 1 - d / longer of the words within two edits."""
    texts = F.concat_ws("\n", *[F.lower(c) for c in within])
    split = F.filter(F.split(F.lower(F.coalesce(F.col(words), F.lit(""))), " "), lambda w: w != "")

    def one(tok: str) -> Column:
        def near(w: Column) -> Column:
            d = F.levenshtein(w, F.lit(tok))
            return F.when((F.abs(F.length(w) - len(tok)) <= 2) & (d <= 2), 1 - d / F.greatest(F.length(w), F.lit(len(tok)))).otherwise(0.0)

        return F.when(texts.contains(tok), 0.75).otherwise(F.coalesce(F.array_max(F.transform(split, near)), F.lit(0.0)))

    toks = [t for t in re.split(r"[ \-_/]+", term.lower()) if t]
    return F.greatest(F.lit(0.0), F.lit(0.0), *map(one, toks))


def fuzzy_search(h: DataFrame, term: str, columns: list[str], n: int = 200, pool: int = 2000, few: int = 10) -> DataFrame:
    """DB9, DB10, JN15: what ``search`` finds; if that is less than ``few``, also the best of the latest ``pool`` rates.

    The others need a score of .60 and must not repeat a revision, code and description already found.  Columns: those
    of h and ``score`` (1 for direct hits).
    """
    direct = search(h, term, columns, n).withColumn("score", F.lit(1.0))
    found = direct.count()  # at most n rows
    if found >= few or len(term.strip()) < 3:
        return direct
    latest = h.where("rate is not null").orderBy(F.desc("rev"), "id").limit(pool)
    key = ["rev", "code", "description"]
    seen = direct.select(*[F.col(c).alias(f"_{c}") for c in key]).distinct()
    rest = latest.join(F.broadcast(seen), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key], "left_anti")
    rest = rest.withColumn("score", word_score(term, ["description", "normalised", "invoice", "source"], "description")).where("score >= 0.6")
    return direct.unionByName(rest.orderBy(F.desc("score"), F.desc("rev"), "id").limit(n - found))


def priced_sources(rows: DataFrame) -> DataFrame:
    """FL5, FL6: rows with the rate to use: a positive own or original rate, or zero if the text says the scope is ignored.

    rows: rate, original, description.
    """
    rate = F.when(F.col("rate") > 0, F.col("rate")).when(F.col("original") > 0, F.col("original"))
    ignored = F.lower(F.coalesce("description", F.lit(""))).contains("ignored")
    return rows.withColumn("rate", F.coalesce(rate, F.when(ignored, F.lit(0)))).where("rate is not null")


def category() -> Column:
    """FL8: grid category of a pair; priced means a positive rate on an item that is not protected."""
    c = F.col
    return F.when(c("item_type") == "ProvisionalSum", "PS").when(c("is_vo"), "VO").when(c("confidence") == "ManualReviewNeeded", "Review").when(c("injected_rate") > 0, "Priced").otherwise("Other")


def guarded(pairs: DataFrame) -> DataFrame:
    """FL7: protected items keep no foreign rate, whatever was matched."""
    own = F.col("item_type") == "ProvisionalSum"
    return pairs.withColumns({"injected_rate": F.when(~own, F.col("injected_rate")), "s_id": F.when(~own, F.col("s_id"))})


def without(old: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """DB11: the rows that a delete of ``names`` leaves."""
    return old.join(names.select(key), key, "left_anti")


def upserted(rows: DataFrame, key: str, version: str) -> DataFrame:
    """DB5: the last row of each key; a partial aggregate, so a hot key costs one row per task."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), version).alias("_r")).select(key, "_r.*")


def merged(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """DB11: new rows replace old ones of their key."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"))


def anchor_rows(rows: DataFrame, block: list[str], has_qty: Column, has_formula: Column) -> DataFrame:
    """NR31: per block the row with quantity and formula, else quantity, else formula, else the last."""
    level = F.when(has_qty & has_formula, 0).when(has_qty, 1).when(has_formula, 2).otherwise(3)
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*block).orderBy(level, F.desc("row"), "id"))).where("_n = 1").drop("_n")


def append_snapshot(items: DataFrame, path: str, project: str, revision: int) -> None:
    """SK10: append a revision, partitioned by project; the content hash is of the items' content."""
    out = items.withColumns({"project": F.lit(project), "rev": F.lit(revision), "content_hash": F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in sorted(items.columns)]), 256)})
    out.write.mode("append").partitionBy("project").parquet(path)
