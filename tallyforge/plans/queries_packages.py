"""Queries of stored layouts, bundles, packages and the scans of linked workbooks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import matching as M
from ..operators import packages as P
from ..sources import sheets as X
from .adapters import over_base, pairs, source_items, table, target_items
from .registry import query


@query("sc8_db1_db2_db3_db4_layouts", """SELECT o_orderkey::BIGINT AS "RevisionId", o_orderpriority AS "ProjectCode", NULL::VARCHAR AS "RevisionCode", NULL::VARCHAR AS "SnapshotDate", o_totalprice::DOUBLE AS "TotalValueEgp", NULL::DOUBLE AS "TotalValueUsd", NULL::BIGINT AS "TotalItemsCount",
  NULL::VARCHAR AS "ContentHash", NULL::VARCHAR AS "InvoiceName", NULL::VARCHAR AS "SourceFileName", NULL::VARCHAR AS "TargetFileName", NULL::VARCHAR AS "ExportFilePath" FROM orders""")
def db1(spark, d):
    old = table(spark, d, "orders").selectExpr("o_orderkey as revisionid", "o_orderpriority as ProjectCode", "o_totalprice as TotalValueEgp")
    return P.migrated(old, "Snapshots")


@query("nr19_token_hash", "SELECT count(DISTINCT w) AS hashes, count(*) AS tokens FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS w FROM part)")
def nr19(spark, d):
    t = table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("w"))
    return t.agg(F.count_distinct(T.token_hash(F.col("w"))).alias("hashes"), F.count("*").alias("tokens"))


@query("nr36_display", """SELECT p_partkey AS k, CASE WHEN b >= 1048576 THEN printf('%.1f MB', b / 1048576.0) WHEN b >= 1024 THEN printf('%.0f KB', b / 1024.0) ELSE b || ' B' END AS size,
  CASE p_size % 4 WHEN 0 THEN 'ملف المقاول المسعر (Source)' WHEN 1 THEN CASE WHEN p_size % 2 = 0 THEN 'جدول الاستشاري المستهدف (Target)' ELSE 'جدول استشاري غير مسعر (Target)' END WHEN 2 THEN 'ملف أسعار إضافي / موردين (Rates)' ELSE 'ملف مرجعي' END AS badge
FROM (SELECT *, p_partkey::BIGINT * p_size * 97 AS b FROM part)""")
def nr36(spark, d):
    p = table(spark, d, "part").selectExpr("p_partkey as k", "p_size", "cast(p_partkey as bigint) * p_size * 97 as b", "element_at(array('ContractorPriced', 'ConsultantTarget', 'SupplementaryRates', 'Other'), cast(p_size % 4 + 1 as int)) as role")
    return p.select("k", T.file_size(F.col("b")).alias("size"), T.role_badge(F.col("role"), F.col("p_size") % 2 == 0).alias("badge"))


@query("fl12_distinct_paths", "SELECT min(path) AS path FROM (SELECT CASE WHEN p_partkey % 2 = 0 THEN upper(p_brand) ELSE lower(p_brand) END AS path FROM part) GROUP BY lower(path)")
def fl12(spark, d):
    return X.distinct_paths(table(spark, d, "part").selectExpr("case when p_partkey % 2 = 0 then upper(p_brand) else lower(p_brand) end as path"))


@query("sc9_external_formulas", "SELECT p_type AS sheet, (p_partkey + 2)::INT AS row, '[' || p_brand || '.xlsx]S!A' || p_size AS formula FROM part WHERE p_size % 7 = 0")
def sc9(spark, d):
    c = table(spark, d, "part").selectExpr("'parts' as workbook", "p_type as sheet", "cast(p_partkey + 2 as int) as row", "5 as col", "case when p_size % 7 = 0 then concat('[', p_brand, '.xlsx]S!A', p_size) else 'A1*B1' end as formula")
    return X.external_formulas(c).select("sheet", "row", "formula")


@query("sc10_external_sheets", over_base("SELECT lower(w) AS workbook, sheet FROM (SELECT 'W' || (s_id % 3) AS w, s_bill AS sheet FROM source_items UNION SELECT workbook, sheet FROM pairs WHERE s_id IS NOT NULL)"))
def sc10(spark, d):
    return X.external_sheets(source_items(spark, d).selectExpr("concat('W', s_id % 3) as workbook", "s_bill as sheet"), pairs(spark, d).where("s_id is not null").select("workbook", "sheet"))


@query("ag3_variance_columns", over_base("SELECT id, (injected_rate - original_rate)::DOUBLE AS diff, round(CASE WHEN original_rate <> 0 THEN (injected_rate - original_rate)::DOUBLE / original_rate::DOUBLE * 100 ELSE 0 END, 6) AS pct FROM pairs WHERE s_id IS NOT NULL"))
def ag3(spark, d):
    diff, pct = P.variance_columns(F.col("original_rate"), F.col("injected_rate"))
    return pairs(spark, d).where("s_id is not null").select("id", diff.cast("double").alias("diff"), F.round(pct, 6).alias("pct"))


@query("wn8_first_per_key", over_base("SELECT code, id FROM (SELECT code, id, row_number() OVER (PARTITION BY code ORDER BY id) AS n FROM target_items) WHERE n = 1"))
def wn8(spark, d):
    return M.first_per_key(target_items(spark, d), ["code"], ["id"]).select("code", "id")


def _audited(spark, d):
    return pairs(spark, d).where("injected_rate > 0").selectExpr("id", "injected_rate as unit_rate", "quantity", "injected_rate * quantity as total_amount")


def _counted(parts):
    return reduce(lambda a, b: a.unionByName(b), [df.agg(F.count("*").alias("lines")).select(F.lit(k).alias("part"), "lines") for k, df in parts.items()])


@query("ag22_bundle")
def ag22(spark, d):
    return _counted(P.analytics_bundle(pairs(spark, d), _audited(spark, d)))


AMT = "(injected_rate * quantity)"


@query("sk4_dashboard", over_base(f"SELECT 'bill' AS block, bill AS name, sum({AMT}) FILTER (injected_rate IS NOT NULL)::DOUBLE AS value FROM pairs GROUP BY bill UNION ALL (SELECT 'driver', id, {AMT}::DOUBLE FROM pairs WHERE injected_rate > 0 ORDER BY {AMT} DESC, id LIMIT 10)"))
def sk4(spark, d):
    b = P.dashboard(pairs(spark, d))
    bills = b["bills"].select(F.lit("bill").alias("block"), F.col("bill").alias("name"), F.when(F.col("priced") > 0, F.col("total")).alias("value"))
    return bills.unionByName(b["drivers"].select(F.lit("driver").alias("block"), F.col("id").alias("name"), F.col("amount").alias("value")))


@query("sk7_batch_rows", over_base("""SELECT workbook || '_Reconciled.xlsx' AS target_workbook, action, count(*) AS lines, round(sum(CASE action WHEN 'inject' THEN injected_rate WHEN 'clear' THEN NULL ELSE original_rate END)::DOUBLE, 2) AS rates
FROM (SELECT *, CASE WHEN item_type = 'ProvisionalSum' THEN 'skip_protected' WHEN row <= 0 THEN 'skip_no_anchor' WHEN approved AND injected_rate IS NOT NULL THEN 'inject' WHEN size % 9 = 0 THEN 'keep_formula' WHEN original_rate IS NOT NULL THEN 'keep_baseline' ELSE 'clear' END AS action FROM pairs)
GROUP BY ALL"""))
def sk7(spark, d):
    r = P.priced_rows(pairs(spark, d).withColumn("has_formula", F.col("size") % 9 == 0))
    return r.groupBy("target_workbook", "action").agg(F.count("*").alias("lines"), F.round(F.sum(F.col("rate").cast("decimal(18,4)")).cast("double"), 2).alias("rates"))


@query("sk8_workbook_files", over_base("SELECT workbook || '_Reconciled.xlsx' AS name, (count(*) + count(DISTINCT sheet))::BIGINT AS rows FROM pairs GROUP BY workbook"))
def sk8(spark, d):
    """Files are written and read back: rows with their headings; the parts of a workbook count a sheet's heading once."""
    p = P.priced_workbooks(pairs(spark, d).withColumn("has_formula", F.col("size") % 9 == 0))
    cells = X.cells_of(p.select(F.concat_ws(" ", "part", "target_workbook").alias("path"), "content"))
    name, part = F.substring_index("workbook", " ", -1), F.substring_index("workbook", " ", 1)
    rows = cells.select(name.alias("name"), F.when(F.col("row") > 1, part).alias("part"), "sheet", "row").distinct()
    return rows.groupBy("name").agg(F.count("*").alias("rows"))
