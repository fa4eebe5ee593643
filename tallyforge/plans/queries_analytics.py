"""Queries of the aggregations, windows, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..operators import analytics as A
from ..operators import packages as P
from .adapters import over_base, pairs, source_items, table, target_items
from .queries_scalar import RATE_SQL, dim_sql, q
from .registry import query

AMT = "(injected_rate * quantity)"


@query(
    "ag2_currency_summary",
    over_base(f"""SELECT currency, coalesce(b, 0)::DOUBLE AS base, coalesce(r, 0)::DOUBLE AS remeasured, coalesce(n, 0)::BIGINT AS items, (coalesce(r, 0) - coalesce(b, 0))::DOUBLE AS variance,
  round(CASE WHEN coalesce(b, 0) <> 0 THEN (coalesce(r, 0) - b)::DOUBLE / b::DOUBLE * 100 ELSE 0 END, 6) AS variance_pct
FROM (SELECT s_currency AS currency, sum(s_rate * s_quantity) AS b FROM source_items GROUP BY 1) FULL JOIN (SELECT currency, sum(CASE WHEN approved THEN {AMT} END) AS r, count(*) AS n FROM pairs GROUP BY 1) USING (currency)"""),
)
def ag2(spark, d):
    return A.currency_summary(source_items(spark, d), pairs(spark, d))


@query("ag1_match_counts", over_base("""SELECT count(*) AS total, count(*) FILTER (confidence = 'Exact') AS exact, count(*) FILTER (confidence = 'HighFuzzy') AS high_fuzzy, count(*) FILTER (confidence = 'ManualReviewNeeded') AS review,
  count(*) FILTER (is_vo) AS vo, count(*) FILTER (item_type = 'ProvisionalSum') AS ps, round_even(count(*) FILTER (confidence IN ('Exact', 'HighFuzzy')) * 100.0 / count(*), 1)::DOUBLE AS match_rate FROM pairs"""))
def ag1(spark, d):
    return A.match_counts(pairs(spark, d))


@query("ag5_sheet_totals", over_base(f"SELECT sheet, sum({AMT})::DOUBLE AS total, count(*) FILTER (injected_rate > 0) AS priced, count(*) FILTER (injected_rate IS NULL) AS blank FROM pairs GROUP BY sheet"))
def ag5(spark, d):
    return pairs(spark, d).groupBy("sheet").agg(F.sum(A.amount()).cast("double").alias("total"), F.count_if(F.expr("injected_rate > 0")).alias("priced"), F.count_if(F.expr("injected_rate is null")).alias("blank"))


@query("ag6_snapshot_totals", over_base(f"SELECT coalesce(sum({AMT}) FILTER (currency = 'EGP'), 0)::DOUBLE AS egp, coalesce(sum({AMT}) FILTER (currency = 'USD'), 0)::DOUBLE AS usd, count(*) AS items FROM pairs WHERE approved AND injected_rate > 0"))
def ag6(spark, d):
    p = pairs(spark, d).where("approved and injected_rate > 0")
    return p.agg(A.total(A.amount(), F.col("currency") == "EGP").cast("double").alias("egp"), A.total(A.amount(), F.col("currency") == "USD").cast("double").alias("usd"), F.count("*").alias("items"))


PARETO = f""", p AS (SELECT id, bill, {AMT} AS amount FROM pairs WHERE injected_rate > 0 AND quantity > 0 AND item_type <> 'ProvisionalSum'),
r AS (SELECT *, row_number() OVER (ORDER BY amount DESC, id) AS rank, (sum(amount) OVER (ORDER BY amount DESC, id ROWS UNBOUNDED PRECEDING))::DOUBLE / (sum(amount) OVER ())::DOUBLE AS share FROM p),
n AS (SELECT greatest(count(*) FILTER (share <= 0.8), 1) AS n FROM r),
c AS (SELECT id, bill, amount::DOUBLE AS amount, rank, round(share, 8) AS share, CASE WHEN rank <= n THEN 'A' WHEN share <= 0.95 OR rank = n + 1 THEN 'B' ELSE 'C' END AS class FROM r, n)"""


@query("ag7_wn1_wn2_pareto", over_base(PARETO + " SELECT * FROM c"))
def ag7(spark, d):
    return A.pareto(pairs(spark, d))


@query("ag7_pareto_classes", over_base(PARETO + " SELECT class, count(*) AS items, round(sum(amount), 2) AS value, max(rank) AS last_rank FROM c GROUP BY class"))
def ag7_classes(spark, d):
    return A.pareto(pairs(spark, d)).groupBy("class").agg(F.count("*").alias("items"), F.round(F.sum("amount"), 2).alias("value"), F.max("rank").alias("last_rank"))


TRADE_SQL = "CASE " + " ".join(f"WHEN regexp_matches(t, {q(w)}) THEN {q(n)}" for n, w in R.TRADES) + f" ELSE {q(R.OTHER_TRADE)} END"


@query(
    "ag8_trade_breakdown",
    over_base(f""", p AS (SELECT *, {TRADE_SQL} AS trade FROM (SELECT *, lower(sheet || ' ' || bill || ' ' || description) AS t FROM pairs WHERE injected_rate > 0)),
g AS (SELECT trade, count(*) AS items, sum({AMT}) AS total FROM p GROUP BY trade), w AS (SELECT *, (sum(total) OVER (ORDER BY total DESC, trade ROWS UNBOUNDED PRECEDING))::DOUBLE / (sum(total) OVER ())::DOUBLE AS cum, (sum(total) OVER ())::DOUBLE AS every FROM g),
s AS (SELECT trade, string_agg(sheet, ', ' ORDER BY n) AS samples FROM (SELECT trade, sheet, row_number() OVER (PARTITION BY trade ORDER BY min(id), sheet) AS n FROM p GROUP BY trade, sheet) WHERE n <= 3 GROUP BY trade)
SELECT trade, items, total::DOUBLE AS total, round(total::DOUBLE / every * 100, 6) AS share, CASE WHEN cum <= 0.8 THEN 'A' WHEN cum <= 0.95 THEN 'B' ELSE 'C' END AS class, samples FROM w JOIN s USING (trade)"""),
)
def ag8(spark, d):
    return A.trade_breakdown(pairs(spark, d))


CHANGE = ", v AS (SELECT id, original_rate * quantity AS a, injected_rate * quantity AS b, injected_rate * quantity - original_rate * quantity AS d FROM pairs WHERE injected_rate IS NOT NULL AND original_rate IS NOT NULL)"


@query("ag9_variance", over_base(CHANGE + """ SELECT sum(a)::DOUBLE AS baseline, sum(b)::DOUBLE AS reconciled, coalesce(sum(d) FILTER (d > 0), 0)::DOUBLE AS escalation, coalesce(sum(-d) FILTER (d < 0), 0)::DOUBLE AS savings,
  count(*) FILTER (d > 0.01) AS n_up, count(*) FILTER (d < -0.01) AS n_down, count(*) FILTER (abs(d) <= 0.01) AS n_same FROM v"""))
def ag9(spark, d):
    return A.variance(pairs(spark, d))


@query("ag9_lm2_top_changes", over_base(CHANGE + " SELECT * FROM (SELECT 'rise' AS kind, id, d::DOUBLE AS change FROM v WHERE d > 0 ORDER BY d DESC, id LIMIT 10) UNION ALL SELECT * FROM (SELECT 'fall' AS kind, id, d::DOUBLE AS change FROM v WHERE d < 0 ORDER BY d, id LIMIT 10)"))
def ag9_top(spark, d):
    return A.top_changes(pairs(spark, d))


@query("ag10_distribution", over_base("""SELECT unit, count(*) AS n, min(x) AS low, max(x) AS high, round(median(x), 6) AS median, round(avg(x), 4) AS mean, round(quantile_cont(x, 0.1), 6) AS p10, round(quantile_cont(x, 0.25), 6) AS p25,
  round(quantile_cont(x, 0.75), 6) AS p75, round(quantile_cont(x, 0.9), 6) AS p90, round(coalesce(stddev_samp(x), 0), 4) AS sd FROM (SELECT unit, original_rate::DOUBLE AS x FROM target_items WHERE original_rate > 0) GROUP BY unit"""))
def ag10(spark, d):
    return A.distribution(target_items(spark, d), "original_rate", "unit")


@query("ag11_fx_sensitivity", over_base(f"""SELECT currency, t::DOUBLE AS foreign_total, ({RATE_SQL("currency")})::DOUBLE AS parity, round(l, 4) AS local_total, round(l * 5 / 100, 4) AS impact_5, round(l * 10 / 100, 4) AS impact_10, round(l * 95 / 100, 4) AS down_5, round(l * 90 / 100, 4) AS down_10
FROM (SELECT currency, sum({AMT}) AS t, sum({AMT})::DOUBLE * ({RATE_SQL("currency")})::DOUBLE AS l FROM pairs WHERE injected_rate > 0 AND currency <> 'EGP' GROUP BY currency)"""))
def ag11(spark, d):
    return A.fx_sensitivity(pairs(spark, d))


@query("ag4_aggregate_targets", over_base(f"SELECT currency, sum(t)::DOUBLE AS total, count(*) AS targets FROM (SELECT workbook, currency, sum({AMT}) AS t FROM pairs WHERE approved GROUP BY ALL) GROUP BY currency"))
def ag4(spark, d):
    one = pairs(spark, d).where("approved").groupBy("workbook", "currency").agg(F.sum(A.amount()).alias("t"))
    return one.groupBy("currency").agg(F.sum("t").cast("double").alias("total"), F.count("*").alias("targets"))


BILLS = f", b AS (SELECT sheet, count(*) AS items, coalesce(sum({AMT}) FILTER (injected_rate > 0), 0)::DOUBLE AS total, regexp_matches(sheet, '(?i)provisional|(^|\\s)ps$|44') AS is_ps FROM pairs GROUP BY sheet)"


@query("ag13_so4_dashboard_bills", over_base(BILLS + """ SELECT row_number() OVER (ORDER BY is_ps, array_to_string(list_transform(regexp_extract_all(sheet, '\\d+|\\D+'), lambda x: CASE WHEN regexp_matches(x, '^\\d') THEN lpad(x, 6, '0') ELSE x END), ''), sheet) AS place,
  sheet, items, total, is_ps, CASE WHEN is_ps THEN 'Shielded' WHEN total > 0 THEN 'Priced' ELSE 'Unpriced' END AS status FROM b"""))
def ag13(spark, d):
    b = pairs(spark, d).groupBy("sheet").agg(F.count("*").alias("items"), A.total(A.amount(), F.col("injected_rate") > 0).cast("double").alias("total"))
    b = b.withColumn("is_ps", F.col("sheet").rlike(r"(?i)provisional|(^|\s)ps$|44"))
    status = F.when(F.col("is_ps"), "Shielded").when(F.col("total") > 0, "Priced").otherwise("Unpriced")
    return b.select(F.row_number().over(Window.orderBy("is_ps", T.natural_key(F.col("sheet")), "sheet")).cast("long").alias("place"), "sheet", "items", "total", "is_ps", status.alias("status"))


@query("ag14_dashboard_kpis", over_base(f"SELECT coalesce(sum({AMT}) FILTER (approved), 0)::DOUBLE AS priced, coalesce(sum(original_rate * quantity) FILTER (item_type = 'ProvisionalSum'), 0)::DOUBLE AS shielded, round_even(count(*) FILTER (confidence = 'Exact') * 100.0 / count(*), 2)::DOUBLE AS exact_pct, count(*) AS items FROM pairs"))
def ag14(spark, d):
    return pairs(spark, d).agg(A.total(A.amount(), F.col("approved")).cast("double").alias("priced"), A.total(A.amount("original_rate"), F.col("item_type") == "ProvisionalSum").cast("double").alias("shielded"), F.bround((F.count_if(F.col("confidence") == "Exact") * 100.0 / F.count("*")).cast("double"), 2).alias("exact_pct"), F.count("*").alias("items"))


#: Sheets as bills: some named for villas, infrastructure or provisional sums, some without a dash.
NAMED = """CASE WHEN size % 11 = 0 THEN 'Provisional works ' || code WHEN size % 11 = 1 THEN 'Bill ' || (size % 6) || '.2b Villa ' || code WHEN size % 11 = 2 THEN 'INFRA ' || code || ' retail' WHEN size % 11 = 3 THEN 'Audit ' || code ELSE sheet END"""
NATURAL = "array_to_string(list_transform(regexp_extract_all(code, '\\d+|\\D+'), lambda x: CASE WHEN regexp_matches(x, '^\\d') THEN lpad(x, 6, '0') ELSE x END), '')"


@query("ag15_trade_categories", over_base(f""", k AS (SELECT *, {NAMED} AS name FROM pairs), g AS (SELECT name, count(*) AS items, coalesce(sum({AMT}) FILTER (injected_rate > 0), 0) AS total, regexp_extract(name, '(?i)^(Bill\\s*[0-9]+(?:\\.[0-9]+)?[A-Za-z]*)') AS n FROM k WHERE name NOT ILIKE '%audit%' AND name NOT ILIKE '%dashboard%' GROUP BY name),
b AS (SELECT name, items, total, trim(CASE WHEN instr(name, '-') > 1 THEN split_part(name, '-', 1) WHEN n <> '' THEN n ELSE left(name, 12) END) AS code, trim(CASE WHEN instr(name, '-') > 1 THEN substr(name, instr(name, '-') + 1) WHEN n <> '' THEN CASE WHEN trim(substr(name, length(n) + 1)) = '' THEN n ELSE substr(name, length(n) + 1) END ELSE name END) AS d, regexp_matches(lower(name), 'provisional| ps|ps$') AS ps FROM g),
p AS (SELECT *, CASE WHEN ps THEN ['{P.PROTECTED}'] ELSE list_filter([""" + ", ".join(f"CASE WHEN regexp_matches(code, '{'|'.join(codes)}') OR regexp_matches(lower(d), '{'|'.join(words)}') THEN '{n}' END" for n, codes, words, _, _ in P.TRADE_CATEGORIES) + f"""], lambda x: x IS NOT NULL) END AS found FROM b),
c AS (SELECT *, unnest(CASE WHEN len(found) = 0 THEN ['{P.OTHER_WORKS}'] ELSE found END) AS category FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY {NATURAL}, name) AS place FROM c)
SELECT category, CASE WHEN category = '{P.OTHER_WORKS}' AND count(*) = 1 THEN min(d) WHEN category LIKE 'Residential%' OR category = '{P.OTHER_WORKS}' THEN category || ' (' || count(*) || ' Bills)' ELSE category END AS name, count(*) AS bills, sum(items)::BIGINT AS items, sum(total)::DOUBLE AS total,
  CASE WHEN category = '{P.PROTECTED}' THEN count(*) || ' Shielded Packages' ELSE string_agg(code, ', ' ORDER BY place) FILTER (place <= CASE category {" ".join(f"WHEN '{n}' THEN {k}" for n, _, _, k, _ in P.TRADE_CATEGORIES)} ELSE {P.OTHER_CODES} END) END AS codes,
  CASE category {" ".join(f"WHEN '{n}' THEN '{k}'" for n, _, _, _, k in P.TRADE_CATEGORIES)} WHEN '{P.PROTECTED}' THEN '{P.PROTECTED_CLASS}' ELSE '{P.OTHER_CLASS}' END AS class FROM r GROUP BY category"""))
def ag15(spark, d):
    return P.trade_categories(P.structured_bills(pairs(spark, d).withColumn("name", F.expr(NAMED)), "name"))


@query("ag16_top_cost_drivers", over_base(f""", g AS (SELECT substr(description, 1, 55) AS item, unit, injected_rate AS rate, sum(quantity) AS quantity, sum({AMT}) AS amount FROM pairs WHERE injected_rate > 0 GROUP BY ALL ORDER BY amount DESC, item, unit, rate LIMIT 15),
l AS (SELECT item, unit, rate, string_agg(sheet, ', ' ORDER BY sheet) AS places FROM (SELECT DISTINCT g.item, g.unit, g.rate, p.sheet, dense_rank() OVER (PARTITION BY g.item, g.unit, g.rate ORDER BY p.sheet) AS n FROM g JOIN pairs p ON substr(p.description, 1, 55) = g.item AND p.unit = g.unit AND p.injected_rate = g.rate) WHERE n <= 2 GROUP BY ALL)
SELECT item, unit, rate::DOUBLE AS rate, quantity::DOUBLE AS quantity, amount::DOUBLE AS amount, places FROM g JOIN l USING (item, unit, rate)"""))
def ag16(spark, d):
    p = pairs(spark, d).where("injected_rate > 0").select(F.substring("description", 1, 55).alias("item"), "unit", F.col("injected_rate").alias("rate"), "quantity", "sheet", A.amount().alias("a"))
    g = p.groupBy("item", "unit", "rate").agg(F.sum("quantity").alias("quantity"), F.sum("a").alias("amount"), F.array_join(F.slice(F.array_sort(F.collect_set("sheet")), 1, 2), ", ").alias("places"))
    return g.orderBy(F.desc("amount"), "item", "unit", "rate").limit(15).select("item", "unit", *[F.col(c).cast("double") for c in ("rate", "quantity", "amount")], "places")


def audited(spark, d):
    """Target items with every 97th rate ten times too high and every 53rd amount off by five."""
    t = target_items(spark, d)
    return t.selectExpr("id", "unit", "quantity", "cast(case when row % 97 = 0 then original_rate * 10 else original_rate end as decimal(18,4)) as unit_rate", "cast(original_rate * quantity + case when row % 53 = 0 then 5 else 0 end + case when row % 97 = 0 then original_rate * quantity * 9 else 0 end as decimal(28,4)) as total_amount")


AUDITED = ", i AS (SELECT id, unit, quantity, CASE WHEN row % 97 = 0 THEN original_rate * 10 ELSE original_rate END::DECIMAL(18,4) AS unit_rate, (original_rate * quantity + CASE WHEN row % 53 = 0 THEN 5 ELSE 0 END + CASE WHEN row % 97 = 0 THEN original_rate * quantity * 9 ELSE 0 END)::DECIMAL(28,4) AS total_amount FROM target_items)"


def audit_sql(group: str) -> str:
    return over_base(f"""{AUDITED}, p AS (SELECT *, unit_rate::DOUBLE AS r, {group} AS grp FROM i WHERE unit_rate > 0), s AS (SELECT grp, count(*) AS n, median(r) AS med, avg(r) AS mean, coalesce(stddev_samp(r), 0) AS sd FROM p GROUP BY grp),
m AS (SELECT grp, median(abs(r - med)) AS mad FROM p JOIN s USING (grp) GROUP BY grp), j AS (SELECT *, CASE WHEN mad > 0.0001 THEN 0.6745 * (r - med) / mad WHEN sd > 0.0001 THEN (r - mean) / sd ELSE 0 END AS zz, r / med AS q FROM p JOIN s USING (grp) JOIN m USING (grp)),
o AS (SELECT id, grp, round(CASE WHEN n >= 4 THEN zz ELSE 0 END, 4) AS z, n >= 4 AND abs(zz) >= 3.5 AS outlier, n >= 4 AND med > 0 AND (q BETWEEN 9.5 AND 10.5 OR q BETWEEN 95 AND 105 OR q BETWEEN 950 AND 1050 OR q BETWEEN 0.095 AND 0.105 OR q BETWEEN 0.0095 AND 0.0105) AS shift,
  quantity > 0 AND abs(round_even(quantity * unit_rate, 2) - round_even(total_amount, 2)) > 1 AS mismatch FROM j) SELECT * FROM o WHERE outlier OR shift OR mismatch""")


@query("ag18_ag19_rate_audit", audit_sql("'all'"))
def ag19(spark, d):
    return A.rate_audit(audited(spark, d))


@query("ag20_stratified_audit", audit_sql(dim_sql("unit")))
def ag20(spark, d):
    return A.rate_audit(audited(spark, d), R.dimension(F.col("unit")))


#: The anomalies of the audited items, counted.
ANOMALIES = ", anomalies AS (SELECT count(*) AS n FROM (" + audit_sql("'all'") + "))"


@query("ag21_scorecard", over_base(ANOMALIES + """, c AS (SELECT count(*) AS total, count(*) FILTER (injected_rate > 0 AND item_type <> 'ProvisionalSum') AS priced, count(*) FILTER (confidence = 'Exact') AS exact, count(*) FILTER (item_type = 'ProvisionalSum') AS ps, count(*) FILTER (is_vo) AS vo FROM pairs),
s AS (SELECT *, least(100.0, priced / greatest(1, total - ps) * 100 * 0.5 + exact / greatest(1, total) * 30 + greatest(0, 10 - n * 0.5) + greatest(0, 10 - vo * 0.2))::DOUBLE AS s FROM c, anomalies)
SELECT total, priced, exact, ps, vo, round_even(s, 1) AS score, CASE WHEN s >= 90 THEN 'Low' WHEN s >= 75 THEN 'Moderate' WHEN s >= 60 THEN 'High' ELSE 'Critical' END AS risk FROM s"""))
def ag21(spark, d):
    return A.scorecard(pairs(spark, d), F.lit(A.rate_audit(audited(spark, d)).count()))


@query("ag24_ag30_bill_distribution", over_base("SELECT workbook, bill, count(*) AS items, count(*) FILTER (confidence = 'Exact') AS exact, count(*) FILTER (confidence = 'Unmatched') AS unmatched, round_even(count(*) FILTER (injected_rate > 0 OR (approved AND confidence <> 'Unmatched' AND NOT is_vo)) * 100.0 / count(*), 2)::DOUBLE AS priced_pct FROM pairs GROUP BY ALL"))
def ag24(spark, d):
    priced = (F.col("injected_rate") > 0) | (F.col("approved") & (F.col("confidence") != "Unmatched") & ~F.col("is_vo"))
    return pairs(spark, d).groupBy("workbook", "bill").agg(F.count("*").alias("items"), F.count_if(F.col("confidence") == "Exact").alias("exact"), F.count_if(F.col("confidence") == "Unmatched").alias("unmatched"), F.bround((F.count_if(priced) * 100.0 / F.count("*")).cast("double"), 2).alias("priced_pct"))


@query("ag28_profile_flags", over_base("SELECT bool_or(code <> '') AS has_codes, count(DISTINCT quantity) > 1 AS distinct_quantities FROM target_items"))
def ag28(spark, d):
    q0 = target_items(spark, d).agg(F.bool_or(F.col("code") != "").alias("has_codes"), (F.min("quantity") != F.max("quantity")).alias("distinct_quantities"))
    return q0


@query("st2_currency_union", over_base("SELECT upper(currency) AS currency FROM target_items UNION SELECT upper(s_currency) FROM source_items"))
def st2(spark, d):
    return target_items(spark, d).select(F.upper("currency").alias("currency")).union(source_items(spark, d).select(F.upper("s_currency"))).distinct()


BOTH = ", a AS (SELECT DISTINCT lower(bill || ' ' || quantity::INT) AS b FROM target_items), b AS (SELECT DISTINCT lower(s_bill || ' ' || (s_quantity - 10)::INT) AS b FROM source_items)"


@query("st3_bill_names", over_base(BOTH + " SELECT 'both' AS side, b AS bill FROM (SELECT b FROM a INTERSECT SELECT b FROM b) UNION ALL SELECT 'target', b FROM (SELECT b FROM a EXCEPT SELECT b FROM b) UNION ALL SELECT 'source', b FROM (SELECT b FROM b EXCEPT SELECT b FROM a)"))
def st3(spark, d):
    name = lambda bill, n: F.lower(F.concat_ws(" ", bill, n.cast("int").cast("string"))).alias("bill")
    a = target_items(spark, d).select(name("bill", F.col("quantity")))
    b = source_items(spark, d).select(name("s_bill", F.col("s_quantity") - 10))
    side = lambda df, n: df.select(F.lit(n).alias("side"), "bill")
    return side(a.intersect(b), "both").union(side(a.subtract(b), "target")).union(side(b.subtract(a), "source"))


@query("sc6_st1_union_sources", over_base("SELECT workbook, count(*) AS items, count(DISTINCT sheet) AS sheets FROM (SELECT 'parts' AS workbook, s_bill AS sheet FROM source_items UNION ALL SELECT workbook, sheet FROM target_items) GROUP BY workbook"))
def sc6(spark, d):
    every = source_items(spark, d).select(F.lit("parts").alias("workbook"), F.col("s_bill").alias("sheet")).unionByName(target_items(spark, d).select("workbook", "sheet"))
    return every.groupBy("workbook").agg(F.count("*").alias("items"), F.count_distinct("sheet").alias("sheets"))


@query("ag17_history_statistics", "SELECT l_partkey AS part, count(*) AS n, round((sum(l_extendedprice::DECIMAL(18,2)) FILTER (l_extendedprice > 0))::DOUBLE / count(*) FILTER (l_extendedprice > 0), 8) AS average, max(o_orderdate) AS latest FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_partkey")
def ag17(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy(F.col("l_partkey").alias("part")).agg(F.count("*").alias("n"), F.round(F.sum(F.when(F.col("l_extendedprice") > 0, F.col("l_extendedprice").cast("decimal(18,2)"))).cast("double") / F.count_if(F.col("l_extendedprice") > 0), 8).alias("average"), F.max("o_orderdate").alias("latest"))


DETECTED = "CASE WHEN priced <= 0 THEN 'ConsultantTarget' WHEN regexp_matches(lower(workbook), " + q(R.CONTRACTOR) + ") THEN 'ContractorPriced' WHEN regexp_matches(lower(workbook), " + q(R.CONSULTANT) + ") THEN 'ConsultantTarget' ELSE 'ContractorPriced' END"


@query("ag26_role_harmonisation", over_base(f""", w AS (SELECT *, {DETECTED} AS detected FROM (SELECT CASE l % 4 WHEN 0 THEN 'tender ' WHEN 1 THEN 'CCS ' ELSE '' END || sheet AS workbook, count(*) FILTER (injected_rate > 0 AND l % 3 <> 2) AS priced FROM (SELECT *, length(bill) AS l FROM pairs) GROUP BY ALL)),
r AS (SELECT *, row_number() OVER (ORDER BY priced > 0 DESC, regexp_matches(lower(workbook), 'candy|ccs') DESC, priced DESC, workbook) AS n FROM w)
SELECT workbook, priced, CASE WHEN priced = 0 THEN 'ConsultantTarget' WHEN n = 1 THEN 'ContractorPriced' WHEN detected = 'ConsultantTarget' THEN 'ConsultantTarget' ELSE 'SupplementaryRates' END AS role FROM r"""))
def ag26(spark, d):
    p = pairs(spark, d).withColumn("l", F.length("bill"))
    name = F.concat(F.when(F.col("l") % 4 == 0, "tender ").when(F.col("l") % 4 == 1, "CCS ").otherwise(""), "sheet")
    w = p.groupBy(name.alias("workbook")).agg(F.count_if(F.expr("injected_rate > 0 and l % 3 <> 2")).alias("priced"))
    detected = R.file_role(F.lower("workbook"), F.col("priced"), F.lit(False))
    return A.harmonised_roles(w.withColumn("detected", detected)).select("workbook", "priced", "role")
