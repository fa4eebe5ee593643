"""Queries of filters, mutations, reports, paging, history and presets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import store as S
from ..operators import versions as V
from ..operators.checkpoints import shared_folder
from ..sources import sheets as X
from .adapters import over_base, pairs, source_items, table, target_items
from .queries_scalar import DRIFT_SQL, FL1_SQL, RATE_SQL, norm_sql, q
from .registry import query


OFFERED = """, o AS (SELECT id, CASE item_type WHEN 'RateOnly' THEN NULL WHEN 'ProvisionalSum' THEN 0 ELSE original_rate END AS rate, CASE WHEN size % 2 = 0 THEN original_rate END AS original, description || CASE WHEN size % 5 = 0 THEN ' (Ignored)' ELSE '' END AS description FROM target_items)"""


@query("fl5_fl6_priced_sources", over_base(OFFERED + """ SELECT id, (CASE WHEN rate > 0 THEN rate WHEN original > 0 THEN original ELSE 0 END)::DOUBLE AS rate FROM o WHERE rate > 0 OR original > 0 OR contains(lower(description), 'ignored')"""))
def fl5(spark, d):
    o = target_items(spark, d).selectExpr("id", "case item_type when 'RateOnly' then null when 'ProvisionalSum' then 0 else original_rate end as rate", "case when size % 2 = 0 then original_rate end as original", "concat(description, case when size % 5 = 0 then ' (Ignored)' else '' end) as description")
    return S.priced_sources(o).select("id", F.col("rate").cast("double"))


@query("fl7_protected_guard", over_base("SELECT item_type, count(*) AS items, count(injected_rate) AS priced FROM pairs GROUP BY item_type"))
def fl7(spark, d):
    return S.guarded(pairs(spark, d)).groupBy("item_type").agg(F.count("*").alias("items"), F.count("injected_rate").alias("priced"))


CATEGORY = "CASE WHEN item_type = 'ProvisionalSum' THEN 'PS' WHEN is_vo THEN 'VO' WHEN confidence = 'ManualReviewNeeded' THEN 'Review' WHEN injected_rate > 0 THEN 'Priced' ELSE 'Other' END"


@query("fl8_fl9_fl10_grid_filter", over_base(f"SELECT id, {CATEGORY} AS category FROM pairs WHERE workbook = 'W1' AND (contains(lower(description), 'gear') OR contains(lower(code), 'gear') OR contains(lower(bill), 'gear'))"))
def fl8(spark, d):
    return pairs(spark, d).where("workbook = 'W1'").where(S.grid_search("gear", "description", "code", "bill")).select("id", S.category().alias("category"))


@query("fl11_linkable", over_base("SELECT id FROM pairs WHERE approved AND injected_rate > 0 AND item_type <> 'ProvisionalSum' AND row > 0"))
def fl11(spark, d):
    return pairs(spark, d).where("approved and injected_rate > 0 and item_type <> 'ProvisionalSum' and row > 0").select("id")


@query("sk1_rate_cells", over_base("""SELECT id, CASE WHEN item_type = 'ProvisionalSum' THEN 'skip_protected' WHEN row <= 0 THEN 'skip_no_anchor' WHEN approved AND injected_rate IS NOT NULL THEN 'inject' WHEN size % 9 = 0 THEN 'keep_formula' WHEN original_rate IS NOT NULL THEN 'keep_baseline' ELSE 'clear' END AS action FROM pairs"""))
def sk1(spark, d):
    return pairs(spark, d).withColumn("has_formula", F.col("size") % 9 == 0).select("id", S.rate_cell_action().alias("action"))


STATUS = "CASE WHEN item_type = 'ProvisionalSum' THEN 'Shielded (PS)' WHEN is_vo THEN 'New Scope (VO)' WHEN approved AND injected_rate > 0 THEN 'Injected & Approved' ELSE 'Unpriced / Note' END"


def letter_sql(n):
    """The letters of a column's number up to 52."""
    return f"CASE WHEN {n} > 26 THEN 'A' || chr((38 + {n})::INT) ELSE chr((64 + {n})::INT) END"


#: Pairs with the places of both sides: some rate columns and source rows unknown, some sources in copied files.
PLACED = f""", z AS (SELECT *, CASE WHEN size % 6 > 0 THEN size % 40 + 1 ELSE 7 END AS rc, CASE WHEN size % 5 > 0 THEN size % 45 + 1 ELSE 18 END AS sc, s_id % 97 AS s_row FROM pairs),
g AS (SELECT *, {letter_sql('rc')} || row AS spot, {letter_sql('sc')} || s_row AS s_spot, 'Rates ' || s_id % 2 || '.xlsx' AS file, s_bill || '''s' AS s_sheet, coalesce(s_row > 0, false) AS linked FROM z),
f AS (SELECT *, workbook || '_Reconciled.xlsx#''' || sheet || '''!' || spot AS ref, file || '#''' || replace(s_sheet, '''', '''''') || '''!' || s_spot AS s_ref, coalesce(approved AND injected_rate > 0, false) AS priced FROM g),
l AS (SELECT *, '=HYPERLINK("' || ref || '", "' AS go, '=HYPERLINK("' || s_ref || '", "' AS s_go FROM f)"""


def placed(spark, d):
    p = pairs(spark, d)
    return p.selectExpr("*", "size % 40 + 1 as _rc", "size % 45 + 1 as _sc").withColumns({
        "workbook": F.concat(F.lit("in/"), "workbook", F.lit(".xlsx")), "rate_column": F.expr("case when size % 6 > 0 then _rc end"), "s_rate_column": F.expr("case when size % 5 > 0 then _sc end"), "s_row": F.expr("s_id % 97"),
        "s_workbook": F.expr("concat(case when s_id % 3 = 0 then '[Source_Priced]_' else '' end, 'Rates ', s_id % 2, '.xlsx')"), "s_sheet": F.expr("concat(s_bill, \"'s\")"), "rationale": F.expr("case when size % 4 = 1 then concat('code ', code) end"),
    }).drop("_rc", "_sc")


@query("sk2_so1_lm3_nr37_audit_report", over_base(PLACED + f""", n AS (SELECT *, row_number() OVER (ORDER BY priced DESC, item_type = 'ProvisionalSum', bill, row, id, quantity) AS line FROM l), r AS (SELECT *, line + CASE WHEN priced THEN 7 ELSE 8 END AS sheet_row FROM n)
SELECT line, sheet_row, id, go || '[ ' || spot || ' ] ' || CASE WHEN priced THEN '{S.SAYS_PRICED}' WHEN item_type = 'ProvisionalSum' THEN '{S.SAYS_SHIELDED}' ELSE '{S.SAYS_LOOK}' END || '")' AS jump, CASE WHEN linked THEN s_go || '[ ' || s_spot || ' ] {S.SAYS_SOURCE}")' ELSE '-' END AS source_jump, go || sheet || '")' AS sheet, go || row || '")' AS row,
  code, CASE WHEN length(description) > 120 THEN substr(description, 1, 117) || '...' ELSE description END AS description, coalesce(s_sheet, '-') AS source_sheet, CASE WHEN linked THEN s_row::VARCHAR ELSE '-' END AS source_row, unit, quantity::DOUBLE AS quantity, currency, injected_rate::DOUBLE AS rate, (injected_rate * quantity)::DOUBLE AS amount,
  CASE WHEN injected_rate > 0 THEN '=J' || sheet_row || '*L' || sheet_row ELSE '-' END AS amount_cell, confidence, {STATUS} AS status FROM r WHERE line <= 1048490"""))
def sk2(spark, d):
    return S.audit_report(placed(spark, d))


@query("sk3_so2_linkage_map", over_base(PLACED + f""", n AS (SELECT *, row_number() OVER (ORDER BY s_id IS NOT NULL DESC, confidence = 'Exact' DESC, bill, row, id, quantity) AS line FROM l)
SELECT line, id, CASE WHEN row > 0 THEN go || '[ ' || spot || ' ] {S.SAYS_PRICED}")' ELSE '-' END AS jump, CASE WHEN linked THEN s_go || '[ ' || s_spot || ' ] {S.SAYS_OPEN}")' ELSE '-' END AS source_jump, CASE WHEN row > 0 THEN go || sheet || '")' ELSE sheet END AS sheet, CASE WHEN row > 0 THEN go || row || '")' ELSE '-' END AS row,
  code, CASE WHEN length(description) > 100 THEN substr(description, 1, 97) || '...' ELSE description END AS description, unit, quantity::DOUBLE AS quantity, CASE WHEN linked THEN file ELSE '-' END AS source_file, coalesce(s_sheet, '-') AS source_sheet, CASE WHEN linked THEN s_row::VARCHAR ELSE '-' END AS source_row,
  CASE WHEN linked THEN s_go || s_spot || '")' ELSE '-' END AS source_cell, coalesce(s_code, '-') AS source_code, coalesce(CASE WHEN length(s_description) > 100 THEN substr(s_description, 1, 97) || '...' ELSE s_description END, '-') AS source_text, injected_rate::DOUBLE AS rate, confidence || CASE WHEN size % 4 = 1 THEN ' (code ' || code || ')' ELSE '' END AS match FROM n WHERE line <= 1048490"""))
def sk3(spark, d):
    return S.linkage_map(placed(spark, d))


@query("so3_lm4_page", over_base("SELECT id, workbook, bill FROM pairs ORDER BY coalesce(injected_rate > 0, false) DESC, item_type = 'ProvisionalSum', workbook, bill, row, id LIMIT 100 OFFSET 200"))
def so3(spark, d):
    return S.page(pairs(spark, d), [F.coalesce(F.col("injected_rate") > 0, F.lit(False)).desc(), F.col("item_type") == "ProvisionalSum", "workbook", "bill", "row", "id"], 3).select("id", "workbook", "bill")


@query("mu1_mu2_approvals", over_base("SELECT id, injected_rate IS NOT NULL AND item_type <> 'ProvisionalSum' AND confidence <> 'ManualReviewNeeded' AS auto, injected_rate IS NOT NULL AND item_type <> 'ProvisionalSum' AS every FROM pairs"))
def mu1(spark, d):
    ok = F.col("injected_rate").isNotNull() & (F.col("item_type") != "ProvisionalSum")
    return pairs(spark, d).select("id", (ok & (F.col("confidence") != "ManualReviewNeeded")).alias("auto"), ok.alias("every"))


@query("mu3_toggle_approval", over_base("SELECT id, coalesce(o.value, approved) AS approved FROM pairs LEFT JOIN (SELECT l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey AS id, l_tax > 0.04 AS value FROM lineitem WHERE l_discount > 0.05) o USING (id)"))
def mu3(spark, d):
    o = table(spark, d, "lineitem").where("l_discount > 0.05").selectExpr("concat_ws('_', l_orderkey, l_linenumber, l_partkey, l_suppkey) as id", "l_tax > 0.04 as value")
    return S.overridden(pairs(spark, d).select("id", "approved"), o, "id", "approved")


@query("mu4_mu5_baseline_fallback", over_base("SELECT id, CASE WHEN s_id IS NOT NULL THEN confidence WHEN original_rate IS NOT NULL THEN 'Exact' ELSE 'VariationOrder' END AS confidence, CASE WHEN s_id IS NULL AND original_rate IS NULL THEN 'VariationOrder' ELSE item_type END AS item_type, coalesce(injected_rate, original_rate)::DOUBLE AS rate FROM pairs"))
def mu4(spark, d):
    return S.baseline_fallback(pairs(spark, d)).select("id", "confidence", "item_type", F.col("rate").cast("double"))


@query("mu6_currency_arbitration", over_base(f"""SELECT id, round(CASE WHEN drift IS NOT NULL THEN CASE WHEN a > b THEN b * r ELSE b / r END WHEN currency <> s_currency THEN b * {RATE_SQL("s_currency")}::DOUBLE / {RATE_SQL("currency")}::DOUBLE ELSE b END, 4) AS rate, drift IS NOT NULL OR currency <> s_currency AS adjusted
FROM (SELECT *, {RATE_SQL("drift")}::DOUBLE AS r FROM (SELECT *, original_rate::DOUBLE AS a, s_rate::DOUBLE AS b, CASE WHEN original_rate <= 0 OR s_rate <= 0 THEN NULL {DRIFT_SQL.replace("(a, b)", "(original_rate::DOUBLE, s_rate::DOUBLE)")} END AS drift FROM pairs WHERE s_id IS NOT NULL))"""))
def mu6(spark, d):
    p = pairs(spark, d).where("s_id is not null").withColumn("drift", R.drift_currency(F.col("original_rate"), F.col("s_rate")))
    a, b, r = F.col("original_rate").cast("double"), F.col("s_rate").cast("double"), R.rate_of(F.col("drift")).cast("double")
    rate = F.when(F.col("drift").isNotNull(), F.when(a > b, b * r).otherwise(b / r)).otherwise(R.convert(F.col("s_rate"), F.col("s_currency"), F.col("currency")))
    return p.select("id", F.round(rate, 4).alias("rate"), (F.col("drift").isNotNull() | (F.col("currency") != F.col("s_currency"))).alias("adjusted"))


@query("mu7_preset_application", "SELECT p_partkey AS k, CASE WHEN p_size % 4 - 1 >= 0 THEN p_size % 4 - 1 ELSE 7 END AS rate_col FROM part")
def mu7(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), S.preset_column(F.col("p_size") % 4 - 1, F.lit(7)).alias("rate_col"))


@query("mu8_manual_links", "SELECT p_partkey AS k, CASE WHEN p_size % 7 = 0 THEN 'ShieldedPS' WHEN regexp_matches(t, 'skip|exclude') THEN 'Excluded' WHEN t = '' OR contains(t, 'global') THEN 'GlobalSearch' ELSE 'ManualMatched' END AS status FROM (SELECT *, ['Skip this', 'exclude', '', 'Global search', 'Bill 01'][p_partkey % 5 + 1].lower() AS t FROM part)")
def mu8(spark, d):
    t = table(spark, d, "part").selectExpr("p_partkey as k", "p_size % 7 = 0 as ps", "element_at(array('Skip this', 'exclude', '', 'Global search', 'Bill 01'), cast(p_partkey % 5 + 1 as int)) as t")
    return t.select("k", S.manual_link(F.col("t"), F.col("ps")).alias("status"))


HISTORY = """WITH snap AS (SELECT o_orderkey AS rev, o_orderdate AS day, o_orderpriority AS project, coalesce(nullif(CASE WHEN o_custkey % 3 = 0 THEN '' ELSE 'Invoice ' || o_custkey END, ''), o_orderpriority) AS invoice, 'source ' || o_orderstatus || '.xlsx' AS source, 'target ' || o_orderpriority || '.xlsx' AS target FROM orders),
item AS (SELECT l_orderkey AS rev, l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey AS id, p_name AS description, lower(p_name) AS normalised, p_brand AS code, p_type AS bill, CASE l_returnflag WHEN 'A' THEN NULL ELSE l_extendedprice END AS rate FROM lineitem JOIN part ON l_partkey = p_partkey),
h AS (SELECT * FROM snap JOIN item USING (rev))"""


def history(spark, d):
    snap = table(spark, d, "orders").selectExpr("o_orderkey as rev", "o_orderdate as day", "o_orderpriority as project", "coalesce(nullif(case when o_custkey % 3 = 0 then '' else concat('Invoice ', o_custkey) end, ''), o_orderpriority) as invoice", "concat('source ', o_orderstatus, '.xlsx') as source", "concat('target ', o_orderpriority, '.xlsx') as target")
    item = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).selectExpr("l_orderkey as rev", "concat_ws('_', l_orderkey, l_linenumber, l_partkey, l_suppkey) as id", "p_name as description", "lower(p_name) as normalised", "p_brand as code", "p_type as bill", "case l_returnflag when 'A' then null else l_extendedprice end as rate")
    return S.history(snap, item)


@query("jn14_db8_recent_history", HISTORY + " SELECT rev, id, rate FROM h WHERE rate IS NOT NULL ORDER BY rev DESC, id LIMIT 200")
def db8(spark, d):
    return S.recent(history(spark, d)).select("rev", "id", "rate")


@query("db6_so5_snapshots", "SELECT o_orderkey AS rev, o_orderdate AS day FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY rev DESC")
def db6(spark, d):
    return table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").selectExpr("o_orderkey as rev", "o_orderdate as day").orderBy(F.desc("rev"))


@query("db7_lm1_exact_history", HISTORY + " SELECT description, rev, id, rate FROM (SELECT *, row_number() OVER (PARTITION BY description, bill ORDER BY rev DESC, id) AS n FROM h) WHERE n <= 10")
def db7(spark, d):
    return S.latest_per_item(history(spark, d), ["description", "bill"], 10).select("description", "rev", "id", "rate")


SEARCHED = ["description", "normalised", "code", "invoice", "project", "source", "target", "bill"]


def like_sql(term):
    return "rate IS NOT NULL AND (" + " OR ".join(f"{c} ILIKE '%{term}%'" for c in SEARCHED) + ")"


@query("db9_history_search", HISTORY + f" SELECT rev, id, rate FROM h WHERE {like_sql('anvi')} ORDER BY rev DESC, id LIMIT 200")
def db9(spark, d):
    return S.search(history(spark, d), "anvi", SEARCHED).select("rev", "id", "rate")


def fuzzy_sql(term):
    """The search for a term and, if it finds less than ten rows, the words of the latest 2,000 rates."""
    one = "CASE WHEN contains(lower(description || chr(10) || normalised || chr(10) || invoice || chr(10) || source), '{t}') THEN 0.75 ELSE list_max(list_transform(regexp_split_to_array(lower(description), ' +'), lambda w: CASE WHEN abs(length(w) - {n}) <= 2 AND levenshtein(w, '{t}') <= 2 THEN 1 - levenshtein(w, '{t}')::DOUBLE / greatest(length(w), {n}) ELSE 0 END)) END"
    score = "greatest(0, " + ", ".join(one.format(t=t, n=len(t)) for t in term.lower().replace("-", " ").split()) + ")"
    return HISTORY + f""", direct AS MATERIALIZED (SELECT * FROM h WHERE {like_sql(term)} ORDER BY rev DESC, id LIMIT 200), pool AS (SELECT * FROM h WHERE rate IS NOT NULL ORDER BY rev DESC, id LIMIT 2000),
more AS (SELECT rev, id, {score}::DOUBLE AS score FROM pool p WHERE (SELECT count(*) FROM direct) < 10 AND NOT EXISTS (SELECT 1 FROM direct x WHERE x.rev = p.rev AND x.code = p.code AND x.description = p.description))
SELECT rev, id, 1.0::DOUBLE AS score FROM direct UNION ALL SELECT * FROM (SELECT rev, id, round(score, 6) AS score FROM more WHERE score >= 0.6 ORDER BY more.score DESC, rev DESC, id LIMIT 200 - (SELECT count(*) FROM direct))"""


@query("db10_jn15_fuzzy_history", fuzzy_sql("anvl-gaer"))
def db10(spark, d):
    return S.fuzzy_search(history(spark, d), "anvl-gaer", SEARCHED).select("rev", "id", F.round("score", 6).alias("score"))


@query("db5_sk10_snapshot_upsert", "SELECT key, value FROM (SELECT user_id AS key, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def db5(spark, d):
    e = table(spark, d, "events").selectExpr("user_id as key", "value", "struct(ts, event_id) as version")
    return S.upserted(e, "key", "version").select("key", "value")


def kept_store(spark, d):
    """A store after a row of commits: two snapshots in the first layout, rates replaced, the layout raised, an audit trail in two parts."""
    st = V.Store(spark, shared_folder(spark, "store"), buckets=16)
    st.migrate(1)
    part = table(spark, d, "part").selectExpr("cast(p_partkey as string) as Id", "p_type as BillNumber", "p_brand as ItemCode", "p_name as Description", "cast(p_retailprice as double) as UnitRate", "p_size", "p_partkey")
    header = lambda code: spark.range(1).select(F.lit(code).alias("ProjectCode"), F.lit("R0").alias("RevisionCode"))
    V.save_snapshot(st, header("A"), part.drop("p_size", "p_partkey"))
    V.save_snapshot(st, header("B"), part.where("p_size % 2 = 0").drop("p_size", "p_partkey"))
    # each third item of the first snapshot twice, the later rate stays; some that were not there
    newer = lambda by, n: part.where("p_partkey % 3 = 0").selectExpr("concat(case when p_partkey % 9 = 0 then '3_' else '1_' end, Id) as Id", "cast(1 as bigint) as RevisionId", "BillNumber", f"UnitRate * {by} as UnitRate", f"{n} as n")
    st.run(lambda t: t.replace("SnapshotItems", newer(2, 1).unionByName(newer(3, 2)), "n"))
    st.run(lambda t: t.delete("SnapshotItems", part.where("p_partkey % 7 = 0").select(F.concat(F.lit("2_"), "Id").alias("Id"))))
    st.migrate()
    log = table(spark, d, "events").select(F.col("user_id").cast("string").alias("ItemId"), F.col("event_type").alias("Action"), F.col("event_id").cast("string").alias("Reason"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("Timestamp"))
    for odd in (0, 1):
        st.run(lambda t: t.add("ItemAuditTrail", log.where(F.col("Reason").cast("bigint") % 2 == odd), "Timestamp"))  # noqa: B023
    return st


@query("db1_db5_sk10_store_items", """WITH p AS (SELECT p_partkey AS k, p_retailprice AS r, p_size, p_type FROM part), a AS (SELECT '1_' || k AS Id, 1::BIGINT AS RevisionId, p_type, r FROM p UNION ALL SELECT '2_' || k, 2, p_type, r FROM p WHERE p_size % 2 = 0 AND k % 7 <> 0),
n AS (SELECT CASE WHEN k % 9 = 0 THEN '3_' ELSE '1_' END || k AS Id, 1::BIGINT AS RevisionId, p_type, r * 3 AS r FROM p WHERE k % 3 = 0)
SELECT Id, RevisionId, p_type AS BillNumber, r::DOUBLE AS UnitRate FROM n UNION ALL SELECT Id, RevisionId, p_type, r::DOUBLE FROM a WHERE Id NOT IN (SELECT Id FROM n)""")
def db1_store(spark, d):
    return kept_store(spark, d).read("SnapshotItems").select("Id", "RevisionId", "BillNumber", "UnitRate")


@query("db12_sk10_store_audit", "SELECT row_number() OVER (ORDER BY event_id % 2, event_id) AS AuditId, user_id::VARCHAR AS ItemId, event_type AS Action, NULL::DOUBLE AS NewRate FROM events")
def db12_store(spark, d):
    return kept_store(spark, d).read("ItemAuditTrail").select("AuditId", "ItemId", "Action", "NewRate")


@query("db11_preset_upsert", "WITH o AS (SELECT c_custkey AS name, c_acctbal AS v FROM customer), n AS (SELECT s_suppkey AS name, s_acctbal AS v FROM supplier) SELECT * FROM n UNION ALL SELECT * FROM o WHERE name NOT IN (SELECT name FROM n)")
def db11(spark, d):
    old, new = table(spark, d, "customer").selectExpr("c_custkey as name", "c_acctbal as v"), table(spark, d, "supplier").selectExpr("s_suppkey as name", "s_acctbal as v")
    return S.merged(old, new, "name")


@query("db11_preset_delete", "SELECT c_custkey AS name, c_acctbal AS v FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def db11_delete(spark, d):
    return S.without(table(spark, d, "customer").selectExpr("c_custkey as name", "c_acctbal as v"), table(spark, d, "supplier").selectExpr("s_suppkey as name"), "name")


@query("db12_audit_trail", "SELECT event_id, user_id AS item, event_type AS action, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS newest FROM events")
def db12(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, d, "events").select("event_id", F.col("user_id").alias("item"), F.col("event_type").alias("action"), F.row_number().over(w).cast("long").alias("newest"))


@query("sk9_diagnostics", over_base(""", n AS (SELECT count(*) AS total FROM pairs), m AS (SELECT unnest(['total', 'sheets', 'exact', 'high', 'review', 'unmatched', 'shielded', 'variation', 'approved']) AS name, unnest([count(*), count(DISTINCT sheet), count(*) FILTER (confidence = 'Exact'), count(*) FILTER (confidence = 'HighFuzzy'), count(*) FILTER (confidence = 'ManualReviewNeeded'), count(*) FILTER (confidence = 'Unmatched'),
  count(*) FILTER (item_type = 'ProvisionalSum'), count(*) FILTER (is_vo), count(*) FILTER (approved)]) AS items FROM pairs)
SELECT 'metrics' AS section, name, items, CASE WHEN name IN ('exact', 'high', 'review', 'unmatched') THEN round(items * 100.0::DOUBLE / total, 6) END AS percent, NULL::DOUBLE AS base, NULL::DOUBLE AS remeasured, NULL::DOUBLE AS variance FROM m, n
UNION ALL SELECT 'metrics', 'sources', count(*), NULL, NULL, NULL, NULL FROM source_items UNION ALL SELECT 'status', CASE WHEN count(*) FILTER (confidence = 'ManualReviewNeeded') > 0 THEN 'WARNING' ELSE 'SUCCESS' END, count(*) FILTER (confidence = 'ManualReviewNeeded'), NULL, NULL, NULL, NULL FROM pairs
UNION ALL SELECT 'currency', currency, coalesce(items, 0), round(CASE WHEN base > 0 THEN (coalesce(r, 0) - base)::DOUBLE / base::DOUBLE * 100 ELSE 0 END, 6), coalesce(base, 0)::DOUBLE, coalesce(r, 0)::DOUBLE, (coalesce(r, 0) - coalesce(base, 0))::DOUBLE
  FROM (SELECT s_currency AS currency, sum(s_rate * s_quantity) AS base FROM source_items GROUP BY ALL) FULL JOIN (SELECT currency, sum(injected_rate * quantity) FILTER (approved) AS r, count(*) AS items FROM pairs GROUP BY ALL) USING (currency)"""))
def sk9(spark, d):
    return S.diagnostics(source_items(spark, d), pairs(spark, d))


@query("nr35_pair_display", over_base("""SELECT id, CASE WHEN injected_rate IS NOT NULL THEN format('{:,.2f}', injected_rate::DOUBLE) WHEN item_type = 'ProvisionalSum' THEN 'محمي (PS)' ELSE 'بند مستحدث (VO)' END AS rate_text,
  CASE WHEN item_type = 'ProvisionalSum' THEN 'مبلغ احتياطي محمي' WHEN confidence = 'Exact' THEN 'تطابق تام (100%)' WHEN confidence = 'HighFuzzy' THEN 'تطابق ذكي (' || (50 + size) || '%)' WHEN confidence = 'ManualReviewNeeded' THEN 'مراجعة فنية' WHEN is_vo THEN 'بند مستحدث (VO)' ELSE 'غير مطابق' END AS confidence_text,
  CASE WHEN item_type = 'ProvisionalSum' THEN 'محمي تلقائياً (PS)' WHEN s_id IS NOT NULL THEN CASE WHEN size % 4 = 0 THEN 'sheet ' || s_code ELSE s_bill END WHEN is_vo THEN 'بند مستحدث (VO)' ELSE '-' END AS source_table, coalesce(s_code, '-') AS source_code FROM pairs"""))
def nr35(spark, d):
    p = pairs(spark, d).withColumns({"similarity": (F.col("size") + 50) / 100, "s_sheet": F.concat(F.lit("sheet "), "s_code"), "s_bill": F.when(F.col("size") % 4 != 0, F.col("s_bill")).otherwise(" ")})
    return S.pair_display(p).select("id", "rate_text", "confidence_text", "source_table", "source_code")


@query("nr31_anchor_row", over_base("SELECT sheet, bill, row FROM (SELECT *, row_number() OVER (PARTITION BY sheet, bill ORDER BY CASE WHEN size % 2 = 0 AND size % 3 = 0 THEN 0 WHEN size % 2 = 0 THEN 1 WHEN size % 3 = 0 THEN 2 ELSE 3 END, row DESC, id) AS n FROM target_items) WHERE n = 1"))
def nr31(spark, d):
    return S.anchor_rows(target_items(spark, d), ["sheet", "bill"], F.col("size") % 2 == 0, F.col("size") % 3 == 0).select("sheet", "bill", "row")


@query("nr13_wn3_wn4_flat_rows", """WITH c AS (SELECT conv_id, turn, role, text, last_value(CASE WHEN role <> 'assistant' AND turn % 2 = 0 THEN turn END IGNORE NULLS) OVER w AS heading, sum((role = 'assistant')::INT) OVER w - (role = 'assistant')::INT AS block FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, block::BIGINT AS block, max(heading) AS heading, count(*) AS lines, sum(length(text))::BIGINT AS chars, bool_or(role = 'assistant') AS priced FROM c GROUP BY conv_id, block""")
def nr13(spark, d):
    c = table(spark, d, "conversations")
    priced = F.col("role") == "assistant"
    heading = F.when(~priced & (F.col("turn") % 2 == 0), F.col("turn"))
    return X.carried_blocks(c, ["conv_id"], ["turn", "role", "text"], priced, heading).groupBy("conv_id", "block").agg(F.max("heading").alias("heading"), F.count("*").alias("lines"), F.sum(F.length("text")).alias("chars"), F.bool_or(priced).alias("priced"))


BOOK = "'W' || (p_partkey % 3) AS workbook, p_type AS sheet"


@query("nr12_sc2_hierarchical_items", f"""SELECT 'B_' || p_type || '_' || (p_partkey + 2) || '_' || p_brand AS id, {BOOK}, (p_partkey + 2)::INT AS row, p_brand AS code, p_name AS description, 'm2' AS unit, p_size::DOUBLE AS quantity, p_retailprice::DOUBLE AS rate, round(p_size * p_retailprice, 2)::DOUBLE AS amount, 'Normal' AS item_type
FROM part WHERE p_type IS NOT NULL AND p_size % 5 <> 0""")
def nr12(spark, d):
    i = X.hierarchical_items(X.demo_cells(table(spark, d, "part"), hierarchical=True))
    return i.select("id", "workbook", "sheet", "row", "code", "description", "unit", *[F.round(F.col(c).cast("double"), 2).alias(c) for c in ("quantity", "rate", "amount")], "item_type")


#: The row machine over the rows of the demo tree, row by row.
TREE = """WITH RECURSIVE p AS (SELECT *, p_partkey AS k, 'W' || (p_partkey % 3) AS workbook, CASE p_type WHEN 'PROMO' THEN 'Provisional Sums' ELSE p_type END AS sheet, CASE p_type WHEN 'LARGE' THEN 'EUR' ELSE 'EGP' END AS currency FROM part WHERE p_type NOT IN ('ECONOMY', 'SMALL')),
c AS (SELECT workbook, sheet, currency, 4 * k + 5 AS row, CASE WHEN k % 18 = 0 THEN 'S' || (k % 4) ELSE '' END AS sn, '' AS cd, 'SECTION ' || p_brand AS tx, '' AS unit, 0 AS q, NULL::DOUBLE AS r, NULL::DOUBLE AS a, false AS ro, false AS ig FROM p WHERE k % 9 = 0
  UNION ALL SELECT workbook, sheet, currency, 4 * k + 6, '', CASE WHEN k % 15 = 1 THEN 'much too long ' || p_brand ELSE p_brand END, 'Supply of', '', 0, NULL, NULL, false, false FROM p WHERE k % 3 <> 0
  UNION ALL SELECT workbook, sheet, currency, 4 * k + 7, CASE WHEN k % 20 = 1 THEN (k % 100)::VARCHAR ELSE '' END, '', 'Note ' || p_name, '', 0, NULL, NULL, false, false FROM p WHERE k % 4 = 1
  UNION ALL SELECT workbook, sheet, currency, 4 * k + 8, CASE WHEN k % 5 = 0 THEN (k % 50)::VARCHAR ELSE '' END, '', CASE WHEN k % 10 <> 7 THEN p_name ELSE '' END, CASE WHEN k % 7 <> 0 THEN 'm2' ELSE '' END, CASE WHEN k % 6 <> 0 THEN p_size ELSE 0 END, CASE WHEN k % 22 = 0 THEN 0 WHEN k % 11 <> 0 THEN round(p_retailprice, 2) END, CASE WHEN k % 13 <> 0 AND k % 33 = 11 THEN p_size * 2.5 END, k % 13 = 0, k % 12 = 0 FROM p),
n AS (SELECT *, row_number() OVER (PARTITION BY workbook, sheet ORDER BY row) AS i FROM c),
w AS (SELECT DISTINCT workbook, sheet, 0::BIGINT AS i, '' AS section, '' AS code, '' AS serial, '' AS txt, 0::BIGINT AS start, false AS item, '' AS o_code, '' AS o_serial, '' AS o_text, 0::BIGINT AS o_start FROM n
  UNION ALL SELECT workbook, sheet, i, section, CASE WHEN item THEN '' ELSE c1 END, CASE WHEN item THEN '' ELSE s1 END, CASE WHEN item THEN '' ELSE t1 END, CASE WHEN item THEN 0 ELSE st1 END, item, c1, CASE WHEN s1 <> '' THEN s1 ELSE c1 END, t1, st1
  FROM (SELECT *, NOT sec AND ((q > 0 AND unit <> '') OR (unit <> '' AND (c1 <> '' OR ro)) OR (q > 0 AND c1 <> '')) AS item FROM (SELECT *, CASE WHEN sec THEN code WHEN coded THEN cd WHEN code = '' THEN s1 ELSE code END AS c1, CASE WHEN sec THEN txt WHEN coded THEN tx ELSE trim(txt || ' ' || tx) END AS t1, CASE WHEN sec THEN start WHEN coded OR (start = 0 AND tx <> '') THEN row ELSE start END AS st1
    FROM (SELECT w.workbook, w.sheet, n.i, n.row, w.code, w.txt, w.start, n.cd, n.tx, n.unit, n.q, n.ro, CASE WHEN n.sn <> '' THEN n.sn ELSE w.serial END AS s1, n.cd = '' AND n.q = 0 AND n.unit = '' AND n.tx LIKE 'SECTION %' AS sec, n.cd <> '' AND length(n.cd) <= 12 AS coded, CASE WHEN sec THEN n.tx ELSE w.section END AS section FROM w JOIN n ON n.workbook = w.workbook AND n.sheet = w.sheet AND n.i = w.i + 1)))),
o AS (SELECT n.*, w.section, o_code AS code, o_serial AS serial, CASE WHEN o_text = '' THEN tx ELSE o_text END AS description, CASE WHEN o_start = 0 THEN row ELSE o_start END AS start_row, CASE WHEN r > 0 THEN r WHEN r = 0 THEN 0 WHEN a > 0 AND q > 0 THEN a / q WHEN a IS NOT NULL OR ig THEN 0 END AS rate FROM w JOIN n USING (workbook, sheet, i) WHERE item)
SELECT workbook, sheet, row::INT AS row, start_row::INT AS start_row, section, code, serial, description, unit, q::DOUBLE AS quantity, rate::DOUBLE AS rate, round(CASE WHEN rate IS NOT NULL THEN rate * q WHEN a > 0 THEN a WHEN ro THEN 0 END, 2)::DOUBLE AS amount, currency,
  CASE WHEN sheet = 'Provisional Sums' THEN 'ProvisionalSum' WHEN ro OR (q = 0 AND NOT ig) THEN 'RateOnly' ELSE 'Normal' END AS item_type FROM o"""


@query("nr12_sc2_tree_items", TREE)
def nr12_tree(spark, d):
    """Items whose descriptions run over rows, on sheets with Arabic and English headings, without headings, of provisional sums and of no bill."""
    i = X.hierarchical_items(X.demo_tree(table(spark, d, "part")))
    return i.select("workbook", "sheet", "row", "start_row", "section", "code", "serial", "description", "unit", *[F.round(F.col(c).cast("double"), 2).alias(c) for c in ("quantity", "rate", "amount")], "currency", "item_type")


@query("sc1_sc3_flat_items", f"""WITH p AS (SELECT {BOOK}, (p_partkey + 2)::INT AS row, p_brand AS code, p_name AS description, {norm_sql("p_name")} AS normalised, p_size::DECIMAL(18,4) AS quantity, p_retailprice::DECIMAL(18,2)::DECIMAL(18,4) AS rate, p_type AS s FROM part WHERE p_type IS NOT NULL)
SELECT workbook, sheet, row, code, description, normalised, 'm2' AS unit, quantity::DOUBLE AS quantity, rate::DOUBLE AS rate, (rate * quantity)::DECIMAL(28,4)::DOUBLE AS amount, 'U_' || workbook || '_' || sheet || '_' || row || '_' || code AS id FROM p WHERE NOT ({FL1_SQL}) AND (quantity > 0 OR rate > 0)""")
def sc1(spark, d):
    rows = X.flat_items(X.demo_cells(table(spark, d, "part"), hierarchical=False)).select("workbook", "sheet", "row", "code", "description", "normalised", "unit", "quantity", "rate", "amount", "id")
    return rows.withColumns({c: F.col(c).cast("double") for c in ("quantity", "rate", "amount")})


ALL_ROLES = list(R.HEADERS)


def role_sql(role):
    """The pattern of a role for DuckDB, whose word boundaries know ASCII letters only."""
    edge = "[^\\p{L}\\p{N}_]"
    return q("(?i)" + R.HEADERS[role].replace("(^|\\b)", f"(^|{edge})").replace("($|\\b)", f"($|{edge})"))


#: Every cell text of the demo ledger, once.
LEDGER_CELLS = """SELECT DISTINCT unnest(v) AS cell FROM (SELECT CASE WHEN p_type = 'STANDARD' THEN {levelled} WHEN p_type = 'PROMO' THEN {arabic} ELSE {listed} END || CASE WHEN p_type <> 'STANDARD' THEN [CASE WHEN k % 5 = 0 THEN 'Bill ' || (k % 7) END, CASE WHEN k % 8 = 0 THEN 'Class ' || (k % 4) END]
  ELSE [CASE WHEN k % 2 = 0 THEN 'Works' END, CASE WHEN k % 10 = 0 THEN 'WORKS' WHEN k % 3 <> 0 THEN 'Zone ' || (k % 3) END, CASE WHEN k % 4 = 0 THEN 'Part ' || (k % 5) END] END
  || [CASE WHEN k % 6 <> 0 THEN p_brand END, CASE WHEN k % 37 = 0 THEN 'Description' WHEN k % 11 = 0 THEN 'Provisional sum for ' || p_name ELSE p_name END, 'm2', CASE WHEN k % 13 <> 0 THEN p_size::VARCHAR END, CASE WHEN k % 17 <> 0 THEN p_retailprice::DECIMAL(18,2)::VARCHAR END, CASE WHEN k % 19 = 0 THEN '123.45' END,
    CASE WHEN p_size % 4 = 1 THEN 'Note ' || p_name END, CASE WHEN p_size % 9 = 0 THEN 'SECTION ' || p_brand END] AS v FROM (SELECT *, p_partkey AS k FROM part))""".format(**{n: "[" + ",".join(map(q, v)) + "]" for n, v in (("levelled", X.LEVELLED), ("arabic", X.ARABIC), ("listed", X.LISTED))})


@query("nr7_header_roles", f"SELECT cell, {', '.join(f'regexp_matches(cell, {role_sql(r)}) AS is_{r}' for r in ALL_ROLES)} FROM ({LEDGER_CELLS}) WHERE cell IS NOT NULL")
def nr7(spark, d):
    """All twelve roles over every cell of the demo ledger."""
    h = X.demo_ledger(table(spark, d, "part")).select(F.col("raw").alias("cell")).distinct()
    return h.select("cell", *[F.col("cell").rlike("(?i)" + R.HEADERS[r]).alias(f"is_{r}") for r in ALL_ROLES])


#: The rows of the demo ledger by what they are, from the parts themselves.
LEDGER = f"""WITH p AS (SELECT *, 'W' || (p_partkey % 3) AS workbook, p_type AS sheet, p_type = 'STANDARD' AS lv, p_partkey AS k FROM part),
l AS (SELECT *, CASE WHEN k % 2 = 0 THEN 'Works' END AS l1, CASE WHEN k % 10 = 0 THEN NULL WHEN k % 3 <> 0 THEN 'Zone ' || (k % 3) END AS l2, CASE WHEN k % 4 = 0 THEN 'Part ' || (k % 5) END AS l3 FROM p),
i AS (SELECT workbook, sheet, (3 * k + 7)::INT AS row, CASE WHEN k % 37 = 0 THEN 'Description' WHEN k % 11 = 0 THEN 'Provisional sum for ' || p_name ELSE p_name END AS line, CASE WHEN k % 6 <> 0 THEN p_brand ELSE '' END AS code, CASE WHEN k % 13 <> 0 THEN p_size ELSE 0 END::DECIMAL(18,4) AS q, CASE WHEN k % 17 <> 0 THEN p_retailprice ELSE 0 END::DECIMAL(18,2)::DECIMAL(18,4) AS r, CASE WHEN k % 19 = 0 THEN 123.45 ELSE 0 END::DECIMAL(28,4) AS a,
  CASE WHEN lv THEN list_filter([l1, l2, l3], lambda x: x IS NOT NULL) ELSE [] END AS levels, CASE WHEN NOT lv AND k % 5 = 0 THEN 'Bill ' || (k % 7) END AS bc, CASE WHEN NOT lv AND k % 8 = 0 THEN 'Class ' || (k % 4) END AS sc FROM l
  UNION ALL SELECT workbook, sheet, (3 * k + 5)::INT, 'Note ' || p_name, '', 0, 0, 0, [], NULL, NULL FROM p WHERE p_size % 4 = 1 UNION ALL SELECT workbook, sheet, (3 * k + 6)::INT, 'SECTION ' || p_brand, '', 0, 0, 0, [], NULL, NULL FROM p WHERE p_size % 9 = 0),
t AS (SELECT *, line <> 'Description' AND (q <> 0 OR r <> 0 OR a <> 0) AS item, line LIKE 'SECTION %' AS names FROM i),
c AS (SELECT *, coalesce(last_value(coalesce(bc, levels[-1]) IGNORE NULLS) OVER w, sheet) AS bill, coalesce(last_value(CASE WHEN names THEN line ELSE coalesce(sc, CASE WHEN len(levels) >= 3 THEN levels[-2] WHEN len(levels) = 2 THEN levels[1] END) END IGNORE NULLS) OVER w, '') AS section,
  coalesce(sum((item OR names)::INT) OVER (PARTITION BY workbook, sheet ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS block FROM t WINDOW w AS (PARTITION BY workbook, sheet ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
x AS (SELECT workbook, sheet, block, string_agg(line, ' ' ORDER BY row) FILTER (NOT item AND NOT names AND line <> 'Description') AS texts FROM c GROUP BY ALL)
SELECT workbook, sheet, row, bill, section, array_to_string(levels, ' / ') AS path, code, line, concat_ws(' ', texts, line) AS description, q::DOUBLE AS quantity, r::DOUBLE AS rate, (CASE WHEN a = 0 AND r > 0 AND q > 0 THEN r * q ELSE a END)::DECIMAL(28,4)::DOUBLE AS amount,
  CASE WHEN q = 0 AND r > 0 THEN 'RateOnly' WHEN line LIKE 'Provisional sum%' THEN 'ProvisionalSum' ELSE 'Normal' END AS item_type FROM c JOIN x USING (workbook, sheet, block) WHERE item"""


@query("sc1_nr13_wn3_wn4_ledger_items", LEDGER)
def sc1_ledger(spark, d):
    rows = X.flat_items(X.demo_ledger(table(spark, d, "part"))).select("workbook", "sheet", "row", "bill", "section", "path", "code", "line", "description", "quantity", "rate", "amount", "item_type")
    return rows.withColumns({c: F.col(c).cast("double") for c in ("quantity", "rate", "amount")})


@query("nr6_nr7_sc5_ledger_headers", f"SELECT DISTINCT {BOOK}, 3 AS header, true AS found, lv + 3 AS code, lv + 4 AS description, lv + 5 AS unit, lv + 6 AS quantity, lv + 7 AS rate, lv + 8 AS amount, CASE WHEN lv = 0 THEN 1 END AS bill, CASE WHEN lv = 0 THEN 2 END AS section, CASE WHEN lv = 1 THEN '1,2,3' ELSE '' END AS hierarchy FROM (SELECT *, (p_type = 'STANDARD')::INT AS lv FROM part)")
def nr6_ledger(spark, d):
    """Headings over two rows, with levels, and Arabic ones."""
    h = X.resolve_headers(X.demo_ledger(table(spark, d, "part")))
    return h.select("workbook", "sheet", "header", "found", "code", "description", "unit", "quantity", "rate", "amount", "bill", "section", F.array_join(F.col("hierarchy").cast("array<string>"), ",").alias("hierarchy"))


@query("nr6_sc5_wn9_header_columns", f"SELECT DISTINCT {BOOK}, 1 AS header, true AS found, 'EGP' AS currency, 1 AS code, 1 AS serial, 2 AS description, 3 AS unit, 4 AS quantity, 5 AS rate, 6 AS amount, NULL::INT AS bill, NULL::INT AS section, '' AS hierarchy FROM part")
def nr6(spark, d):
    h = X.resolve_headers(X.demo_cells(table(spark, d, "part"), hierarchical=False))
    return h.withColumn("hierarchy", F.array_join(F.col("hierarchy").cast("array<string>"), ","))


#: The demo cells of each sheet, counted.
PROFILE = f"""WITH s AS (SELECT {BOOK}, count(*) AS n, count(*) FILTER (p_retailprice > 0) AS p, max(p_partkey) + 1 AS last, count(*) FILTER (p_size % 4 = 0) AS formulas, count(*) FILTER (p_size % 7 = 0 AND p_size % 4 <> 0) AS broken,
  count(*) FILTER (p_size % 6 = 0) AS arabic, round(sum(p_size * p_retailprice::DECIMAL(18,2)::DOUBLE), 2) AS value FROM part GROUP BY ALL)"""


@query("sc4_ag12_workbook_profile", PROFILE + " SELECT workbook, sheet, (n + 1)::BIGINT AS rows, p::BIGINT AS priced, last::BIGINT AS estimated, 'Amount, Description, Item, Qty, Unit, Unit Rate' AS headers, false AS metadata FROM s")
def sc4(spark, d):
    return X.profile(X.demo_cells(table(spark, d, "part"), hierarchical=False)).withColumn("headers", F.array_join("headers", ", "))


@query("sc7_ag23_preflight", """SELECT 'W' || (p_partkey % 3) AS workbook, true AS header, 0::BIGINT AS bill_rows, 'FailedCorrupted' AS status, count(DISTINCT p_type) AS sheets, count(DISTINCT p_type) FILTER (starts_with(lower(p_type), 'bill')) AS bill_sheets, 0::BIGINT AS ps_sheets FROM part GROUP BY ALL""")
def sc7(spark, d):
    return X.preflight(X.demo_cells(table(spark, d, "part"), hierarchical=False))


@query("sc7_ag23_verdicts", """WITH p AS (SELECT *, p_partkey AS k, 'S' || (p_partkey % 3) AS source, 'T' || (p_partkey % 2) AS target FROM part), r AS (SELECT DISTINCT CASE WHEN k % 7 = 0 THEN 'S9' ELSE source END AS source, target FROM p),
a AS (SELECT source, source <> 'S2' AS header, count(*) FILTER (k % 3 <> 1 AND k % 4 <> 0) AS n FROM p GROUP BY source), b AS (SELECT target, count(DISTINCT sheet) AS sheets, count(DISTINCT sheet) FILTER (sheet LIKE '%Provisional Sum') AS ps FROM (SELECT target, CASE WHEN k % 2 = 1 THEN 'Bill ' || (k % 3) WHEN k % 24 = 6 THEN 'Bill 6 Provisional Sum' ELSE 'Bill ' || (k % 24) END AS sheet FROM p) GROUP BY target)
SELECT source, target, CASE WHEN n > 0 THEN 'Passed' ELSE 'FailedCorrupted' END AS status, concat_ws('; ', CASE WHEN header IS NOT NULL THEN 'source opened' END, CASE WHEN header THEN 'source headings' END, CASE WHEN n > 0 THEN n || ' rows of bills' END, 'target opened', CASE WHEN sheets >= 10 THEN sheets || ' bill sheets' END, CASE WHEN ps > 0 THEN ps || ' sheets of provisional sums' END) AS passed,
  concat_ws('; ', CASE WHEN NOT header THEN 'source headings not met' END, CASE WHEN sheets < 10 THEN 'only ' || sheets || ' bill sheets' END, CASE WHEN ps = 0 THEN 'no sheet of provisional sums' END) AS warnings, CASE WHEN header IS NULL THEN 'source not found' WHEN n = 0 THEN 'source without rows of bills' ELSE '' END AS errors, coalesce(n, 0) AS source_rows, sheets AS target_sheets FROM r LEFT JOIN a USING (source) JOIN b USING (target)""")
def sc7_verdicts(spark, d):
    """Sources that pass, lack bills, lack headings or are not there, against targets with many and few bill sheets."""
    cells, runs = X.demo_runs(table(spark, d, "part"))
    v = X.preflight_verdict(runs, X.preflight(cells))
    return v.withColumns({k: F.array_join(k, "; ") for k in ("passed", "warnings", "errors")})


@query("ag29_output_audit", PROFILE + " SELECT workbook, sheet, p::BIGINT AS rates, value, formulas, broken, arabic AS arabic_digits FROM s")
def ag29(spark, d):
    return X.output_audit(X.demo_cells(table(spark, d, "part"), hierarchical=False)).withColumn("value", F.round("value", 2))


@query("ag25_discovery_counters", over_base("SELECT count(DISTINCT sheet) AS tables, count(DISTINCT sheet) FILTER (s_id IS NOT NULL) AS linked, count(DISTINCT sheet) FILTER (item_type = 'ProvisionalSum') AS shielded FROM pairs"))
def ag25(spark, d):
    return pairs(spark, d).agg(F.count_distinct("sheet").alias("tables"), F.count_distinct(F.when(F.col("s_id").isNotNull(), F.col("sheet"))).alias("linked"), F.count_distinct(F.when(F.col("item_type") == "ProvisionalSum", F.col("sheet"))).alias("shielded"))
