"""The match bill by bill and across bills, and the matches of linked sheets and of workbooks."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import bills as B
from ..operators import matching as M
from ..operators import reconcile as C
from .adapters import BASE, over_base, part_targets, source_items, table, target_items
from .queries_match import EDGES, FITNESS, HYBRID, KEYS, PAIR, PREP, SCORES, class_edges, compat_sql, scoped_pairs
from .queries_scalar import TAG_SQL, fold_sql
from .registry import query

def over_base_recursive(sql: str) -> str:
    return over_base(sql).replace("WITH ", "WITH RECURSIVE ", 1)


PHRASE = "concat(case when {k} % 4 = 0 then 'Supply of ' when {k} % 4 = 1 then 'Supply and install ' when {k} % 4 = 2 then 'Installation of ' else '' end, {t})"


def bill_targets(spark, d):
    """The lines of a part together; some misspelt, some under a name of their own, a like one or one that all sources share."""
    t = part_targets(spark, d).withColumnRenamed("rate", "own")
    return t.selectExpr(
        "part as t", "cast(part as bigint) as pos", "case when part % 10 = 0 then 'Works W1' when part % 6 = 0 then 'Extra items' when part % 7 = 0 then concat(bill, ' ', code, ' b') else concat(bill, ' ', code) end as bill",
        "concat('Works W', cast(part % 3 as string), '.xlsx') as book", "'' as path", "'' as section", "code", "cast(part % 50 as string) as serial",
        PHRASE.format(k="case when part % 13 = 0 then 3 else part end", t="case when part % 13 = 0 then translate(concat(description, ' plus fittings'), 'aeiouls', 'eiouxyz') else concat(description, ' plus fittings') end") + " as description", "'' as line",
        "case when part % 13 = 0 then '' else unit end as unit", "case when part % 4 = 1 then cast(10 + size as decimal(18,4)) else quantity end as quantity", "case when part % 5 = 0 or part % 13 = 0 then null when part % 11 = 0 then cast(0 as decimal(18,4)) else own end as rate", "case when part % 17 = 0 then 'ProvisionalSum' else 'Normal' end as item_type",
    ).withColumn("sheet", F.col("bill"))


def bill_sources(spark, d):
    """The parts; a third without a rate, of which some are ignored scope."""
    s = source_items(spark, d).join(table(spark, d, "part").selectExpr("p_partkey as s_id", "p_size"), "s_id")
    return s.selectExpr(
        "s_id as s", "cast(s_id as bigint) as pos", "concat(s_bill, ' ', s_code) as bill", "'' as book", "concat('Works W1/', s_bill, ' ', s_code) as path", "'' as section", "s_code as code", "cast(s_id % 50 as string) as serial",
        "concat(" + PHRASE.format(k="s_id", t="concat(s_description, ' plus fittings')") + ", case when p_size % 3 = 0 and s_id % 9 = 0 then ' ignored' else '' end) as description", "'' as line", "s_unit as unit", "s_quantity as quantity",
        "case when p_size % 3 <> 0 then s_rate end as rate", "cast(null as decimal(18,4)) as original",
    ).withColumn("sheet", F.col("bill"))


D_PHRASE = "CASE WHEN {k} % 4 = 0 THEN 'Supply of ' WHEN {k} % 4 = 1 THEN 'Supply and install ' WHEN {k} % 4 = 2 THEN 'Installation of ' ELSE '' END || {t}"
BILL_ITEMS = f"""tt AS (SELECT '' AS scope, part AS t, upper(regexp_replace(code, '[^A-Za-z0-9]', '', 'g')) AS t_code, CASE WHEN part % 13 = 0 THEN '' ELSE unit END AS t_unit,
  CASE WHEN part % 10 = 0 THEN 'Works W1' WHEN part % 6 = 0 THEN 'Extra items' WHEN part % 7 = 0 THEN bill || ' ' || code || ' b' ELSE bill || ' ' || code END AS t_bill, CASE WHEN part % 4 = 1 THEN (10 + size)::DECIMAL(18,4) ELSE sum(quantity)::DECIMAL(18,4) END AS t_quantity,
  CASE WHEN part % 5 = 0 OR part % 13 = 0 THEN NULL WHEN part % 11 = 0 THEN 0::DECIMAL(18,4) ELSE min(original_rate) END AS t_rate, part % 17 = 0 AS guarded, {D_PHRASE.format(k="(CASE WHEN part % 13 = 0 THEN 3 ELSE part END)", t="CASE WHEN part % 13 = 0 THEN translate(description || ' plus fittings', 'aeiouls', 'eiouxyz') ELSE description || ' plus fittings' END")} AS t_raw
  FROM target_items GROUP BY part, code, description, unit, bill, size),
ss AS (SELECT '' AS scope, s_id AS s, row_number() OVER (ORDER BY s_id) - 1 AS s_pos, upper(regexp_replace(s_code, '[^A-Za-z0-9]', '', 'g')) AS s_code, s_unit, s_bill || ' ' || s_code AS s_bill, s_quantity, CASE WHEN p_size % 3 <> 0 THEN s_rate ELSE 0::DECIMAL(18,4) END AS s_rate,
  {D_PHRASE.format(k="s_id", t="s_description || ' plus fittings'")} || CASE WHEN p_size % 3 = 0 THEN ' ignored' ELSE '' END AS s_raw FROM source_items JOIN part ON s_id = p_partkey WHERE p_size % 3 <> 0 OR s_id % 9 = 0)"""
SMALL, POOL = B.SMALL_BILL, B.POOL


def serial_sql(name: str, lists: str) -> str:
    """Targets of ``lists`` (scope, idx, t, pooled, c: candidates in the order of a pool) one after another, each with what no earlier one took."""
    best = f"""list_sort(list_transform(list_filter(CASE WHEN l.pooled THEN list_filter(l.c, lambda x: NOT list_contains(r.taken, x.s))[1:{POOL}] ELSE list_filter(l.c, lambda x: NOT list_contains(r.taken, x.s)) END, lambda x: x.counts),
      lambda x: {{a: -x.fit, b: CASE WHEN l.pooled THEN -x.hits ELSE 0 END, c: x.s_pos, s: x.s, score: x.score, takes: x.takes}}))[1]"""
    return f"""{name}(scope, i, taken, t, s, score, takes) AS (SELECT DISTINCT scope, 0::BIGINT, []::BIGINT[], NULL::BIGINT, NULL::BIGINT, NULL::DOUBLE, NULL::BOOLEAN FROM {lists}
  UNION ALL SELECT scope, idx, CASE WHEN best.takes THEN list_append(taken, best.s) ELSE taken END, t, best.s, best.score, best.takes FROM (SELECT r.scope, l.idx, r.taken, l.t, {best} AS best FROM {name} r JOIN {lists} l ON l.scope = r.scope AND l.idx = r.i + 1))"""


CANDIDATE = "list({s: s, s_pos: s_pos, hits: hits, fit: fit, score: score, takes: approved, counts: counts} ORDER BY hits DESC, s_pos)"
BILLS_SQL = f"""WITH RECURSIVE {BASE}, {BILL_ITEMS},
{PREP},
filed AS (SELECT s, s_pos, 0 AS p0, {KEYS.format(x="s_bill")} AS key FROM ss UNION ALL SELECT s, s_pos, 1, 'worksw1' FROM ss), made AS (SELECT key, min({{p: s_pos, a: p0}}) AS made, count(*) AS n FROM filed GROUP BY key),
tk AS (SELECT t, {KEYS.format(x="t_bill")} AS key, row_number() OVER (PARTITION BY {KEYS.format(x="t_bill")} ORDER BY t) - 1 AS nth, count(*) OVER (PARTITION BY {KEYS.format(x="t_bill")}) AS many FROM tt),
ta AS (SELECT k AS a, {TAG_SQL} AS ta FROM (SELECT k, {fold_sql("k", T.TAG_ORDINALS)} AS t FROM (SELECT DISTINCT key AS k FROM tk WHERE key NOT IN (SELECT key FROM made)))),
tb AS (SELECT k AS b, made, {TAG_SQL} AS tb FROM (SELECT k, made, {fold_sql("k", T.TAG_ORDINALS)} AS t FROM (SELECT key AS k, made FROM made))),
links AS (SELECT key AS bill, key FROM made UNION ALL SELECT a, arg_min(b, {{m: made, b: b}}) FROM ta, tb WHERE contains(a, b) OR contains(b, a) OR (ta <> '' AND ta = tb) OR 1 - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b)) >= 0.7 GROUP BY a),
inside AS MATERIALIZED (SELECT t, tk.key AS bill, links.key, n, nth::DOUBLE / many AS ratio FROM tk JOIN links ON tk.key = links.bill JOIN made ON made.key = links.key JOIN tt USING (t) WHERE NOT guarded),
shared AS MATERIALIZED (SELECT t, s, count(*) AS hits FROM (SELECT t, t_unit, unnest(t_tokens) AS w FROM tp) JOIN (SELECT s, s_unit, unnest(s_tokens) AS w FROM sp) USING (w) GROUP BY t, s, t_unit, s_unit HAVING count(*) >= 2 OR {compat_sql("t_unit", "s_unit")}),
small AS MATERIALIZED (SELECT t, s FROM inside JOIN filed USING (key) WHERE n <= {SMALL}),
cand AS (SELECT t, s FROM shared UNION SELECT t, s FROM small),
e0 AS ({PAIR} FROM cand JOIN tp USING (t) JOIN (SELECT * EXCLUDE (scope) FROM sp) USING (s)),
{SCORES},
{FITNESS},
hy AS MATERIALIZED (SELECT t, s, s_pos, round(fitness, 6) AS fit, score, approved, approved OR score >= {B.COUNTS} AS counts FROM hybrid JOIN (SELECT s, s_pos FROM ss) USING (s)),
eb AS (SELECT bill AS scope, t, s, s_pos, hits, pooled, fit + round((1 - abs(ratio - s_pos::DOUBLE / n)) * 15, 6) AS fit, score, approved, counts FROM (SELECT t, s, 0 AS hits, false AS pooled FROM small UNION ALL SELECT t, s, hits, true FROM inside JOIN filed USING (key) JOIN shared USING (t, s) WHERE n > {SMALL}) JOIN hy USING (t, s) JOIN inside USING (t) WHERE counts OR pooled),
lb AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY t) AS idx FROM (SELECT scope, t, any_value(pooled) AS pooled, {CANDIDATE} AS c FROM eb GROUP BY scope, t)),
{serial_sql("rb", "lb")},
own AS MATERIALIZED (SELECT t, s, score FROM rb WHERE takes),
ea AS (SELECT '' AS scope, t, s, s_pos, hits, true AS pooled, fit, score, approved, counts FROM shared JOIN hy USING (t, s) JOIN tt USING (t) WHERE NOT guarded AND t NOT IN (SELECT t FROM own) AND s NOT IN (SELECT s FROM own)),
la AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY t) AS idx FROM (SELECT scope, t, any_value(pooled) AS pooled, {CANDIDATE} AS c FROM ea GROUP BY scope, t)),
{serial_sql("ra", "la")},
got AS (SELECT t, s, score, 'bill' AS how FROM own UNION ALL SELECT t, s, score, CASE WHEN takes THEN 'across' ELSE 'review' END FROM ra WHERE s IS NOT NULL),
fin AS (SELECT tt.t, got.s, got.score, s_rate::DOUBLE AS s_rate, t_rate::DOUBLE AS own, CASE WHEN guarded THEN 'ProvisionalSum' ELSE 'Normal' END AS kind,
  CASE WHEN guarded THEN 'protected' WHEN how IN ('bill', 'across') THEN how WHEN t_rate > 0 THEN 'baseline' WHEN t_rate = 0 THEN 'zero' WHEN score >= {B.REVIEW} THEN 'review' ELSE 'new' END AS how FROM tt LEFT JOIN got USING (t) LEFT JOIN (SELECT s, s_rate FROM ss) USING (s)),
res AS (SELECT t, CASE WHEN how IN ('bill', 'across', 'review') THEN s END AS s, CASE WHEN how IN ('bill', 'across', 'review') THEN s_rate WHEN how IN ('baseline', 'zero') THEN own END AS rate,
  round(CASE WHEN how IN ('baseline', 'zero', 'protected') THEN 1.0 WHEN how = 'new' THEN 0.0 ELSE score END, 6)::DOUBLE AS score,
  CASE WHEN how IN ('baseline', 'zero', 'protected') THEN 'Exact' WHEN how = 'review' THEN 'ManualReviewNeeded' WHEN how = 'new' THEN 'Unmatched' WHEN score >= {B.EXACT} THEN 'Exact' ELSE 'HighFuzzy' END AS confidence,
  CASE WHEN how = 'new' THEN 'VariationOrder' ELSE kind END AS item_type, how NOT IN ('review', 'new') AS approved, how FROM fin)"""


@query("jn10_bill_match", BILLS_SQL + " SELECT * FROM res")
def jn10(spark, d):
    out = B.match_by_bill(bill_targets(spark, d), bill_sources(spark, d))
    return out.withColumn("score", F.round("score", 6))


def greedy_sql(p: str, edges: str) -> str:
    """CTEs ending in {p}_a (run, t, s, weight): the greedy choice of ``edges`` in rounds, then its free edges one after another."""
    order = "{w: -weight, t: t, s: s}"
    return f"""{p}_g AS (SELECT run, t, s, weight, false AS won FROM {edges} UNION ALL
  SELECT run, t, s, weight, a = o AND b = o FROM (SELECT *, {order} AS o, min({order}) OVER (PARTITION BY run, t) AS a, min({order}) OVER (PARTITION BY run, s) AS b FROM (SELECT *, bool_or(won) OVER (PARTITION BY run, t) AS x, bool_or(won) OVER (PARTITION BY run, s) AS y FROM {p}_g) WHERE NOT x AND NOT y)),
{p}_w AS MATERIALIZED (SELECT run, t, s, weight FROM {p}_g WHERE won),
{p}_spare AS MATERIALIZED (SELECT run, h.s, any_value(h.t) AS h, any_value(h.weight) AS hw, list({{w: -e.weight, s: e.s}} ORDER BY -e.weight, e.s) AS o FROM {p}_w h JOIN {edges} e USING (run, t) WHERE (run, e.s) NOT IN (SELECT run, s FROM {p}_w) GROUP BY run, h.s),
{p}_f AS MATERIALIZED (SELECT run, t, s, weight, h, hw, o, row_number() OVER (PARTITION BY run ORDER BY weight DESC, t, s) AS idx FROM {edges} JOIN {p}_spare USING (run, s) WHERE (run, t) NOT IN (SELECT run, t FROM {p}_w) AND weight - o[1].w > hw + 0.05),
{p}_r(run, i, ts, ss, moved, t, s, weight, h, s2, w2) AS (SELECT DISTINCT run, 0::BIGINT, []::BIGINT[], []::BIGINT[], []::BIGINT[], NULL::BIGINT, NULL::BIGINT, NULL::DOUBLE, NULL::BIGINT, NULL::BIGINT, NULL::DOUBLE FROM {p}_f UNION ALL
  SELECT run, idx, CASE WHEN go THEN list_append(ts, t) ELSE ts END, CASE WHEN go THEN list_append(ss, s) ELSE ss END, CASE WHEN go THEN list_append(moved, n.s) ELSE moved END, CASE WHEN go THEN t END, s, weight, h, n.s, -n.w
  FROM (SELECT *, coalesce(NOT list_contains(ts, t) AND NOT list_contains(ss, s) AND weight - n.w > hw + 0.05, false) AS go FROM (SELECT r.run, r.ts, r.ss, r.moved, f.idx, f.t, f.s, f.weight, f.h, f.hw, list_filter(f.o, lambda x: NOT list_contains(r.moved, x.s))[1] AS n FROM {p}_r r JOIN {p}_f f ON f.run = r.run AND f.idx = r.i + 1))),
{p}_a AS MATERIALIZED (SELECT * FROM {p}_w WHERE (run, t) NOT IN (SELECT run, h FROM {p}_r WHERE t IS NOT NULL) UNION ALL SELECT run, t, s, weight FROM {p}_r WHERE t IS NOT NULL UNION ALL SELECT run, h, s2, w2 FROM {p}_r WHERE t IS NOT NULL)"""


@query("jn8_scoped_assignment", over_base_recursive(EDGES + ", x AS MATERIALIZED (SELECT scope AS run, t, s, weight FROM edges WHERE weight >= 0.525), " + greedy_sql("x", "x") + " SELECT run AS scope, t, s, weight FROM x_a WHERE weight >= 0.75"))
def jn8_scoped(spark, d):
    e, t, s = class_edges(spark, d)
    return M.assign_scoped_classes(e.where("weight >= 0.525"), t, s).where("weight >= 0.75")


@query("jn8_greedy_assignment", over_base_recursive(EDGES + ", x AS MATERIALIZED (SELECT 0 AS run, t, s, weight FROM edges WHERE weight >= 0.525), " + greedy_sql("x", "x") + " SELECT t, s, weight FROM x_w"))
def jn8(spark, d):
    e, t, s = class_edges(spark, d)
    return M.assign_greedy_classes(e.where("weight >= 0.525"), t, s).select("t", "s", "weight")


JN9_SQL = over_base_recursive(HYBRID + f""", ed AS (SELECT scope, t, s, fitness, percent_rank() OVER (PARTITION BY scope ORDER BY t) AS tpos, percent_rank() OVER (PARTITION BY scope ORDER BY s) AS s_pos FROM hybrid WHERE approved OR score >= 0.6),
l AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY t) AS idx FROM (SELECT scope, t, false AS pooled, list({{s: s, s_pos: s_pos, hits: 0, fit: round(fitness + (1 - abs(tpos - s_pos)) * 15, 6), score: 0, takes: true, counts: true}} ORDER BY s_pos, s) AS c FROM ed GROUP BY scope, t)),
""" + serial_sql("r", "l") + " SELECT scope, t, s FROM r WHERE s IS NOT NULL")


@query("jn9_wn5_ordered_assignment", JN9_SQL)
def jn9(spark, d):
    p, t, s = scoped_pairs(spark, d)
    e = M.with_hybrid(p).where("h.approved or h.score >= 0.6").select("scope", "t", "s", F.col("h.fitness").alias("weight"))
    return M.assign_in_order_classes(e, t, s).drop("fit")


def adaptive_sql(p: str, targets: str, sources: str) -> str:
    """CTEs ending in {p}_m (run, t, s, weight, fast).  targets: run, scope, t and t_ columns, guarded; sources: scope, s and s_ columns."""
    scores = re.sub(r"\be([012])\b", rf"{p}_e\1", SCORES)
    w = [f"CASE WHEN codes AND NOT quantities THEN {o} WHEN NOT codes AND quantities THEN {b} ELSE {d} END" for d, b, o in zip(*(M.WEIGHTS[k] for k in ("default", "no_codes", "one_quantity")))]
    return f"""{p}_first AS (SELECT scope, s_code, s_tokens, s_quantity, s_dim, s_scope, min(s) AS s FROM {sources} GROUP BY ALL),
{p}_fast AS MATERIALIZED (SELECT run, t, f.s FROM {targets} x JOIN {p}_first f ON x.scope = f.scope AND t_code = s_code AND t_tokens = s_tokens AND t_quantity = s_quantity AND t_dim = s_dim AND t_scope = s_scope WHERE NOT guarded),
{p}_rest AS MATERIALIZED (SELECT * FROM {targets} WHERE NOT guarded AND (run, t) NOT IN (SELECT run, t FROM {p}_fast)),
{p}_shape AS (SELECT run, bool_or(t_code <> '') AS codes, min(t_quantity) <> max(t_quantity) AS quantities FROM {targets} GROUP BY run),
{p}_n AS MATERIALIZED (SELECT scope, count(*) AS n FROM {sources} GROUP BY scope), {p}_tok AS MATERIALIZED (SELECT scope, s, unnest(s_tokens) AS w FROM {sources}),
{p}_df AS (SELECT scope, w, CASE WHEN n > 20 AND count(*) > floor(n * {M.COMMON_SHARE}) THEN {M.W_COMMON} WHEN count(*) <= {M.RARE} THEN {M.W_RARE} ELSE {M.W_TOKEN} END AS v FROM {p}_tok JOIN {p}_n USING (scope) GROUP BY scope, w, n),
{p}_t AS MATERIALIZED (SELECT DISTINCT scope, t, t_tokens, t_code, t_dim FROM {p}_rest),
{p}_hit AS (SELECT scope, t, s, sum(v) AS h FROM (SELECT scope, t, s, v FROM (SELECT scope, t, unnest(t_tokens) AS w FROM {p}_t) JOIN {p}_df USING (scope, w) JOIN {p}_tok USING (scope, w) UNION ALL SELECT scope, t, s, {M.W_CODE} FROM {p}_t JOIN {sources} USING (scope) WHERE t_code = s_code AND t_code <> '') JOIN {p}_n USING (scope) WHERE n > {M.TOP} GROUP BY scope, t, s),
{p}_rank AS (SELECT scope, t, s, row_number() OVER (PARTITION BY scope, t ORDER BY h + CASE WHEN t_dim <> 'Unknown' AND t_dim = s_dim THEN {M.W_DIMENSION} ELSE 0 END DESC, s) AS r FROM {p}_hit JOIN {p}_t USING (scope, t) JOIN {sources} USING (scope, s)),
{p}_pool AS (SELECT scope, t, s, row_number() OVER (PARTITION BY scope, t ORDER BY s) AS r FROM {p}_t JOIN {sources} USING (scope) JOIN {p}_n USING (scope) WHERE n > {M.TOP} AND t_dim = s_dim AND t_dim <> 'Unknown' AND (scope, t) NOT IN (SELECT scope, t FROM {p}_hit)),
{p}_cand AS MATERIALIZED (SELECT scope, t, s FROM {p}_rank WHERE r <= {M.TOP} UNION ALL SELECT scope, t, s FROM {p}_pool WHERE r <= {M.TOP} UNION ALL SELECT scope, t, s FROM {p}_t JOIN {sources} USING (scope) JOIN {p}_n USING (scope) WHERE n <= {M.TOP}),
{p}_e0 AS ({PAIR} FROM {p}_cand JOIN {p}_rest USING (scope, t) JOIN {sources} USING (scope, s)),
{scores},
{p}_x AS MATERIALIZED (SELECT * FROM (SELECT run, t, s, round(least(1.0, (CASE WHEN t_code <> '' AND s_code <> '' THEN w0 * cs + w1 * ds ELSE (w0 + w1) * ds END + w2 * us + w3 * qs + w4 * ps + CASE WHEN cs >= 0.95 AND ds >= 0.40 THEN 0.20 ELSE 0 END) * m)::DOUBLE, 8) AS weight
  FROM (SELECT *, {", ".join(f"{x} AS w{i}" for i, x in enumerate(w))} FROM {p}_e2 JOIN {p}_shape USING (run))) WHERE weight >= {C.SENSITIVITY * C.EDGE}),
{greedy_sql(p, p + "_x")},
{p}_m AS MATERIALIZED (SELECT run, t, s, 1.0::DOUBLE AS weight FROM {p}_fast UNION ALL SELECT run, t, s, weight FROM {p}_a WHERE weight >= {C.SENSITIVITY})"""


#: What a match becomes (without its rate); m: run, t, s, weight, guarded, own.
OUTCOME = f"""CASE WHEN guarded OR (s IS NULL AND own IS NOT NULL) THEN 1.0 ELSE coalesce(weight, 0.0) END::DOUBLE AS score, CASE WHEN guarded OR weight >= {C.EXACT} THEN 'Exact' WHEN s IS NOT NULL THEN 'HighFuzzy' WHEN own IS NULL THEN 'VariationOrder' ELSE 'Exact' END AS confidence,
  CASE WHEN guarded THEN 'ProvisionalSum' WHEN s IS NULL AND own IS NULL THEN 'VariationOrder' ELSE 'Normal' END AS item_type, guarded OR s IS NOT NULL OR own IS NOT NULL AS approved"""
SOURCE_ROWS = "sa AS MATERIALIZED (SELECT * EXCLUDE (scope) FROM sp)"


def adaptive_targets(spark, d):
    return bill_targets(spark, d).withColumn("currency", F.lit("EGP"))


def adaptive_sources(spark, d):
    return bill_sources(spark, d).select("s", "code", "description", "unit", "quantity", "rate", "original", F.lit("EGP").alias("currency"), F.element_at(F.split("bill", " "), 1).alias("bill"), F.col("code").alias("sheet"))


@query("jn12_jn13_linked_sheets", over_base_recursive(f""", {BILL_ITEMS},
{PREP}, {SOURCE_ROWS},
link AS (SELECT sheet, k, CASE WHEN k % 7 = 0 THEN 'ShieldedPS' WHEN k % 11 = 0 THEN 'Excluded' ELSE 'AutoMatched' END AS status FROM (SELECT DISTINCT code AS sheet, substr(code, 7)::INTEGER AS k FROM target_items)),
name AS (SELECT s_id AS s, lower(s_code) AS name FROM source_items UNION SELECT s_id, lower(s_bill) FROM source_items), nm AS (SELECT DISTINCT name FROM name JOIN sa USING (s)),
scp AS MATERIALIZED (SELECT sheet, name FROM link JOIN nm ON CASE k % 4 WHEN 0 THEN name = lower(sheet) WHEN 2 THEN name = 'promo' WHEN 3 THEN contains(name, '#' || k) ELSE false END WHERE status = 'AutoMatched'),
src AS MATERIALIZED (SELECT '' AS scope, * FROM sa UNION ALL SELECT scope, sa.* FROM (SELECT DISTINCT sheet AS scope, s FROM scp JOIN name USING (name)) JOIN sa USING (s)),
al AS MATERIALIZED (SELECT * FROM src WHERE scope = ''),
tg AS MATERIALIZED (SELECT * REPLACE (CASE WHEN sheet IN (SELECT sheet FROM scp) THEN sheet ELSE '' END AS scope, guarded OR status = 'ShieldedPS' AS guarded), sheet AS run, t_rate AS own FROM tp JOIN (SELECT DISTINCT part AS t, code AS sheet FROM target_items) USING (t) JOIN link USING (sheet)),
go AS MATERIALIZED (SELECT * FROM tg WHERE status <> 'Excluded'),
{adaptive_sql("p", "go", "src")},
ag AS MATERIALIZED (SELECT * REPLACE ('' AS scope) FROM go WHERE scope <> '' AND NOT guarded AND (run, t) NOT IN (SELECT run, t FROM p_m)),
{adaptive_sql("q", "ag", "al")},
m AS (SELECT go.run, go.t, coalesce(p_m.s, q_m.s) AS s, coalesce(p_m.weight, q_m.weight) AS weight, guarded, own, CASE WHEN p_m.s IS NOT NULL AND scope <> '' THEN 'linked' WHEN coalesce(p_m.s, q_m.s) IS NOT NULL THEN 'all' END AS found FROM go LEFT JOIN p_m ON go.run = p_m.run AND go.t = p_m.t LEFT JOIN q_m ON go.run = q_m.run AND go.t = q_m.t)
SELECT run AS sheet, t, s, {OUTCOME}, found FROM m UNION ALL SELECT run, t, NULL, 0.0, 'Unmatched', 'VariationOrder', false, NULL FROM tg WHERE status = 'Excluded'"""))
def jn12(spark, d):
    """Sheets by code, linked to the source sheet of that code, to a bill, by the code alone, or to all; some shielded, some excluded."""
    t = adaptive_targets(spark, d).withColumn("sheet", F.col("code"))
    k = F.expr("try_cast(substring(sheet, 7) as int)")
    to = F.when(k % 4 == 0, F.concat(F.lit("[W1.xlsx] "), "sheet")).when(k % 4 == 1, "Global search").when(k % 4 == 2, "PROMO").otherwise("no such sheet")
    links = t.select("sheet").distinct().select("sheet", F.when(k % 7 == 0, "ShieldedPS").when(k % 11 == 0, "Excluded").otherwise("AutoMatched").alias("status"), to.alias("s_sheet"), F.when(k % 4 == 3, F.concat(F.lit("#"), k.cast("string"))).otherwise("-").alias("code"))
    return C.reconcile_linked(t, adaptive_sources(spark, d), links).drop("rate")


def workbook_targets(spark, d):
    """Items of three workbooks: a part's lines in each."""
    lines = target_items(spark, d).select(F.col("part").alias("t"), "workbook").distinct()
    return adaptive_targets(spark, d).join(lines, "t")


WORKBOOKS = over_base_recursive(f""", {BILL_ITEMS},
{PREP}, al AS MATERIALIZED (SELECT * FROM sp),
go AS MATERIALIZED (SELECT *, workbook AS run, t_rate AS own FROM tp JOIN (SELECT DISTINCT part AS t, workbook FROM target_items) USING (t)),
{adaptive_sql("p", "go", "al")},
m AS (SELECT go.run, go.t, p_m.s, p_m.weight, guarded, own FROM go LEFT JOIN p_m ON go.run = p_m.run AND go.t = p_m.t),
res AS (SELECT run AS workbook, t, s, {OUTCOME} FROM m)""")


@query("jn16_workbooks", WORKBOOKS + " SELECT * FROM res")
def jn16(spark, d):
    return C.reconcile_workbooks(workbook_targets(spark, d), adaptive_sources(spark, d)).drop("rate")


@query("ag1_ag2_ag30_matched_workbooks", WORKBOOKS + """, r AS (SELECT workbook, t, s, confidence, item_type, approved FROM res),
per AS (SELECT workbook, count(*) AS total, count(*) FILTER (confidence = 'Exact') AS exact, count(*) FILTER (confidence = 'HighFuzzy') AS high_fuzzy, count(*) FILTER (item_type = 'VariationOrder') AS vo, count(*) FILTER (item_type = 'ProvisionalSum') AS ps, count(s) AS matched, count(DISTINCT s) AS sources FROM r GROUP BY ROLLUP (workbook))
SELECT coalesce(workbook, 'All workbooks') AS workbook, total, exact, high_fuzzy, vo, ps, matched, sources, round_even(matched * 100.0 / total, 1)::DOUBLE AS matched_pct FROM per""")
def ag_matched(spark, d):
    """The batch's report over real matches: a line for each workbook and the grand line."""
    r = C.reconcile_workbooks(workbook_targets(spark, d), adaptive_sources(spark, d))
    kind = lambda c, v: F.count_if(F.col(c) == v)
    per = r.rollup("workbook").agg(F.count("*").alias("total"), kind("confidence", "Exact").alias("exact"), kind("confidence", "HighFuzzy").alias("high_fuzzy"), kind("item_type", "VariationOrder").alias("vo"), kind("item_type", "ProvisionalSum").alias("ps"), F.count("s").alias("matched"), F.count_distinct("s").alias("sources"))
    return per.select(F.coalesce("workbook", F.lit("All workbooks")).alias("workbook"), "total", "exact", "high_fuzzy", "vo", "ps", "matched", "sources", F.bround((F.col("matched") * 100.0 / F.col("total")).cast("double"), 1).alias("matched_pct"))
