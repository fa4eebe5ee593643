"""Queries of the scalar rules (normalisation, predicates) over texts made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from .adapters import over_base, source_items, table, target_items
from .registry import query


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lst(words) -> str:
    return "(" + ",".join(map(q, words)) + ")"


# Cells as they occur in workbooks, one form per part.
RAW_FORMS = ["'EGP ' || p", "p || ' ج.م'", "replace(p, '.', ',')", "'#REF!'", "'Rate only'", "translate(p, '0123456789', '٠١٢٣٤٥٦٧٨٩')", "'-'", "'1,2' || substr(p, 1, 2)", "'$ ' || p || ' %'", "'بند محمل'", "'1,234.5' || substr(p, 1, 1)", "''"]
RAW = "CASE k % 12 " + " ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(RAW_FORMS)) + " END"
CENTS = "CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS STRING)"


def raw_cells(spark, d):
    return table(spark, d, "part").selectExpr("p_partkey AS k", f"{CENTS} AS p").selectExpr("k", f"{RAW} AS raw")


D_RAW = f"raw AS (SELECT k, {RAW} AS raw FROM (SELECT p_partkey AS k, p_retailprice::DECIMAL(18,2)::VARCHAR AS p FROM part))"


@query(
    "nr1_parse_decimal",
    f"""WITH {D_RAW}, a AS (SELECT k, trim(raw) AS s, trim(regexp_replace(translate(trim(raw), {q(T.DIGITS[0])}, {q(T.DIGITS[1])}), {q(T.CURRENCY_WORDS)}, '', 'g')) AS t FROM raw),
b AS (SELECT k, s, CASE WHEN strpos(t, '.') = 0 AND length(t) - length(replace(t, ',', '')) = 1 AND (length(t) - strpos(t, ',') <> 3 OR t LIKE '0%') THEN replace(t, ',', '.') ELSE replace(t, ',', '') END AS t FROM a)
SELECT k, CASE WHEN s = '' OR regexp_matches(s, {q(T.NO_NUMBER)}) THEN 0 ELSE coalesce(TRY_CAST(t AS DECIMAL(28,8)), 0) END::DOUBLE AS value FROM b""",
)
def nr1(spark, d):
    return raw_cells(spark, d).select("k", T.parse_decimal(F.col("raw")).cast("double").alias("value"))


@query("nr2_parse_positive", f"""WITH {D_RAW}, b AS (SELECT k, TRY_CAST(trim(regexp_replace(trim(raw), '(?i)[,$£€]|EGP', '', 'g')) AS DECIMAL(28,8)) AS v FROM raw) SELECT k, CASE WHEN v > 0.00001 THEN v::DOUBLE END AS value FROM b""")
def nr2(spark, d):
    return raw_cells(spark, d).select("k", T.parse_positive(F.col("raw")).cast("double").alias("value"))


UNIT_WORDS = ["M2", " sqm", "cu.m", "متر مكعب", "lin.m", "م.ط", "nos", "عدد", "tonnes", "طن", "kgs", "L.S", "ls", "مقطوعية", "each", "month", "kVA", "", "litre", "set"]
U_SPARK = "element_at(array(" + ",".join(map(q, UNIT_WORDS)) + f"), cast(p_partkey % {len(UNIT_WORDS)} + 1 as int))"
U2_SPARK = "element_at(array(" + ",".join(map(q, UNIT_WORDS)) + f"), cast(p_size % {len(UNIT_WORDS)} + 1 as int))"
D_U = f"u AS (SELECT p_partkey AS k, [{','.join(map(q, UNIT_WORDS))}][p_partkey % {len(UNIT_WORDS)} + 1] AS a, [{','.join(map(q, UNIT_WORDS))}][p_size % {len(UNIT_WORDS)} + 1] AS b FROM part)"


def units(spark, d):
    return table(spark, d, "part").selectExpr("p_partkey AS k", f"{U_SPARK} AS a", f"{U2_SPARK} AS b")


def case_in(x: str, pairs, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} IN {lst(w)} THEN {q(k)}" for k, w in pairs) + f" ELSE {default} END"


DIM_PAIRS = [(k, v.split()) for k, v in R.DIMENSIONS.items()]
dim_sql = lambda x: case_in(f"translate(lower(trim({x})), '. ', '')", DIM_PAIRS, "'Unknown'")


@query("nr3_nr8_nr22_units", f"""WITH {D_U} SELECT k, {case_in("lower(trim(a))", R.CANON.items(), "lower(trim(a))")} AS canonical, lower(trim(a)) IN {lst(R.KNOWN_UNITS)} AS known, {dim_sql("a")} AS dimension FROM u""")
def nr3(spark, d):
    return units(spark, d).select("k", R.canonical_unit(F.col("a")).alias("canonical"), R.known_unit(F.col("a")).alias("known"), R.dimension(F.col("a")).alias("dimension"))


@query(
    "nr23_nr24_unit_compatibility",
    f"""WITH {D_U}, c AS (SELECT *, lower(trim(a)) AS x, lower(trim(b)) AS y, {dim_sql("a")} AS p, {dim_sql("b")} AS q,
  {case_in("lower(a)", R.GROUPS.items(), "NULL")} AS g, {case_in("lower(b)", R.GROUPS.items(), "NULL")} AS h FROM u)
SELECT k, CASE WHEN x = '' AND y = '' THEN 0.8 WHEN x = '' OR y = '' THEN 0.5 WHEN x = y THEN 1.0 WHEN p <> 'Unknown' AND p = q THEN 0.95
  WHEN (p = 'Count' AND q = 'LumpSum') OR (p = 'LumpSum' AND q = 'Count') THEN 0.85 ELSE 0.2 END::DOUBLE AS score,
  lower(a) = lower(b) OR a = '' OR b = '' OR coalesce(g = h, false) AS compatible FROM c""",
)
def nr23(spark, d):
    return units(spark, d).select("k", R.unit_score(F.col("a"), F.col("b")).alias("score"), R.units_compatible(F.col("a"), F.col("b")).alias("compatible"))


QTY_SQL = """CASE WHEN a = 0 AND b = 0 THEN 1.0 WHEN a = 0 OR b = 0 THEN 0.4 WHEN a = b THEN 1.0 WHEN abs(greatest(a, b)::DOUBLE / least(a, b)::DOUBLE - 1000) < 1 THEN 0.95
  WHEN (greatest(a, b)::DOUBLE - least(a, b)) / greatest(a, b) <= 0.01 THEN 0.98 WHEN (greatest(a, b)::DOUBLE - least(a, b)) / greatest(a, b) <= 0.05 THEN 0.85
  WHEN (greatest(a, b)::DOUBLE - least(a, b)) / greatest(a, b) <= 0.15 THEN 0.70 ELSE greatest(0.1, 1 - (greatest(a, b)::DOUBLE - least(a, b)) / greatest(a, b)) END"""


@query("nr25_quantity_proportion", f"WITH x AS (SELECT p_partkey AS k, (p_size % 12)::DOUBLE AS a, CASE WHEN p_partkey % 7 = 0 THEN (p_size % 12) * 1000.0 ELSE (p_partkey % 12)::DOUBLE END AS b FROM part) SELECT k, round({QTY_SQL}, 6)::DOUBLE AS score FROM x")
def nr25(spark, d):
    x = table(spark, d, "part").selectExpr("p_partkey AS k", "cast(p_size % 12 as double) AS a", "case when p_partkey % 7 = 0 then cast((p_size % 12) * 1000 as double) else cast(p_partkey % 12 as double) end AS b")
    return x.select("k", F.round(R.quantity_score(F.col("a"), F.col("b")), 6).alias("score"))


def norm_sql(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower(translate(regexp_replace({x}, {q(T.MARKS)}, '', 'g'), {q(T.FOLD[0])}, {q(T.FOLD[1])})), '[^\\p{{L}}\\p{{Nd}}\\s]', '', 'g'), '\\s+', ' ', 'g'))"


MIXED = "concat('C35/45 إنشاءَات الأولى - ', text)"


@query("nr4_nr5_nr14_nr16_normalise", f"""SELECT item_id, {norm_sql("'C35/45 إنشاءَات الأولى - ' || text")} AS description, trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{Nd}}]+', ' ', 'g')) AS cleaned,
  regexp_replace(lower(text), '[^\\p{{L}}\\p{{Nd}}]', '', 'g') AS bill_key, replace(regexp_replace(upper(replace(text, 'ß', 'ᚠ')), '[^\\p{{L}}\\p{{Nd}}]', '', 'g'), 'ᚠ', 'ß') AS code FROM benchmark""")
def nr4(spark, d):
    t = F.col("text")
    return table(spark, d, "benchmark").select("item_id", T.normalise_description(F.expr(MIXED)).alias("description"), T.clean_normalise(t).alias("cleaned"), T.bill_key(t).alias("bill_key"), T.clean_code(t).alias("code"))


SHEETS = ["Bill 01 - Summary of Earthworks", "Grand Summary", "ملخص عام للمشروع", "01 - Civil", "Bill 06.1J - 6Plex TH East PS", "الباب الثاني", "AB1-Works", "Schedule 2 Roads", "Cover", "Notes", "02A Earthworks", "Concrete no 5", "القسم الرابع", "Table of Contents", "Row Labels", "Sum of Amount", "infra works", ""]
S_SPARK = "concat(element_at(array(" + ",".join(map(q, SHEETS)) + f"), cast(p_partkey % {len(SHEETS)} + 1 as int)), case when p_size % 2 = 0 then '' else concat(' ', p_type) end)"
D_S = f"s AS (SELECT p_partkey AS k, [{','.join(map(q, SHEETS))}][p_partkey % {len(SHEETS)} + 1] || CASE WHEN p_size % 2 = 0 THEN '' ELSE ' ' || p_type END AS s FROM part)"


def sheets(spark, d):
    return table(spark, d, "part").selectExpr("p_partkey AS k", f"{S_SPARK} AS s")


FL1_SQL = f"CASE WHEN trim(s) = '' THEN true WHEN regexp_matches(lower(trim(s)), {q(R.BILL_START)}) THEN regexp_matches(lower(trim(s)), {q(R.GRAND)}) ELSE regexp_matches(lower(trim(s)), {q(R.NON_BILL)}) END"
FL2_SQL = f"(trim(s) = '' OR regexp_matches(lower(trim(s)), {q(R.NON_BILL_BROAD)}))"


@query("fl1_fl2_fl3_sheet_kinds", f"WITH {D_S} SELECT k, {FL1_SQL} AS non_bill, {FL2_SQL} AS non_bill_broad, regexp_matches(lower(s), {q(R.PIVOT)}) AS pivot FROM s")
def fl1(spark, d):
    s = F.col("s")
    return sheets(spark, d).select("k", R.non_bill(s).alias("non_bill"), R.non_bill_broad(s).alias("non_bill_broad"), R.pivot_cell(s).alias("pivot"))


def code_sql(word: str, ordinals: bool) -> str:
    o = " ".join(f"WHEN regexp_matches(s, {q(p)}) THEN {q(n)}" for n, p in T.ORDINALS) if ordinals else ""
    return f"""upper(CASE WHEN regexp_extract(s, {q(word)}, 1) <> '' THEN regexp_extract(s, {q(word)}, 1) WHEN regexp_extract(s, {q(T.BILL_FIRST)}, 1) <> '' THEN regexp_extract(s, {q(T.BILL_FIRST)}, 1)
  WHEN strpos(s, '-') > 1 AND length(trim(split_part(s, '-', 1))) <= 6 AND regexp_matches(trim(split_part(s, '-', 1)), '[0-9]') THEN trim(split_part(s, '-', 1)) {o} ELSE '-' END)"""


def fold_sql(x: str, steps) -> str:
    for a, b in steps:
        x = f"regexp_replace({x}, {q(a)}, {q(b)}, 'g')"
    return x


def noise_sql(x: str) -> str:
    for w in T.NAME_NOISE:
        x = f"replace({x}, {q(w)}, '')"
    return x


KEY_SQL = "regexp_replace(lower(s), '[^\\p{L}\\p{Nd}]', '', 'g')"
TAG_SQL = f"""CASE WHEN regexp_extract(t, {q(T.TAG_BILL)}, 1) <> '' THEN regexp_replace(regexp_extract(t, {q(T.TAG_BILL)}, 1), '^0+', '') WHEN length(regexp_extract(t, {q(T.TAG_DIGITS)}, 1)) >= 2 THEN regexp_replace(regexp_extract(t, {q(T.TAG_DIGITS)}, 1), '^0+', '')
  {" ".join(f"WHEN contains(t, {q(w)}) THEN {q(w)}" for w in T.TAG_WORDS)} ELSE '' END"""


@query(
    "nr9_nr10_nr11_nr15_sheet_codes",
    f"""WITH {D_S}, t AS (SELECT k, s, {fold_sql(KEY_SQL, T.TAG_ORDINALS)} AS t FROM s)
SELECT k, CASE WHEN {FL2_SQL} THEN '-' ELSE {code_sql(T.BILL_WORD, True)} END AS inspector_code, CASE WHEN {FL1_SQL} THEN '-' ELSE {code_sql(T.BILL_WORD_PLAIN, False)} END AS reader_code,
  trim({noise_sql("lower(s)")}) AS name, {TAG_SQL} AS tag FROM t""",
)
def nr9(spark, d):
    s = F.col("s")
    return sheets(spark, d).select("k", T.bill_code(s, ~R.non_bill_broad(s)).alias("inspector_code"), T.bill_code(s, ~R.non_bill(s), decimals=False).alias("reader_code"), T.normalise_name(s).alias("name"), T.bill_tag(T.bill_key(s)).alias("tag"))


D_PLAIN = "list_sort(list_distinct(list_transform(list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{Nd}}]+'), lambda w: length(w) > 2), lambda w: CASE WHEN length(w) >= 4 AND w LIKE 'ال%' THEN substr(w, 3) ELSE w END)))"
D_STEM1 = "CASE WHEN length(w) < 4 THEN w WHEN w LIKE 'ال%' THEN substr(w, 3) WHEN length(w) >= 5 AND (w LIKE 'وال%' OR w LIKE 'بال%') THEN substr(w, 4) WHEN length(w) >= 5 AND w LIKE 'لل%' THEN substr(w, 3) ELSE w END"
D_STEM2 = "CASE WHEN length(w) > 5 AND w LIKE '%ing' THEN w[:-4] WHEN length(w) > 6 AND w LIKE '%ation' THEN w[:-6] WHEN length(w) > 5 AND w LIKE '%ed' THEN w[:-3] WHEN length(w) > 3 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN w[:-2] ELSE w END"


def stem_sql(x: str) -> str:
    folded = f"regexp_replace(translate(regexp_replace(lower({x}), {q(T.MARKS)}, '', 'g'), 'أإآةى', 'اااهي'), '(\\p{{Nd}})(\\p{{L}})', '\\1 \\2', 'g')"
    return f"list_sort(list_distinct(list_transform(list_transform(list_filter(regexp_split_to_array({folded}, {q(T.DELIMITERS)}), lambda w: length(w) >= 2), lambda w: {D_STEM1}), lambda w: {D_STEM2})))"


@query("nr17_nr18_tokens", f"SELECT item_id, array_to_string({D_PLAIN.format(x='text')}, ' ') AS plain, array_to_string({stem_sql(chr(39) + '16mm cables ' + chr(39) + ' || text')}, ' ') AS stems FROM benchmark")
def nr17(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(T.plain_tokens(F.col("text")), " ").alias("plain"), F.array_join(T.stemmed_tokens(F.concat(F.lit("16mm cables "), "text")), " ").alias("stems"))


PHRASES = ["Supply and install", "Supply of", "Installation of", "Dismantle", "Power supply", "توريد وتركيب", "تركيب فقط", "فك وإزالة", "Supply only", "testing", "توريد", "installation kit for"]
P_SPARK = "concat(element_at(array(" + ",".join(map(q, PHRASES)) + f"), cast(p_partkey % {len(PHRASES)} + 1 as int)), ' ', p_name)"
P2_SPARK = "concat(element_at(array(" + ",".join(map(q, PHRASES)) + f"), cast(p_size % {len(PHRASES)} + 1 as int)), ' ', p_name)"


def any_sql(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(w)})" for w in words) + ")"


def scope_sql(raw: str) -> str:
    m = raw
    for a, b in R.MASK:
        m = f"replace({m}, {q(a)}, {q(b)})"
    so, io, s, i = (any_sql(m, w) for w in (R.SUPPLY_ONLY, R.INSTALL_ONLY, R.SUPPLY, R.INSTALL))
    return f"CASE WHEN {any_sql(raw, R.DISMANTLE)} THEN 'Dismantle' WHEN {so} AND NOT {io} THEN 'SupplyOnly' WHEN {io} AND NOT {so} THEN 'InstallOnly' WHEN {any_sql(m, R.DUAL)} OR ({s} AND {i}) THEN 'SupplyAndInstall' WHEN {s} THEN 'SupplyOnly' WHEN {i} THEN 'InstallOnly' ELSE 'Generic' END"


@query(
    "nr20_nr21_scopes",
    f"""WITH p AS (SELECT p_partkey AS k, lower([{",".join(map(q, PHRASES))}][p_partkey % {len(PHRASES)} + 1] || ' ' || p_name) AS a, lower([{",".join(map(q, PHRASES))}][p_size % {len(PHRASES)} + 1] || ' ' || p_name) AS b FROM part),
c AS (SELECT k, {scope_sql("a")} AS sa, {scope_sql("b")} AS sb FROM p)
SELECT k, sa AS scope_a, sb AS scope_b, CASE WHEN sa = 'Generic' OR sb = 'Generic' THEN 1.0 WHEN sa = sb THEN 1.05 WHEN sa = 'Dismantle' OR sb = 'Dismantle' THEN 0
  WHEN sa <> 'SupplyAndInstall' AND sb <> 'SupplyAndInstall' THEN 0 WHEN 'InstallOnly' IN (sa, sb) THEN 0.2 ELSE 0.5 END::DOUBLE AS multiplier FROM c""",
)
def nr20(spark, d):
    p = table(spark, d, "part").selectExpr("p_partkey AS k", f"{P_SPARK} AS a", f"{P2_SPARK} AS b").select("k", R.scope(F.col("a")).alias("scope_a"), R.scope(F.col("b")).alias("scope_b"))
    return p.withColumn("multiplier", R.scope_multiplier(F.col("scope_a"), F.col("scope_b")))


MONEY_TEXTS = ["$ 500.00", "Rate in EUR", "50,000 ج.م", "SAR 12", "درهم", "£5", "KWD", "plain", "دولار", "usd and eur €", "", "Euro"]
D_CUR = " ".join(f"WHEN regexp_matches(lower(t), {q(w)}) THEN {q(c)}" for c, w in R.CURRENCIES)
CUR_SQL = f"CASE regexp_extract(t, '[$€£]') WHEN '$' THEN 'USD' WHEN '€' THEN 'EUR' WHEN '£' THEN 'GBP' ELSE CASE {D_CUR} ELSE 'Unknown' END END"
RATE_SQL = lambda c: f"CASE {c} " + " ".join(f"WHEN {q(k)} THEN {v}" for k, v in R.RATES.items()) + " ELSE 1 END"


@query("nr26_nr27_currency", f"WITH x AS (SELECT p_partkey AS k, [{','.join(map(q, MONEY_TEXTS))}][p_partkey % {len(MONEY_TEXTS)} + 1] AS t FROM part) SELECT k, {CUR_SQL} AS detected, coalesce(nullif({CUR_SQL}, 'Unknown'), 'EGP') AS resolved FROM x")
def nr26(spark, d):
    x = table(spark, d, "part").selectExpr("p_partkey AS k", "element_at(array(" + ",".join(map(q, MONEY_TEXTS)) + f"), cast(p_partkey % {len(MONEY_TEXTS)} + 1 as int)) AS t")
    return x.select("k", R.detect_currency(F.col("t")).alias("detected"), R.resolve_currency(F.col("t")).alias("resolved"))


DRIFT_SQL = " ".join(f"WHEN abs(greatest(a, b) / least(a, b) - {R.RATES[c]}) / {R.RATES[c]} < {R.DRIFT} THEN {q(c)}" for c in R.FOREIGN)


@query(
    "nr28_nr29_nr30_conversion",
    over_base(f"""SELECT id, round(CASE WHEN s_currency <> currency THEN s_rate::DOUBLE * {RATE_SQL("s_currency")}::DOUBLE / {RATE_SQL("currency")}::DOUBLE ELSE s_rate::DOUBLE END, 4) AS converted, CASE WHEN a <= 0 OR b <= 0 THEN NULL {DRIFT_SQL} END AS drift
FROM (SELECT *, original_rate::DOUBLE AS a, s_rate::DOUBLE AS b FROM target_items JOIN source_items ON part = s_id)"""),
)
def nr28(spark, d):
    j = target_items(spark, d).join(source_items(spark, d), F.col("part") == F.col("s_id"))
    return j.select("id", F.round(R.convert(F.col("s_rate"), F.col("s_currency"), F.col("currency")), 4).alias("converted"), R.drift_currency(F.col("original_rate"), F.col("s_rate")).alias("drift"))


@query("nr32_nr33_display", """SELECT p_partkey AS k, CASE WHEN p_partkey % 702 + 1 > 26 THEN chr((64 + (p_partkey % 702) // 26)::INT) ELSE '' END || chr((65 + (p_partkey % 702) % 26)::INT) AS letter,
  split_part(p_brand, '#', 1) AS short_name, substr(regexp_replace(p_name || ' ' || p_type, '\\s+', ' ', 'g'), 1, 55) AS clean,
  array_to_string(list_transform(regexp_extract_all(p_brand || '-' || p_size, '\\d+|\\D+'), lambda x: CASE WHEN regexp_matches(x, '^\\d') THEN lpad(x, 6, '0') ELSE x END), '') AS natural FROM part""")
def nr32(spark, d):
    p = table(spark, d, "part")
    n = (F.col("p_partkey") % 702 + 1).cast("int")
    return p.select(F.col("p_partkey").alias("k"), T.column_letter(n).alias("letter"), F.split_part("p_brand", F.lit("#"), F.lit(1)).alias("short_name"), F.substring(F.regexp_replace(F.concat_ws(" ", "p_name", "p_type"), r"\s+", " "), 1, 55).alias("clean"), T.natural_key(F.concat_ws("-", "p_brand", F.col("p_size").cast("string"))).alias("natural"))


@query("fl4_metadata_rows", f"WITH {D_S} SELECT k, regexp_matches(lower(trim(CASE k % 3 WHEN 0 THEN 'Employer' WHEN 1 THEN 'Tender No.' ELSE 'A1' END)), {q(R.METADATA_CODE)}) OR regexp_matches(lower(trim(s)), {q(R.METADATA_TEXT)}) AS metadata FROM s")
def fl4(spark, d):
    return sheets(spark, d).select("k", R.metadata_row(F.expr("case k % 3 when 0 then 'Employer' when 1 then 'Tender No.' else 'A1' end"), F.col("s")).alias("metadata"))


@query("ag27_file_roles", f"""WITH {D_S}, n AS (SELECT k, lower(s) || CASE k % 5 WHEN 0 THEN ' priced' WHEN 1 THEN ' unpriced tender' WHEN 2 THEN ' مسعر' WHEN 3 THEN ' client' ELSE '' END AS n, k % 4 AS priced, k % 7 = 0 AS meta FROM s)
SELECT k, CASE WHEN priced <= 0 THEN 'ConsultantTarget' WHEN regexp_matches(n, {q(R.CONTRACTOR)}) AND NOT regexp_matches(n, {q(R.UNPRICED)}) THEN 'ContractorPriced' WHEN regexp_matches(n, {q(R.CONSULTANT)}) OR meta THEN 'ConsultantTarget' ELSE 'ContractorPriced' END AS role FROM n""")
def ag27(spark, d):
    n = sheets(spark, d).selectExpr("k", "concat(lower(s), case k % 5 when 0 then ' priced' when 1 then ' unpriced tender' when 2 then ' مسعر' when 3 then ' client' else '' end) AS n", "k % 4 AS priced", "k % 7 = 0 AS meta")
    return n.select("k", R.file_role(F.col("n"), F.col("priced"), F.col("meta")).alias("role"))


