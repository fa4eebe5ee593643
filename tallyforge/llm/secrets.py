"""Secret scans with multipart credential linking, in SQL functions only.

Base findings (assign, access, hex) always stand.  Weak candidates (key_id, weak_secret, endpoint) are reported only
where complementary parts lie within ``scope`` code points of them in the same document: an identifier needs a secret,
a secret needs an identifier, an endpoint needs both.  The parts meet in an interval join on scope-sized bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Kind, pattern, least length of group 2 (0: none), role.  Base kinds come first.
KINDS = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, "secret"),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, "id"),
    ("hex", r"[0-9a-f]{32,}", 0, "secret"),
    ("key_id", r"""(?i:(access_?key_?id|client_?id|account_?id|username|login))["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]+)""", 3, "id"),
    ("weak_secret", r"[A-Za-z0-9+/_-]{24,}", 0, "secret"),
    ("endpoint", r"""(?i:https?|postgres|mysql|redis|mongodb|s3)://[^\x20\x09-\x0D"'<>]+""", 0, "endpoint"),
]
BASE = 3


def _matches(text: Column, order: int) -> Column:
    """Array of (o, i, p, m, ok): gap before match i, its length, whether its value is long enough."""
    kind, pattern, least, _ = KINDS[order]
    part = F.zip_with(
        F.split(text, pattern, -1),
        F.regexp_extract_all(text, F.lit(pattern), 0),
        lambda p, m: F.struct(F.char_length(p).cast("bigint").alias("p"), F.char_length(m).cast("bigint").alias("m"), (F.char_length(F.regexp_extract(m, pattern, 2)) >= least if least else F.lit(True)).alias("ok")),
    )
    whole = F.transform(part, lambda x, i: F.struct(F.lit(order).alias("o"), i.alias("i"), x["p"].alias("p"), x["m"].alias("m"), F.coalesce(x["ok"], F.lit(False)).alias("ok")))
    none = F.array().cast("array<struct<o:int,i:int,p:bigint,m:bigint,ok:boolean>>")
    return F.when(text.rlike(pattern), whole).otherwise(none)


def _spans(rows: DataFrame) -> DataFrame:
    """(_row, o, start, end) of every match that stands; rows: (_row, _text)."""
    found = rows.select("_row", F.explode(F.concat(*[_matches(F.col("_text"), o) for o in range(len(KINDS))])).alias("x")).select("_row", "x.*").where("m is not null")
    # a repeated row finds each match once more; its length is to be summed once (only matches travel, no texts)
    found = found.distinct()
    before = Window.partitionBy("_row", "o").orderBy("i")
    at = found.withColumn("end", F.sum(F.col("p") + F.col("m")).over(before))
    return at.where("ok").select("_row", "o", (F.col("end") - F.col("m")).alias("start"), "end")


def linked(spans: DataFrame, scope: int) -> DataFrame:
    """The base spans, and the weak ones outside base spans whose complementary parts lie within the scope."""
    role = F.element_at(F.array(*[F.lit(k[3]) for k in KINDS]), F.col("o") + 1)
    so_far = Window.partitionBy("_row").orderBy("start", "o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = spans.withColumn("_covered", F.max(F.when(F.col("o") < BASE, F.col("end"))).over(so_far)).where((F.col("o") < BASE) | F.col("_covered").isNull() | (F.col("_covered") < F.col("end")))
    s = s.select("_row", "o", "start", "end", role.alias("role"), F.floor(F.col("start") / scope).alias("bin"))
    # of a bin's parts of one role only the first and the last can be the nearest to a neighbouring bin
    parts = s.groupBy("_row", "bin", "role").agg(F.min("start").alias("lo"), F.max("start").alias("hi"))
    weak = s.where(F.col("o") >= BASE).select("_row", "o", "start", "end", F.col("role").alias("own"), F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("bin"))
    near = weak.join(parts, ["_row", "bin"]).where((F.col("role") != F.col("own")) & (F.col("start") - F.col("hi") <= scope) & (F.col("lo") - F.col("start") <= scope))
    near = near.groupBy("_row", "o", "start", "end", "own").agg(F.max(F.col("role") == "id").alias("id"), F.max(F.col("role") == "secret").alias("secret"))
    ok = F.when(F.col("own") == "id", F.col("secret")).when(F.col("own") == "secret", F.col("id")).otherwise(F.col("id") & F.col("secret"))
    return s.where(F.col("o") < BASE).select("_row", "o", "start", "end").unionByName(near.where(ok).select("_row", "o", "start", "end"))


def secret_scan(docs: DataFrame, scope: int = 256) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked.

    Offsets are code points of the whole text, end exclusive; a null text is empty and has no spans.  Rows with one id
    and one text are scanned alike; rows that share an id but not the text, or have none, are scanned on their own.
    Extra columns are not read.
    """
    row = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.coalesce(F.md5("text"), F.lit("")))
    rows = docs.select("doc_id", row.alias("_row"), F.coalesce("text", F.lit("")).alias("_text"))
    # spans are few and read several times, texts many: the texts are searched once
    s = linked(cut(_spans(rows.select("_row", "_text"))), scope).distinct()
    label = F.concat_ws(":", F.element_at(F.array(*[F.lit(k[0]) for k in KINDS]), F.col("o") + 1), "start", "end")
    per = s.groupBy("_row").agg(
        *[F.count(F.when(F.col("o") == o, 1)).alias(f"n_{KINDS[o][0]}") for o in range(BASE)],
        F.count(F.when(F.col("o") >= BASE, 1)).alias("n_linked"),
        F.array_sort(F.collect_list(F.struct("start", "o", label.alias("t")))).alias("_all"),
    )
    text = lambda a: F.array_join(F.transform(a, lambda x: x["t"]), ",")
    per = per.select("_row", "n_assign", "n_access", "n_hex", "n_linked", text(F.filter("_all", lambda x: x["o"] < BASE)).alias("_base"), text(F.col("_all")).alias("_spans"))
    out = rows.select("doc_id", "_row").join(per, "_row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return out.select("doc_id", *map(zero, ("n_assign", "n_access", "n_hex")), F.sha2(F.coalesce("_base", F.lit("")), 256).alias("base_sha256"), F.coalesce("_spans", F.lit("")).alias("spans"), zero("n_linked"))


def oracle(scope: int = 256) -> str:
    """The same for DuckDB (documents with unique ids)."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    each = " UNION ALL ".join(
        f"SELECT doc_id, {o} AS o, generate_subscripts(m, 1) AS i, p, m FROM (SELECT doc_id, string_split_regex(text, {q(k[1])}) AS p, regexp_extract_all(text, {q(k[1])}) AS m FROM docs WHERE regexp_matches(text, {q(k[1])}))"
        for o, k in enumerate(KINDS)
    )
    ok = " ".join(f"WHEN {o} THEN length(regexp_extract(m[i], {q(k[1])}, 2)) >= {k[2]}" for o, k in enumerate(KINDS) if k[2])
    names = "[" + ",".join(q(k[0]) for k in KINDS) + "][o + 1]"
    roles = "[" + ",".join(q(k[3]) for k in KINDS) + "][o + 1]"
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
each AS ({each}),
pos AS (SELECT doc_id, o, length(m[i]) AS len, CASE o {ok} ELSE true END AS ok,
  sum(length(p[i]) + length(m[i])) OVER (PARTITION BY doc_id, o ORDER BY i)::BIGINT AS "end" FROM each),
spans AS (SELECT doc_id, o, "end" - len AS start, "end" FROM pos WHERE ok),
cov AS (SELECT *, max(CASE WHEN o < {BASE} THEN "end" END) OVER (PARTITION BY doc_id ORDER BY start, o ROWS UNBOUNDED PRECEDING) AS c FROM spans),
s AS (SELECT doc_id, o, start, "end", {roles} AS role FROM cov WHERE o < {BASE} OR c IS NULL OR c < "end"),
near AS (SELECT a.doc_id, a.o, a.start, a."end", a.role AS own, bool_or(b.role = 'id') AS id, bool_or(b.role = 'secret') AS sec
  FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.role <> b.role AND abs(a.start - b.start) <= {scope} WHERE a.o >= {BASE} GROUP BY ALL),
fin AS (SELECT doc_id, o, start, "end" FROM s WHERE o < {BASE} UNION ALL
  SELECT doc_id, o, start, "end" FROM near WHERE CASE own WHEN 'id' THEN sec WHEN 'secret' THEN id ELSE id AND sec END),
lab AS (SELECT *, {names} || ':' || start || ':' || "end" AS t FROM fin),
per AS (SELECT doc_id, count(*) FILTER (o = 0) AS a, count(*) FILTER (o = 1) AS b, count(*) FILTER (o = 2) AS c, count(*) FILTER (o >= {BASE}) AS l,
  coalesce(string_agg(t, ',' ORDER BY start, o) FILTER (o < {BASE}), '') AS base, string_agg(t, ',' ORDER BY start, o) AS every FROM lab GROUP BY doc_id)
SELECT d.doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(c, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans, coalesce(l, 0)::BIGINT AS n_linked FROM docs d LEFT JOIN per p ON d.doc_id = p.doc_id"""
