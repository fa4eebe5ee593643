"""Filter interaction audit: five filters, their 120 orders as paths through a lattice of 80 edges.

A document's outcome in any order follows from the set of filters it fails.  Documents are counted by (part, failed
set, labels); these counts contribute to the lattice's edges (filters already applied, next filter), and the edges are
joined to the 600 steps of all orders.  Nothing is computed per order.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_RUN

FILTERS = "ABCDE"
#: Fixed values of the filters: least words, least distinct share, most capitals, marks that fail.
MIN_WORDS, DISTINCT_PERCENT, CAPITALS_PERCENT, MARKS = 200, 50, 2, "[#$%&*|]"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def text_fails(text: Column) -> Column:
    """Bits 1, 2, 4, 8: whether a text fails A, B, C, D."""
    bit = lambda cond, v: F.when(cond, v).otherwise(0)
    words = F.filter(F.split(text, SPACE_RUN, -1), lambda w: w != "")
    n, different, capitals, length = (x.cast("bigint") for x in (F.size(words), F.size(F.array_distinct(words)), F.regexp_count(text, F.lit("[A-Z]")), F.char_length(text)))
    few, dull, loud = n < MIN_WORDS, 100 * different < DISTINCT_PERCENT * n, 100 * capitals > CAPITALS_PERCENT * length
    return bit(few, 1) + bit(dull, 2) + bit(loud, 4) + bit(text.rlike(MARKS), 8)


def profiles(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, fails, good, toxic, n): documents counted by what decides their fate; fails has bit 16 for filter E.

    Texts meet as SHA-256 digests.  Rows are counted by (text, id) first, so a text that a third of the corpus copies
    sends one row per id and task; the smallest id of a text then follows from those counts, partially aggregated too.
    """
    t = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), t.alias("_t"))
    rows = rows.select("doc_id", "part", F.sha2("_t", 256).alias("_h"), text_fails(F.col("_t")).alias("_f"))
    rows = rows.groupBy("doc_id", "part", "_h", "_f").agg(F.count("*").alias("n"))
    # rows without an id have no label; they are spread by what they hold
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("_k")).agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    known = known.select(F.lit(False).alias("_null"), "_k", "good", "toxic")
    keyed = rows.withColumns({"_null": F.col("doc_id").isNull(), "_k": F.coalesce(F.col("doc_id"), F.xxhash64("_h", "part"))})
    rows = keyed.join(known, ["_null", "_k"], "left").fillna(False, ["good", "toxic"])
    kinds = rows.groupBy("_h", "part", "_f", "good", "toxic").agg(F.sum("n").alias("n"), F.min("doc_id").alias("_m"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("_none"), F.min_by("n", "doc_id").alias("_at"))
    each = kinds.withColumn("_least", F.min("_m").over(Window.partitionBy("_h")))  # one row a part and label at most
    # all copies fail E but the rows of the smallest id and those without an id
    stay = F.col("_none") + F.when(F.col("_m") == F.col("_least"), F.col("_at")).otherwise(0)
    split = F.array(F.struct(F.col("_f").alias("fails"), stay.alias("n")), F.struct((F.col("_f") + 16).alias("fails"), (F.col("n") - stay).alias("n")))
    flat = each.select("part", "good", "toxic", F.inline(split)).where("n > 0")
    return flat.groupBy("part", "fails", "good", "toxic").agg(F.sum("n").alias("n"))


def lattice() -> list[tuple[int, int, int]]:
    """(applied, next, orders): the 80 edges and how many of the 120 orders pass through each."""
    n = len(FILTERS)
    return [(s, f, factorial(s.bit_count()) * factorial(n - 1 - s.bit_count())) for s in range(1 << n) for f in range(n) if not s >> f & 1]


def steps() -> list[tuple[str, int, int, int]]:
    """(filter_order, step, applied, next): the 600 steps of all orders."""
    out = []
    for p in permutations(range(len(FILTERS))):
        for k, f in enumerate(p):
            out.append(("".join(FILTERS[x] for x in p), k + 1, sum(1 << x for x in p[:k]), f))
    return out


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per (part, filter_order, step): kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    part is the source, '' for null.  Null texts are empty and equal each other.  Repeated rows count as often as they
    stand there; rows of one id do not fail E because of each other, and rows without an id neither fail E nor have
    labels.  Of several labels of one id any 1 counts; labels of unknown ids do not.  A text of any length is split where
    it is read, its words staying in its row.  An empty table of documents has no part and gives no row.  Other columns
    are not read.
    """
    spark = docs.sparkSession
    number = lambda **kw: F.struct(*[F.lit(v).alias(k) for k, v in kw.items()])
    edges = F.array(*[number(applied=s, next=f, orders=k) for s, f, k in lattice()])
    path = F.broadcast(spark.createDataFrame(steps(), "filter_order string, step int, applied int, next int"))  # 600 rows
    c, bit = F.col, F.expr("shiftleft(1, next)")
    fails, before = c("fails").bitwiseAND(bit) != 0, c("fails").bitwiseAND(c("applied")) != 0
    count = lambda cond: F.sum(F.when(cond, c("n")).otherwise(0)).cast("bigint")
    counted = (
        profiles(docs, labels).select("part", "fails", "good", "toxic", "n", F.inline(edges)).groupBy("part", "applied", "next", "orders")
        .agg(
            count(~before & ~fails).alias("kept"), count(~before & fails).alias("removed"), count(before & fails).alias("redundant"), count(c("fails") == bit).alias("unique_fails"),
            count(~before & fails & c("good")).alias("good_lost"), count(~before & fails & c("toxic")).alias("toxic_lost"),
        )
    )
    # 16 edges lead through each filter: one row a part and filter
    shapley = counted.groupBy("part", "next").agg(F.sum(c("removed") * c("orders")).cast("bigint").alias("shapley"))
    return counted.join(shapley, ["part", "next"]).join(path, ["applied", "next"]).select("part", "filter_order", "step", *COUNTS)


def oracle() -> str:
    """The same for DuckDB, order by order (documents with unique ids)."""
    w = "regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')"
    bits = " + ".join(f"CASE WHEN strpos(left(o, k), '{f}') > 0 THEN {1 << i} ELSE 0 END" for i, f in enumerate(FILTERS))
    return f"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
f AS MATERIALIZED (SELECT part, (coalesce(quality, 0) = 1) AS good, (coalesce(toxic, 0) = 1) AS toxic,
  CASE WHEN len({w}) < {MIN_WORDS} THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct({w})) < {DISTINCT_PERCENT} * len({w}) THEN 2 ELSE 0 END
  + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {CAPITALS_PERCENT} * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '{MARKS}') THEN 8 ELSE 0 END
  + CASE WHEN t.doc_id > min(t.doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS fails FROM t LEFT JOIN labels l ON t.doc_id = l.doc_id),
g AS MATERIALIZED (SELECT part, good, toxic, fails, count(*) AS n FROM f GROUP BY ALL),
perm(o) AS (SELECT unnest(string_split('{",".join(FILTERS)}', ',')) UNION ALL SELECT o || x FROM perm, (SELECT unnest(string_split('{",".join(FILTERS)}', ',')) AS x) WHERE length(o) < {len(FILTERS)} AND strpos(o, x) = 0),
st AS (SELECT o, k AS step, {bits.replace("left(o, k)", "left(o, k - 1)")} AS applied, 1 << (ascii(substr(o, k, 1)) - 65) AS b FROM perm, range(1, {len(FILTERS) + 1}) r(k) WHERE length(o) = {len(FILTERS)}),
a AS (SELECT part, o, step, b, sum(CASE WHEN fails & (applied | b) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN fails & applied = 0 AND fails & b <> 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN fails & applied <> 0 AND fails & b <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = b THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN good AND fails & applied = 0 AND fails & b <> 0 THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN toxic AND fails & applied = 0 AND fails & b <> 0 THEN n ELSE 0 END) AS toxic_lost
  FROM g, st GROUP BY ALL)
SELECT part, o AS filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, b))::BIGINT AS shapley FROM a"""
