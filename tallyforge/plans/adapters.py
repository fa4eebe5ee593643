"""The driver's tables as canonical items and matched pairs, for Spark and, as CTEs, for DuckDB.

Source items are parts, target items line items; pairs follow by part key.  All money is DECIMAL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UNITS = ["m3", "sqm", "lm", "ton", "item", "no", "month", "kw"]
MONEY = "decimal(18,4)"
LINE_RATE = f"cast(cast(cast(round(l_extendedprice * 100) as bigint) * 100 div cast(l_quantity as bigint) as decimal(18,0)) * cast(0.0001 as decimal(5,4)) as {MONEY})"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _unit() -> str:
    return "element_at(array(" + ",".join(f"'{u}'" for u in UNITS) + "), cast(p_size % 8 + 1 as int))"


def _currency(key: str) -> str:
    return f"element_at(array('EGP','USD','EUR','SAR','AED'), cast({key} % 5 + 1 as int))"


def source_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey as s_id", "p_brand as s_code", "concat(p_name, ' ', p_type) as s_description", f"{_unit()} as s_unit", f"cast(p_retailprice as {MONEY}) as s_rate",
        f"cast(10 + p_size as {MONEY}) as s_quantity", "p_type as s_bill", f"{_currency('p_partkey')} as s_currency",
    )


def target_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return li.join(p, li["l_partkey"] == p["p_partkey"]).selectExpr(
        "concat_ws('_', l_orderkey, l_linenumber, l_partkey, l_suppkey) as id", "l_orderkey as row", "l_partkey as part", "p_brand as code", "concat(p_name, ' ', p_type) as description", f"{_unit()} as unit",
        f"cast(l_quantity as {MONEY}) as quantity",
        f"{LINE_RATE} as original_rate",
        "p_type as bill", "concat('Bill ', lpad(cast(l_suppkey % 12 as string), 2, '0'), ' - ', p_brand) as sheet", f"{_currency('l_suppkey')} as currency",
        "case l_returnflag when 'A' then 'ProvisionalSum' when 'R' then 'RateOnly' else 'Normal' end as item_type", "p_size as size", "concat('W', l_suppkey % 3) as workbook",
    )


def part_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target items of a part together: part, code, description, unit, bill, size, the sum ``quantity`` and the least ``rate``.

    Lines are summed by the part's key alone before they meet the parts, so that no line carries a part's texts.
    """
    lines = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.sum(F.expr(f"cast(l_quantity as {MONEY})")).alias("_sum"), F.min(F.expr(LINE_RATE)).alias("_least"))
    p = table(spark, sf_dir, "part").selectExpr("p_partkey as part", "p_brand as code", "concat(p_name, ' ', p_type) as description", f"{_unit()} as unit", "p_type as bill", "p_size as size")
    items = p.join(lines, p["part"] == lines["l_partkey"])
    return items.groupBy("part", "code", "description", "unit", "bill", "size").agg(F.sum("_sum").cast(MONEY).alias("quantity"), F.min("_least").alias("rate"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left outer pairs of every target; provisional sums are never priced."""
    t, s = target_items(spark, sf_dir), source_items(spark, sf_dir)
    j = t.join(s, (t["part"] == s["s_id"]) & (F.col("item_type") != "ProvisionalSum") & (F.col("size") % 10 != 0), "left")
    level = "case when s_id is null then 'Unmatched' when size % 3 = 0 then 'Exact' when size % 3 = 1 then 'HighFuzzy' else 'ManualReviewNeeded' end"
    return j.selectExpr("*", "s_rate as injected_rate", f"{level} as confidence").withColumn("approved", F.col("confidence").isin("Exact", "HighFuzzy")).withColumn("is_vo", F.expr("s_id is null and item_type = 'Normal'"))


_D_UNIT = "['" + "','".join(UNITS) + "'][p_size % 8 + 1]"
_D_CUR = "['EGP','USD','EUR','SAR','AED'][{k} % 5 + 1]"
#: CTEs source_items, target_items and pairs.
BASE = f"""
source_items AS (SELECT p_partkey AS s_id, p_brand AS s_code, p_name || ' ' || p_type AS s_description, {_D_UNIT} AS s_unit, p_retailprice::DECIMAL(18,4) AS s_rate,
  (10 + p_size)::DECIMAL(18,4) AS s_quantity, p_type AS s_bill, {_D_CUR.format(k="p_partkey")} AS s_currency FROM part),
target_items AS (SELECT l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey AS id, l_orderkey AS row, l_partkey AS part, p_brand AS code, p_name || ' ' || p_type AS description, {_D_UNIT} AS unit,
  l_quantity::DECIMAL(18,4) AS quantity,
  ((round(l_extendedprice * 100)::BIGINT * 100 // l_quantity::BIGINT)::DECIMAL(18,0) * 0.0001::DECIMAL(5,4))::DECIMAL(18,4) AS original_rate,
  p_type AS bill, 'Bill ' || lpad((l_suppkey % 12)::VARCHAR, 2, '0') || ' - ' || p_brand AS sheet, {_D_CUR.format(k="l_suppkey")} AS currency,
  CASE l_returnflag WHEN 'A' THEN 'ProvisionalSum' WHEN 'R' THEN 'RateOnly' ELSE 'Normal' END AS item_type, p_size AS size, 'W' || (l_suppkey % 3) AS workbook FROM lineitem JOIN part ON l_partkey = p_partkey),
pairs AS (SELECT *, s_rate AS injected_rate, confidence IN ('Exact', 'HighFuzzy') AS approved, s_id IS NULL AND item_type = 'Normal' AS is_vo FROM (
  SELECT *, CASE WHEN s_id IS NULL THEN 'Unmatched' WHEN size % 3 = 0 THEN 'Exact' WHEN size % 3 = 1 THEN 'HighFuzzy' ELSE 'ManualReviewNeeded' END AS confidence
  FROM target_items LEFT JOIN source_items ON part = s_id AND item_type <> 'ProvisionalSum' AND size % 10 <> 0))"""


def over_base(sql: str) -> str:
    """sql (WITH-less, or starting with further CTEs after a comma) over the base CTEs."""
    return f"WITH {BASE}{sql if sql.lstrip().startswith(',') else chr(10) + sql}"
