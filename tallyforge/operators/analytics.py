"""Pricing analytics over matched pairs.

Money sums stay DECIMAL inside; currencies are never added together.  Everything aggregates partially before its
shuffle; the windows that rank all rows first cut them to one partition's worth by range partitioning.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from .checkpoints import cut

AMOUNT = "decimal(38,8)"


def amount(rate: str = "injected_rate", quantity: str = "quantity") -> Column:
    return F.col(rate) * F.col(quantity)


def total(x: Column, when: Column | None = None) -> Column:
    """Sum as decimal, 0 for no rows."""
    return F.coalesce(F.sum(x if when is None else F.when(when, x)), F.lit(0)).cast(AMOUNT)


def currency_summary(sources: DataFrame, pairs: DataFrame) -> DataFrame:
    """AG2, AG3: per currency of either side, base value, remeasured value, items, variance and its percentage."""
    key = lambda c: F.upper(F.when(F.trim(F.coalesce(c, F.lit(""))) == "", "EGP").otherwise(c))
    a = sources.groupBy(key(F.col("s_currency")).alias("currency")).agg(total(F.col("s_rate") * F.col("s_quantity")).alias("base"))
    b = pairs.groupBy(key(F.col("currency")).alias("currency")).agg(total(amount(), F.col("approved")).alias("remeasured"), F.count("*").alias("items"))
    j = a.join(b, "currency", "full").fillna(0, ["items"]).withColumns({c: F.coalesce(c, F.lit(0).cast(AMOUNT)) for c in ("base", "remeasured")})
    diff = F.col("remeasured") - F.col("base")
    return j.select("currency", F.col("base").cast("double"), F.col("remeasured").cast("double"), "items", diff.cast("double").alias("variance"), F.round(F.when(F.col("base") != 0, diff.cast("double") / F.col("base").cast("double") * 100).otherwise(0.0), 6).alias("variance_pct"))


def match_counts(pairs: DataFrame) -> DataFrame:
    """AG1."""
    c = pairs.agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("confidence") == k).alias(n) for k, n in (("Exact", "exact"), ("HighFuzzy", "high_fuzzy"), ("ManualReviewNeeded", "review"))],
        F.count_if(F.expr("is_vo")).alias("vo"),
        F.count_if(F.col("item_type") == "ProvisionalSum").alias("ps"),
    )
    return c.withColumn("match_rate", F.bround(F.when(F.col("total") > 0, (F.col("exact") + F.col("high_fuzzy")) * 100.0 / F.col("total")).otherwise(0.0).cast("double"), 1))


def running(df: DataFrame, value: str, tie: str, slices: int | None = None) -> DataFrame:
    """WN1, WN2 at scale: rank, running sum and total of a descending decimal column, no task holding all rows.

    Rows are range-partitioned by (value desc, tie) once and written, so that the partition of a row is a fact that both
    sides below read; each partition ranks its own rows and adds the totals of the partitions before it, of which there
    is one row each.
    """
    order = [F.desc(value), F.asc(tie)]
    slices = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = cut(df.repartitionByRange(slices, *order).withColumn("_p", F.spark_partition_id()))
    own = Window.partitionBy("_p").orderBy(*order)
    ranked = parts.withColumns({"_r": F.row_number().over(own), "_s": F.sum(value).over(own.rowsBetween(Window.unboundedPreceding, 0))})
    sums = parts.groupBy("_p").agg(F.count("*").alias("_n"), F.sum(value).alias("_v"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    sums = sums.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_v").over(before), F.lit(0)).alias("_v0"), F.sum("_v").over(Window.partitionBy()).alias("_all"))
    return ranked.join(F.broadcast(sums), "_p").select(*df.columns, (F.col("_r") + F.col("_n0")).alias("rank"), (F.col("_s") + F.col("_v0")).cast(AMOUNT).alias("running"), F.col("_all").cast(AMOUNT).alias("total"))


def pareto(pairs: DataFrame) -> DataFrame:
    """AG7, WN1, WN2: rank, cumulative share and class of every priced pair that is not protected.

    A while the share is at most .80 (the first row always), B while at most .95 (the first row after A always), else C.
    A row is the first after A if the share before it is still at most .80, or if it is the second.
    """
    p = pairs.where("injected_rate > 0 and quantity > 0 and item_type <> 'ProvisionalSum'").select("id", "bill", amount().alias("amount"))
    share = lambda x: x.cast("double") / F.col("total").cast("double")
    r = running(p, "amount", "id").withColumns({"share": share(F.col("running")), "_before": share((F.col("running") - F.col("amount")).cast(AMOUNT))})
    level = F.when((F.col("share") <= 0.80) | (F.col("rank") == 1), "A").when((F.col("share") <= 0.95) | (F.col("_before") <= 0.80) | (F.col("rank") == 2), "B").otherwise("C")
    return r.select("id", "bill", F.col("amount").cast("double"), F.col("rank").cast("long"), F.round("share", 8).alias("share"), level.alias("class"))


def trade_breakdown(pairs: DataFrame) -> DataFrame:
    """AG8: items, total, share, running class and three sample sheets per trade."""
    p = pairs.where("injected_rate > 0").withColumn("trade", R.trade(F.concat_ws(" ", "sheet", "bill", "description")))
    g = p.groupBy("trade").agg(F.count("*").alias("items"), total(amount()).alias("t"))
    s = p.groupBy("trade", "sheet").agg(F.min("id").alias("f")).withColumn("n", F.row_number().over(Window.partitionBy("trade").orderBy("f", "sheet"))).where("n <= 3").groupBy("trade").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "sheet"))), lambda x: x["sheet"]), ", ").alias("samples"))
    w = Window.orderBy(F.desc("t"), "trade")  # seven rows
    every = Window.partitionBy()
    g = g.withColumns({"run": F.sum("t").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("double"), "all": F.sum("t").over(every).cast("double")})
    cum = F.col("run") / F.col("all")
    return g.join(s, "trade").select("trade", "items", F.col("t").cast("double").alias("total"), F.round(F.col("t").cast("double") / F.col("all") * 100, 6).alias("share"), F.when(cum <= 0.80, "A").when(cum <= 0.95, "B").otherwise("C").alias("class"), "samples")


def variance(pairs: DataFrame) -> DataFrame:
    """AG9: baseline and reconciled totals, escalation, savings, and counts beyond a cent per line."""
    p = pairs.where("injected_rate is not null and original_rate is not null").select(amount("original_rate").alias("a"), amount().alias("b"))
    d = F.col("b") - F.col("a")
    band = F.lit("0.01").cast("decimal(4,2)")
    return p.agg(
        total(F.col("a")).cast("double").alias("baseline"), total(F.col("b")).cast("double").alias("reconciled"), total(d, d > 0).cast("double").alias("escalation"), total(-d, d < 0).cast("double").alias("savings"),
        F.count_if(d > band).alias("n_up"), F.count_if(d < -band).alias("n_down"), F.count_if(F.abs(d) <= band).alias("n_same"),
    )


def top_changes(pairs: DataFrame, n: int = 10) -> DataFrame:
    """AG9, LM2: the n largest rises and falls."""
    p = pairs.where("injected_rate is not null and original_rate is not null").select("id", (amount() - amount("original_rate")).alias("d"))
    up = p.where("d > 0").orderBy(F.desc("d"), "id").limit(n).withColumn("kind", F.lit("rise"))
    down = p.where("d < 0").orderBy("d", "id").limit(n).withColumn("kind", F.lit("fall"))
    return up.unionByName(down).select("kind", "id", F.col("d").cast("double").alias("change"))


def order_statistics(df: DataFrame, by: str, value: str, quantiles: dict[str, float], slices: int | None = None) -> DataFrame:
    """Per group ``by`` (null is a group): exact interpolated (R-7) quantiles of ``value``, no task holding a group.

    Equal values are counted first, so a value that many rows share is one row; the counted values are range-partitioned
    and written once, then numbered as in ``running``: each partition adds the counts of its group's earlier partitions.
    """
    slices = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = df.where(F.col(value).isNotNull()).groupBy(F.col(by).alias("_g"), F.col(value).alias("_x")).agg(F.count("*").alias("_c"))
    parts = cut(counted.repartitionByRange(slices, "_g", "_x").withColumn("_p", F.spark_partition_id()))
    up = Window.unboundedPreceding
    sums = parts.groupBy("_p", "_g").agg(F.sum("_c").alias("_n"))
    group = Window.partitionBy("_g")  # one row a partition that the group reaches
    sums = sums.select(F.col("_p").alias("_q"), F.col("_g").alias("_h"), F.coalesce(F.sum("_n").over(group.orderBy("_p").rowsBetween(up, -1)), F.lit(0)).alias("_n0"), F.sum("_n").over(group).alias("_all"))
    r = parts.withColumn("_s", F.sum("_c").over(Window.partitionBy("_p", "_g").orderBy("_x").rowsBetween(up, 0)))
    r = r.join(sums, (F.col("_p") == F.col("_q")) & F.col("_g").eqNullSafe(F.col("_h"))).withColumn("_to", F.col("_s") + F.col("_n0"))
    at = lambda k: F.max(F.when((F.col("_to") - F.col("_c") <= k) & (k < F.col("_to")), F.col("_x")))
    place = {name: (F.col("_all") - 1) * F.lit(float(q)) for name, q in quantiles.items()}
    ends = r.groupBy("_g", "_all").agg(*[f(at(e(h))) for name, h in place.items() for f, e in ((lambda c, n=name: c.alias(f"_lo_{n}"), F.floor), (lambda c, n=name: c.alias(f"_hi_{n}"), F.ceil))])
    between = lambda n, h: (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * (h - F.floor(h))).alias(n)
    return ends.select(F.col("_g").alias(by), *[between(n, h) for n, h in place.items()])


#: Groups whose statistics are broadcast; more are joined by shuffle.
FEW_GROUPS = 100_000


def _beside(stats: DataFrame, more: DataFrame, by: str) -> DataFrame:
    """Two tables of one row a group side by side."""
    return stats.join(more.withColumnRenamed(by, "_by"), F.col(by).eqNullSafe(F.col("_by"))).drop("_by")


def with_statistics(rows: DataFrame, stats: DataFrame, by: str) -> DataFrame:
    """rows with the statistics of their group, which are written already; rows stay where they are while groups are few."""
    stats = stats.withColumnRenamed(by, "_by")
    if stats.count() <= FEW_GROUPS:
        stats = F.broadcast(stats)
    return rows.join(stats, F.col(by).eqNullSafe(F.col("_by"))).drop("_by")


def distribution(items: DataFrame, rate: str, by: str) -> DataFrame:
    """AG10: spread of the positive rates of each group; percentiles are interpolated (R-7)."""
    x = items.where(F.col(rate) > 0).select(by, rate, F.col(rate).cast("double").alias("x"))
    q = order_statistics(x, by, "x", {"median": 0.5, "p10": 0.1, "p25": 0.25, "p75": 0.75, "p90": 0.9})
    g = x.groupBy(by).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"), F.round(F.avg(F.col(rate)).cast("double"), 4).alias("mean"), F.round(F.coalesce(F.stddev_samp("x"), F.lit(0.0)), 4).alias("sd"))
    return _beside(g, q, by).select(by, "n", "low", "high", F.round("median", 6).alias("median"), "mean", *[F.round(p, 6).alias(p) for p in ("p10", "p25", "p75", "p90")], "sd")


def fx_sensitivity(pairs: DataFrame) -> DataFrame:
    """AG11: foreign totals at parity and with the rate 5 and 10 percent up and down."""
    g = pairs.where("injected_rate > 0").where(~F.col("currency").isin("EGP", "Unknown")).groupBy("currency").agg(total(amount()).alias("t"))
    rate = R.rate_of(F.col("currency")).cast("double")
    local = F.col("t").cast("double") * rate
    return g.select("currency", F.col("t").cast("double").alias("foreign_total"), rate.alias("parity"), F.round(local, 4).alias("local_total"), *[F.round(local * k / 100, 4).alias(f"impact_{k}") for k in (5, 10)], *[F.round(local * (100 - k) / 100, 4).alias(f"down_{k}") for k in (5, 10)])


def rate_audit(items: DataFrame, by: Column | None = None) -> DataFrame:
    """AG18-AG20: modified z score, decimal shift and amount mismatch of priced items, within groups of at least four.

    items: id, unit_rate, quantity, total_amount.  Medians are selected by rank; group statistics are broadcast while
    the groups are few.
    """
    p = cut(items.where("unit_rate > 0").select("id", F.col("unit_rate").cast("double").alias("r"), "unit_rate", "quantity", "total_amount", (F.lit("all") if by is None else by).alias("grp")))
    s = p.groupBy("grp").agg(F.count("*").alias("n"), F.avg("r").alias("mean"), F.coalesce(F.stddev_samp("r"), F.lit(0.0)).alias("sd"))
    s = cut(_beside(s, order_statistics(p, "grp", "r", {"med": 0.5}), "grp"))
    off_median = with_statistics(p.select("grp", "r"), s.select("grp", "med"), "grp").select("grp", F.abs(F.col("r") - F.col("med")).alias("d"))
    s = cut(_beside(s, order_statistics(off_median, "grp", "d", {"mad": 0.5}), "grp"))
    j = with_statistics(p, s, "grp").withColumn("enough", F.col("n") >= 4)
    z = F.when(F.col("mad") > 0.0001, 0.6745 * (F.col("r") - F.col("med")) / F.col("mad")).when(F.col("sd") > 0.0001, (F.col("r") - F.col("mean")) / F.col("sd")).otherwise(0.0)
    ratio = F.col("r") / F.col("med")
    bands = [(9.5, 10.5), (95.0, 105.0), (950.0, 1050.0), (0.095, 0.105), (0.0095, 0.0105)]  # fixed values
    shift = reduce(lambda a, b: a | b, [ratio.between(*b) for b in bands])
    off = F.abs(F.bround(F.col("quantity") * F.col("unit_rate"), 2) - F.bround("total_amount", 2)) > 1
    out = j.select("id", "grp", F.round(F.when(F.col("enough"), z).otherwise(0.0), 4).alias("z"), (F.col("enough") & (F.abs(z) >= 3.5)).alias("outlier"), (F.col("enough") & (F.col("med") > 0) & shift).alias("shift"), F.coalesce((F.col("quantity") > 0) & off, F.lit(False)).alias("mismatch"))
    return out.where("outlier or shift or mismatch")


def scorecard(pairs: DataFrame, anomalies: Column) -> DataFrame:
    """AG21: health of a tender out of 100, and its risk band."""
    c = pairs.agg(F.count("*").alias("total"), F.count_if((F.col("injected_rate") > 0) & (F.col("item_type") != "ProvisionalSum")).alias("priced"), F.count_if(F.col("confidence") == "Exact").alias("exact"), F.count_if(F.col("item_type") == "ProvisionalSum").alias("ps"), F.count_if(F.expr("is_vo")).alias("vo"))
    cover = F.col("priced") / F.greatest(F.lit(1), F.col("total") - F.col("ps")) * 100
    part = lambda n, k: F.greatest(F.lit(0.0), 10 - n * k)
    c = c.withColumn("s", F.least(F.lit(100.0), cover * 0.5 + F.col("exact") / F.greatest(F.lit(1), F.col("total")) * 30 + part(anomalies, 0.5) + part(F.col("vo"), 0.2)))
    risk = F.when(F.col("s") >= 90, "Low").when(F.col("s") >= 75, "Moderate").when(F.col("s") >= 60, "High").otherwise("Critical")
    return c.select("total", "priced", "exact", "ps", "vo", F.bround("s", 1).alias("score"), risk.alias("risk"))


def harmonised_roles(files: DataFrame) -> DataFrame:
    """AG26: role of each file (workbook, priced, detected): unpriced ones are targets, of the priced ones one is the contractor's.

    The contractor's is a file with a telling name, else the one with most priced rows; other priced files stay targets
    if they were detected as such and are supplementary rates otherwise.
    """
    # fixed values: names that tell the contractor's file
    named = F.lower("workbook").rlike("candy|ccs")
    first = Window.orderBy((F.col("priced") > 0).desc(), named.desc(), F.desc("priced"), "workbook")  # one row a file
    role = F.when(F.col("priced") <= 0, "ConsultantTarget").when(F.col("_n") == 1, "ContractorPriced").when(F.col("detected") == "ConsultantTarget", "ConsultantTarget").otherwise("SupplementaryRates")
    return files.withColumn("_n", F.row_number().over(first)).withColumn("role", role).drop("_n")
