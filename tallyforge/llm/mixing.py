"""Mixing sources to target weights by iterative proportional fitting (raking), in DataFrame operations only.

Tokens are summed per cell (source, language, topic).  Cell weights are raked until their sums meet the target share
of every source, every language and every topic; a document's probability follows from its cell.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import FEW, ROW, cut, whole_rows

DIMS = ("_src", "_lng", "_top")
#: Raking ends when no sum is off its target by more than this part of the target, or after ROUNDS rounds.
TOLERANCE, ROUNDS = 1e-13, 60
#: Rounds of the SQL, which cannot stop by itself.
SQL_ROUNDS = 24
#: Target share of a value: its token share to this power, normalised.
TEMPER = 0.7
#: Tokens to keep, as a share of all.
SHARE = 0.5
SALT = "17"
#: Bytes of cells that are broadcast; more are joined by shuffle.
BROADCAST = 32 << 20


def topic(text: Column) -> Column:
    """Topic by rule, the first that fits: legal, contact, listing, prose; empty texts are prose."""
    t = F.coalesce(text, F.lit(""))
    low = F.lower(t)
    return F.when(low.contains("license") | low.contains("copyright"), "legal").when(t.contains("@") | t.contains("://"), "contact").when(t.contains(" | "), "listing").otherwise("prose")


def uniform(doc_id: Column, salt: str = SALT) -> Column:
    """A number in [0, 1) from the id, the same on every engine and in every run."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":" + salt)).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def _with_cells(docs: DataFrame) -> DataFrame:
    n = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")
    return docs.withColumns({"_src": F.coalesce(F.col("source").cast("string"), F.lit("")), "_lng": F.coalesce(F.col("lang").cast("string"), F.lit("")), "_top": topic(F.col("text")), "_tok": n})


def raked_cells(docs: DataFrame, targets: dict[str, DataFrame] | None = None, rounds: int = ROUNDS, temper: float = TEMPER) -> DataFrame:
    """(_src, _lng, _top, tok, w): tokens and raked share of each cell; the shares add up to one.

    A round that finds every sum within TOLERANCE of its target is the last; after ``rounds`` rounds a warning tells the
    residual (targets that no weights of the cells at hand can meet together).  A target above zero for a value without
    tokens cannot be met by any weights and does not count.
    targets: for source, lang, topic a DataFrame (value, share), shares adding up to one over the values that occur;
    by default each value's token share to the power ``temper``, normalised.
    """
    cells = cut(_with_cells(docs).groupBy(*DIMS).agg(F.sum("_tok").alias("tok")))
    # rounds over so few cells are one task each, whatever the number of shuffle partitions: empty ones would only load the driver
    few = cells.limit(FEW + 1).count() <= FEW
    if few:
        cells = cut(cells.coalesce(1)).coalesce(1)
    marginals = {d: cells.groupBy(d).agg(F.sum("tok").alias("_m")) for d in DIMS}
    norm: dict[str, float] = {}
    if targets is None:  # one number a dimension reaches the driver
        sums = [marginals[d].agg(F.sum(F.pow(F.col("_m").cast("double"), temper)).alias("z")).select(F.lit(d).alias("d"), "z") for d in DIMS]
        norm = {r["d"]: r["z"] or 1.0 for r in sums[0].unionByName(sums[1]).unionByName(sums[2]).collect()}
    r = cells.withColumn("w", F.col("tok").cast("double"))
    for d, name in zip(DIMS, ("source", "lang", "topic")):
        if targets is None:
            t = marginals[d].select(d, (F.pow(F.col("_m").cast("double"), temper) / F.lit(norm[d])).alias("_t" + d))
        else:
            t = targets[name].select(F.col("value").alias(d), F.col("share").cast("double").alias("_t" + d))
        r = r.join(t, d, "left").fillna(0.0, ["_t" + d])
    r = cut(r).coalesce(1) if few else cut(r)
    residual = 0.0
    for _ in range(rounds):
        r = r.withColumn("_off", F.lit(0.0))
        for d in DIMS:
            if few:
                r = r.withColumn("_m", F.sum("w").over(Window.partitionBy(d)))
            else:
                r = r.join(r.groupBy(d).agg(F.sum("w").alias("_m")), d)
            target = F.col("_t" + d)
            off = F.when((F.col("_m") > 0) & (target > 0), F.abs(F.col("_m") / target - 1)).otherwise(F.col("_m"))
            r = r.withColumns({"w": F.when(F.col("_m") > 0, F.col("w") * target / F.col("_m")).otherwise(F.lit(0.0)), "_off": F.greatest("_off", off)}).drop("_m")
            if not few:  # r stands in both sides of the join: without the cut the plan would double with every step
                r = cut(r)
        if few:
            r = cut(r).coalesce(1)
        residual = r.agg(F.coalesce(F.max("_off"), F.lit(0.0))).first()[0]
        r = r.drop("_off")
        if residual <= TOLERANCE:
            break
    else:
        warnings.warn(f"raking stopped after {rounds} rounds with a sum off its target by {residual:.1e} of it", stacklevel=2)
    return r.select(*DIMS, "tok", "w")


def lift(cells: DataFrame, want: float) -> float:
    """The factor on all raked parts with which cells kept whole and the others together give ``want`` tokens.

    cells: tok, part (raked tokens).  A cell whose part times the factor reaches its tokens is kept whole; each round
    finds the factor for the cells whole so far, which may make more cells whole, and the last one finds no more.
    """
    k = 1.0
    while True:
        whole = F.col("part") * k >= F.col("tok")
        kept, free = cells.where("part > 0").agg(F.coalesce(F.sum(F.when(whole, F.col("tok"))), F.lit(0)), F.coalesce(F.sum(F.when(~whole, F.col("part"))), F.lit(0.0))).first()
        now = (want - float(kept)) / free if free > 0 else k
        if now <= k * (1 + 1e-12):
            return k
        k = now


def calibrated(docs: DataFrame, targets: dict[str, DataFrame] | None = None, share: float = SHARE, rounds: int = ROUNDS, temper: float = TEMPER, salt: str = SALT, fill: bool = False) -> DataFrame:
    """docs with _src, _lng, _top, _tok, _prob, _weight and _u.

    _prob is the probability that brings a cell to its raked part of ``share`` of all tokens, at most 1; _weight is
    what a kept document counts to make up for that bound (1 where it does not bind).  With ``fill`` the other cells
    make up for it in proportion to their parts, so that the tokens expected to be kept are ``share`` of all.
    """
    cells = cut(raked_cells(docs, targets, rounds, temper))
    wide = F.sum(F.octet_length("_src") + F.octet_length("_lng") + F.octet_length("_top") + 64)
    total, size = cells.agg(F.coalesce(F.sum("tok"), F.lit(0)), F.coalesce(wide, F.lit(0))).first()
    want = float(share) * float(total)
    if fill:
        cells = cells.withColumn("w", F.col("w") * lift(cells.select("tok", (F.col("w") * want).alias("part")), want))
    rate = F.when(F.col("tok") > 0, F.lit(float(share)) * F.lit(float(total)) * F.col("w") / F.col("tok")).otherwise(F.lit(float(share)))
    cells = cells.select(*DIMS, F.round(F.least(F.lit(1.0), rate), 9).alias("_prob"), F.round(F.greatest(F.lit(1.0), rate), 6).alias("_weight"))
    if size <= BROADCAST:  # texts stay where they are read; a shuffle by cell would put a hot cell in one task
        cells = F.broadcast(cells)
    return _with_cells(docs).join(cells, list(DIMS)).withColumn("_u", uniform(F.col("doc_id"), salt))


def mix_sources(docs: DataFrame, **kw) -> DataFrame:
    """Per row: doc_id, source, lang, topic, n_tokens, prob, weight, sampled.

    Null sources and languages are the value ''.  Cells without tokens (empty texts) are sampled at the overall share.
    Rows with one id share one draw.  Nothing is repeated: a cell that cannot fill its part is kept whole and says so
    in ``weight``.  Columns of docs whose names start with an underscore and clash are not kept.
    """
    c = calibrated(docs.select("doc_id", "text", "source", "lang"), **kw)
    return c.select("doc_id", F.col("_src").alias("source"), F.col("_lng").alias("lang"), F.col("_top").alias("topic"), F.col("_tok").alias("n_tokens"), F.col("_prob").alias("prob"), F.col("_weight").alias("weight"), (F.col("_u") < F.col("_prob")).alias("sampled"))


def mix_stage(docs: DataFrame) -> DataFrame:
    """The sampled documents, all columns kept whatever their names.

    The draw depends on the id and the cell's probability: repeated rows stay or go together, rows without an id share
    one draw.  Null sources and languages are the value ''; empty and null texts are drawn at the overall share.  What
    cells that are kept whole leave of their targets goes to the others.
    """
    rows = whole_rows(docs, *map(F.col, ("doc_id", "text", "source", "lang")))
    return calibrated(rows, fill=True).where(F.col("_u") < F.col("_prob")).select(f"{ROW}.*")


def oracle_ctes(docs: str = "documents", prefix: str = "mx", rounds: int = SQL_ROUNDS, temper: float = TEMPER, share: float = SHARE, salt: str = SALT) -> str:
    """DuckDB CTEs ending in {prefix}_out (doc_id, source, lang, topic, n_tokens, prob, weight, sampled)."""
    p = prefix
    parts = [
        f"""{p}_base AS (SELECT doc_id, coalesce(source, '') AS s, coalesce(lang, '') AS l,
  CASE WHEN contains(lower(coalesce(text, '')), 'license') OR contains(lower(coalesce(text, '')), 'copyright') THEN 'legal'
       WHEN contains(coalesce(text, ''), '@') OR contains(coalesce(text, ''), '://') THEN 'contact'
       WHEN contains(coalesce(text, ''), ' | ') THEN 'listing' ELSE 'prose' END AS t,
  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n FROM {docs})""",
        f"{p}_c AS MATERIALIZED (SELECT s, l, t, sum(n)::DOUBLE AS tok FROM {p}_base GROUP BY ALL)",
    ]
    for d in "slt":
        parts.append(f"{p}_t{d} AS MATERIALIZED (SELECT {d}, pow(sum(tok), {temper}) / sum(pow(sum(tok), {temper})) OVER () AS g FROM {p}_c GROUP BY {d})")
    prev = f"{p}_c0"
    parts.append(f"{prev} AS MATERIALIZED (SELECT s, l, t, tok, tok AS w, a.g AS gs, b.g AS gl, c.g AS gt FROM {p}_c JOIN {p}_ts a USING (s) JOIN {p}_tl b USING (l) JOIN {p}_tt c USING (t))")
    k = 0
    for _ in range(rounds):
        for d in "slt":
            k += 1
            parts.append(f"{p}_c{k} AS MATERIALIZED (SELECT * EXCLUDE (m) REPLACE (CASE WHEN m > 0 THEN w * g{d} / m ELSE 0 END AS w) FROM (SELECT *, sum(w) OVER (PARTITION BY {d}) AS m FROM {p}_c{k - 1}))")
    parts.append(f"{p}_r AS MATERIALIZED (SELECT s, l, t, CASE WHEN tok > 0 THEN {share} * sum(tok) OVER () * w / tok ELSE {share} END AS rate FROM {p}_c{k})")
    parts.append(
        f"""{p}_out AS (SELECT doc_id, s AS source, l AS lang, t AS topic, n AS n_tokens, round(least(1.0, rate), 9) AS prob, round(greatest(1.0, rate), 6) AS weight,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':{salt}'), 1, 8))::BIGINT / 4294967296.0 < round(least(1.0, rate), 9) AS sampled FROM {p}_base JOIN {p}_r USING (s, l, t))"""
    )
    return ",\n".join(parts)


def oracle() -> str:
    return f"WITH {oracle_ctes()}\nSELECT * FROM mx_out"
