"""Hard-negative mining over a vector-approximation file.

Vectors become integers; each dimension is cut into cells and a row's approximation is one byte a dimension.  Anchors
meet the approximations in tiles: a block of anchors has, for every dimension and cell, the least and the largest
product of its components with the cell's values, so lower and upper bounds of all scores are sums of looked-up values.
Only rows whose bounds may enter a window are scored with whole vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, hot_join

#: Components are whole numbers up to this size, so that no score of up to 128 dimensions leaves 64 bits.
LARGEST = (1 << 28) - 1
#: Cells of a dimension, and the most vectors its bounds between cells are taken from (every row is coded).
CELLS, SAMPLE = 64, 20_000
#: Anchors and rows of a tile; of a label's tile.
TILE = (512, 4096)
POSITIVES, NEGATIVES = 5, 3
#: Anchors of a tile whose tables are in use at a time.
CHUNK = 32


def usable(vectors: DataFrame) -> DataFrame:
    """(id, label, v): the rows that take part, one an id; the label is the relabelled one."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    whole = F.transform(x, lambda e: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(256 * F.greatest(F.lit(-1.0 * LARGEST), F.least(F.lit(1.0 * LARGEST), e))))).cast("int"))
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    label = F.col("label").cast("bigint")
    label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(finite)
    return rows.select(F.col("vec_id").cast("bigint").alias("id"), label.alias("label"), whole.alias("v")).groupBy("id").agg(F.min(F.struct("label", "v")).alias("x")).select("id", "x.label", "x.v")


def cell_bounds(rows: DataFrame, cells: int = CELLS, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest value of each cell, (dimensions, cells): quantiles of a sample inside, the extremes of all rows outside."""

    def ends(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for _, g in f.groupby(f["v"].str.len()):
                if len(g["v"].iloc[0]):
                    m = np.stack(g["v"].to_numpy())
                    yield pd.DataFrame({"d": np.arange(m.shape[1]), "lo": m.min(0), "hi": m.max(0)})

    e = rows.select("v").mapInPandas(ends, "d int, lo long, hi long").groupBy("d").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).toPandas().sort_values("d")
    some = [np.asarray(r["v"]) for r in rows.orderBy(F.xxhash64("id")).limit(sample).select("v").collect()]
    lows, highs = np.zeros((len(e), cells), np.int64), np.zeros((len(e), cells), np.int64)
    for d, lo, hi in zip(e["d"], e["lo"], e["hi"]):
        seen = np.array([v[d] for v in some if len(v) > d] or [lo])
        inner = np.quantile(seen, np.arange(1, cells) / cells, method="lower").astype(np.int64)
        edge = np.concatenate([[lo], np.clip(inner, lo, hi), [hi + 1]])
        lows[d], highs[d] = edge[:-1], np.maximum(edge[1:] - 1, edge[:-1])
    return lows, highs


def approximations(rows: DataFrame, lows: np.ndarray) -> DataFrame:
    """rows with ``code``, one byte a dimension: the last cell that starts at or below the component."""

    def code(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"id": f["id"], "label": f["label"], "code": [bytes(np.array([max(0, np.searchsorted(lows[d], x, "right") - 1) for d, x in enumerate(v)], np.uint8)) for v in f["v"]]})

    return rows.select("id", "label", "v").mapInPandas(code, "id long, label long, code binary")


def _tables(anchors: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(dimension, cell, anchor): least and largest product of the anchor's component with the cell's values."""
    n = anchors.shape[1]
    a, b = lows[:n, :, None] * anchors.T[:, None, :], highs[:n, :, None] * anchors.T[:, None, :]
    return np.minimum(a, b), np.maximum(a, b)


def scanner(lows: np.ndarray, highs: np.ndarray, same: bool, k: int):
    """The function of a tile: (anchor, row, lo, hi) of the rows that may be among the first k of a window of an anchor."""

    def scan(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [(np.zeros(0, np.int64),) * 4]
        if len(left) and len(right):
            size = right["code"].str.len().to_numpy()
            for n in np.unique(left["v"].str.len()):
                a, r = left[(left["v"].str.len() == n).to_numpy()], right[size == n]
                if len(r):
                    out += found(a, r, int(n))
        cols = [np.concatenate(x) for x in zip(*out)]
        return pd.DataFrame(dict(zip(("anchor", "row", "lo", "hi"), cols)))

    def found(a: pd.DataFrame, r: pd.DataFrame, n: int) -> list[tuple]:
        codes = np.frombuffer(b"".join(r["code"]), np.uint8).reshape(len(r), n)
        ids, labels, out = r["id"].to_numpy(), r["label"].to_numpy(), []
        for at in range(0, len(a), CHUNK):
            part = a.iloc[at : at + CHUNK]
            lo_t, hi_t = _tables(np.stack(part["v"].to_numpy()).astype(np.int64).reshape(len(part), n), lows, highs)
            lo, hi = np.zeros((len(r), len(part)), np.int64), np.zeros((len(r), len(part)), np.int64)
            for d in range(n):
                lo += lo_t[d][codes[:, d]]
                hi += hi_t[d][codes[:, d]]
            lo, hi = np.ascontiguousarray(lo.T), np.ascontiguousarray(hi.T)
            for x, (anchor, label, windows) in enumerate(zip(part["id"], part["label"], part["windows"])):
                free = (labels == label) & (ids != anchor) if same else labels != label
                some = np.zeros(len(r), bool)
                for w in windows:
                    least, most = w["least"], w["most"]
                    sure = free & (lo[x] >= least) & (hi[x] <= most)
                    if sure.sum() >= k:
                        s = lo[x][sure]
                        least = max(least, np.partition(s, len(s) - k)[len(s) - k])
                    some |= free & (hi[x] >= least) & (lo[x] <= most)
                if some.any():
                    out.append((np.full(some.sum(), anchor), ids[some], lo[x][some], hi[x][some]))
        return out

    return scan


def _parts(by: Column, n: Column) -> Column:
    return F.pmod(F.xxhash64(by, F.lit(5)), n).cast("int")


def candidates(anchors: DataFrame, codes: DataFrame, bounds: tuple[np.ndarray, np.ndarray], same: bool, k: int, tile: tuple[int, int] = TILE) -> DataFrame:
    """(anchor, row, lo, hi) for anchors (id, label, v, windows) against codes (id, label, code), tile by tile.

    With ``same`` only rows of the anchor's label count and tiles are cut within labels.
    """
    if same:
        per = codes.groupBy("label").agg(F.count("*").alias("_n")).join(anchors.groupBy("label").agg(F.count("*").alias("_m")), "label")
        per = cut(per.select("label", "_n", F.ceil(F.col("_m") / tile[0]).alias("_ka"), F.ceil(F.col("_n") / tile[1]).alias("_kr")))
        total = codes.count()
        left = hot_join(anchors, per, ["label"], "_n", total, F.xxhash64("id"))
        right = hot_join(codes, per, ["label"], "_n", total, F.xxhash64("id"))
        group = F.col("label")
    else:
        n, m = codes.count(), anchors.count()
        ks = {"_ka": F.lit(max(1, -(-m // tile[0]))), "_kr": F.lit(max(1, -(-n // tile[1])))}
        left, right, group = anchors.withColumns(ks), codes.withColumns(ks), F.lit(0).cast("bigint")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    left = left.select("id", "label", "v", "windows", group.alias("_g"), _parts(F.col("id"), F.col("_ka")).alias("_i"), every("_kr").alias("_j"))
    right = right.select("id", "label", "code", group.alias("_g"), _parts(F.col("id"), F.col("_kr")).alias("_j"), every("_ka").alias("_i"))
    met = left.groupBy("_g", "_i", "_j").cogroup(right.groupBy("_g", "_i", "_j"))
    return met.applyInPandas(scanner(*bounds, same, k), "anchor long, row long, lo long, hi long")


def scored(pairs: DataFrame, anchors: DataFrame, rows: DataFrame) -> DataFrame:
    """pairs (anchor, row) with the exact score; whole vectors are fetched here and for these only."""
    a, r = anchors.select(F.col("id").alias("anchor"), F.col("v").alias("_a")), rows.select(F.col("id").alias("row"), F.col("v").alias("_r"))
    dot = F.aggregate(F.zip_with("_a", "_r", lambda x, y: x.cast("bigint") * y.cast("bigint")), F.lit(0).cast("bigint"), lambda s, x: s + x)
    return pairs.join(r, "row").join(a, "anchor").withColumn("score", dot).drop("_a", "_r")


def first_in_windows(pairs: DataFrame, windows: DataFrame, anchors: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(anchor, window, row, score, rank): of the tiles' candidates the first k of each window.

    windows: (anchor, window, least, most).  The k-th largest lower bound of rows that are surely inside, over all tiles,
    once more leaves rows behind before any vector is fetched.
    """
    p = pairs.join(windows, "anchor").where((F.col("hi") >= F.col("least")) & (F.col("lo") <= F.col("most")))
    sure = (F.col("lo") >= F.col("least")) & (F.col("hi") <= F.col("most"))
    p = p.withColumn("_n", F.row_number().over(Window.partitionBy("anchor", "window").orderBy(F.when(sure, F.col("lo")).desc_nulls_last(), "row")))
    p = p.withColumn("_kth", F.max(F.when(sure & (F.col("_n") == k), F.col("lo"))).over(Window.partitionBy("anchor", "window")))
    p = cut(p.where(F.col("_kth").isNull() | (F.col("hi") >= F.col("_kth"))).select("anchor", "window", "row", "least", "most"))
    got = scored(p.select("anchor", "row").distinct(), anchors, rows)
    got = p.join(got, ["anchor", "row"]).where((F.col("score") >= F.col("least")) & (F.col("score") <= F.col("most")))
    best = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "row")
    return got.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("anchor", "window", "row", "score", "rank")


def hard_negatives(vectors: DataFrame, every: int = 50, positives: int = POSITIVES, negatives: int = NEGATIVES, tile: tuple[int, int] = TILE, cells: int = CELLS) -> DataFrame:
    """Per (anchor_id, positive_id, rank): negative_id, positive_score, negative_score.

    Rows with a null id, label or vector or a component that is null or not finite take no part.  Components of
    2**28 and more after scaling count as one less.  Repeated rows are one; of rows that share an id the one with the least label and
    vector takes part.  Vectors of different lengths have no score with each other.  Of equal scores the smaller id comes
    first.  Anchors without positives, or positives without a row in their window, give no row; so does an empty table.
    Of equal vectors of one label only the first ids that can be wanted enter the tiles, which is exact: they tie
    everywhere and the smaller ids come first.  Other columns are not read.
    """
    rows = cut(usable(vectors))
    anchors = cut(rows.where(F.col("id") % every == 0))
    if anchors.isEmpty():
        none = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
        return rows.sparkSession.createDataFrame([], none)
    bounds = cell_bounds(rows, cells)
    most = max(positives + 1, negatives)
    firsts = rows.withColumn("_n", F.row_number().over(Window.partitionBy("label", "v").orderBy("id"))).where(F.col("_n") <= most).drop("_n")
    codes = cut(approximations(firsts, bounds[0]))

    everything = F.struct(F.lit(1 - (1 << 63)).alias("least"), F.lit((1 << 63) - 1).alias("most"))
    a = anchors.withColumn("windows", F.array(everything))
    one = anchors.select(F.col("id").alias("anchor"), F.lit(0).alias("window"), everything.alias("w")).select("anchor", "window", "w.*")
    pos = first_in_windows(candidates(a, codes, bounds, True, positives, (4 * tile[0], 4 * tile[1])), one, anchors, rows, positives)

    # 50 p <= 100 n <= 95 p in whole numbers
    pos = cut(pos.select("anchor", F.col("rank").alias("window"), F.col("row").alias("positive"), F.col("score").alias("ps")))
    half, most_ = F.expr("cast(ceil(cast(ps as decimal(20,0)) / 2) as bigint)"), F.expr("cast(floor(cast(ps as decimal(20,0)) * 19 / 20) as bigint)")
    w = cut(pos.select("anchor", "window", "positive", "ps", half.alias("least"), most_.alias("most")).where("least <= most"))
    a = anchors.join(w.groupBy(F.col("anchor").alias("id")).agg(F.collect_list(F.struct("least", "most")).alias("windows")), "id")  # at most ``positives`` a row
    neg = first_in_windows(candidates(a, codes, bounds, False, negatives, tile), w.select("anchor", "window", "least", "most"), anchors, rows, negatives)
    out = neg.join(w.select("anchor", "window", "positive", "ps"), ["anchor", "window"])
    return out.select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("row").alias("negative_id"), F.col("ps").alias("positive_score"), F.col("score").alias("negative_score"))


def oracle(every: int = 50, positives: int = POSITIVES, negatives: int = NEGATIVES) -> str:
    """The same for DuckDB: all rows scored with every anchor (unique ids, vectors of one length)."""
    return f"""
WITH r AS MATERIALIZED (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.id AS a, b.id AS b, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM r a JOIN r b ON a.id <> b.id WHERE a.id % {every} = 0),
p AS (SELECT a, b, score FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS k FROM s WHERE same) WHERE k <= {positives}),
n AS (SELECT p.a, p.b AS pos, s.b AS neg, p.score AS ps, s.score AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS rank
  FROM p JOIN s ON p.a = s.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT a AS anchor_id, pos AS positive_id, rank::INTEGER AS rank, neg AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE rank <= {negatives}"""
