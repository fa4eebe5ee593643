"""Pieces that several corpus operators share: checkpoints, folds, whole rows, joins on hot keys, components."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

#: Words are runs of anything but space and \t \n \v \f \r; ``bytes.split()`` without arguments splits there too.
SPACE_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names.  Only a single local process (tests) gets a folder of its own."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isEmpty():
        return
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named and not re.match(r"local(\[|$)", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tallyforge-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Write df to the checkpoint folder and continue from there: lineage ends, lost executors lose nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fold(doc_id: Column, k: int) -> Column:
    """crc32 of doc_id as text, modulo k (the split between learning and held-out rows)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % k


#: The user's whole row, carried as one column: no name of the user's can meet a name of ours.
ROW = "row"


def whole_rows(docs: DataFrame, *more: Column) -> DataFrame:
    """docs as one struct column ``row``, and the columns ``more`` of docs beside it."""
    return docs.select(F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]).alias(ROW), *more)


def row_hash(docs: DataFrame) -> Column:
    """A number from all columns that can be hashed, to choose among rows of one id and text."""
    return F.xxhash64(*[F.col(f"`{f.name.replace('`', '``')}`") for f in docs.schema.fields if not isinstance(f.dataType, (MapType, VariantType))])


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in pieces, so that few texts at a time are Python objects."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


#: A value is hot if more than one in so many rows has it: there are at most so many hot values, whatever the table.
HOT_SHARE = 1000
#: Parts that the rows of a hot value are dealt to.
SALTS = 64
#: So many rows are no burden for one task: up to here no value counts as hot.
FEW = 1 << 16


def hot_join(rows: DataFrame, values: DataFrame, on: list[str], size: str, total: int, spread: Column, how: str = "inner", few: int = FEW) -> DataFrame:
    """rows joined (inner or left) with values (one row per ``on``), the rows of hot values dealt to SALTS tasks.

    size: column of values, the number of rows with the value; total: rows, or more.  The list of hot values is
    broadcast: by its definition it has fewer than HOT_SHARE rows.  spread: a long that deals a value's rows evenly.
    """
    if total <= few:
        return rows.join(values, on, how)
    hot = F.col(size) > total // HOT_SHARE
    keys = F.broadcast(values.where(hot).select(*[F.col(c).alias(f"_h_{c}") for c in on], F.lit(True).alias("_hot")))
    same = [F.col(c) == F.col(f"_h_{c}") for c in on]
    r = rows.withColumn("_spread", spread).join(keys, same, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod("_spread", F.lit(SALTS))).otherwise(F.lit(0)).cast("int"))
    r = r.drop("_spread", "_hot", *[f"_h_{c}" for c in on])
    v = values.withColumn("_salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return r.join(v, [*on, "_salt"], how).drop("_salt")


def components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """Connected components of undirected edges (a, b), ids of any orderable type.

    Alternates the two star operations of Kiveris et al. (2014): every round joins each edge with the least neighbour
    of its end and both kinds of star keep connectivity; at the fixed point each node points at its component's least
    node.  Rounds go on until nothing changes.  A hub's edges are dealt to many tasks.  Only counts reach the driver.
    Returns (node, component) for the nodes that are not the least of theirs.
    """
    e = cut(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = lambda: e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
    seen = state()
    while seen.n:
        total = 2 * seen.n
        # large star: neighbours larger than the node move to the least of its neighbourhood
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("_m"), F.count("*").alias("_n")).select("a", F.least("a", "_m").alias("m"), "_n")
        large = hot_join(both, least, ["a"], "_n", total, F.xxhash64("b"), few=few).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: neighbours no larger than the node, and the node, move to the least of them
        m = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("_n"))
        j = hot_join(large, m, ["a"], "_n", total, F.xxhash64("b"), few=few)
        small = j.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(m.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        e = cut(small)
        if (now := state()) == seen:
            break
        seen = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("component"))


def with_tiles(rows: DataFrame, by: str, tile: int) -> DataFrame:
    """Split buckets of more than ``tile`` rows into chunks that meet pairwise, so no task holds a whole hot bucket.

    Adds ``_chunk`` (of the row), ``_lo`` and ``_hi`` (the two chunks of a tile).  Rows of tile (i, j) are chunks i and
    j; pairs inside chunk i belong to tile (i, i), pairs across chunks to (i, j).  Small buckets are tile (0, 0).
    ``rows`` needs a long column ``_h`` that spreads rows evenly; the list of hot buckets is repeated for each of SALTS
    parts of the rows, so that finding a hot bucket's rows is dealt out as well.
    """
    hot = rows.groupBy(by).agg(F.count("*").alias("_n")).where(F.col("_n") > tile).select(by, F.ceil(F.col("_n") / tile).cast("int").alias("_k"))
    hot = hot.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    r = rows.withColumn("_salt", F.pmod(F.col("_h"), F.lit(SALTS)).cast("int")).join(hot, [by, "_salt"], "left").drop("_salt")
    r = r.withColumn("_k", F.coalesce("_k", F.lit(1))).withColumn("_chunk", F.pmod(F.shiftright("_h", 8), F.col("_k")).cast("int"))
    r = r.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    return r.select("*", F.least("_chunk", "_other").alias("_lo"), F.greatest("_chunk", "_other").alias("_hi")).drop("_other", "_k")
