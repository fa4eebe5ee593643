"""Near-dedup of the corpus pipeline: five-word shingles, similarity 0.8, every link checked on the shingles.

Texts of equal sets of shingles are one class.  Candidates among classes are named by SimHash first, as in
``simhash_dedup``: tables of bit blocks that miss no pair of fingerprints within ``RADIUS`` bits, compared by bit planes
inside a bucket.  Few pairs of similarity 0.8 lie that near, so MinHash bands (``BANDS`` tables of ``ROWS`` values each:
a pair of similarity 0.8 meets with probability 0.9998) name the pairs beyond the radius.  Retrieval reads signatures
only and finds, for each bucket, the classes that have a candidate there which they met in no earlier table.  Sets of shingles
are fetched for these; each bucket then joins its classes by the Jaccard similarity of the sets and reports a forest,
so a group of m near copies gives m - 1 links, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW, components, cut, hot_join, row_hash, slices, whole_rows, with_tiles
from .simhash_dedup import blocks_for, fingerprint, near_pairs, table_masks

#: Words of a shingle and the least similarity of a link.
WIDTH, SIMILAR = 5, 0.8
BANDS, ROWS = 16, 4
#: Bits in which fingerprints may differ for SimHash to name the pair.
RADIUS = 4
#: Share of equal MinHash values below which a pair is not checked: four deviations under 0.8.
AGREE = 0.6
#: Rows of a bucket that one task compares at once.
TILE = 1024
_RNG = np.random.default_rng(20)
_MUL = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
#: Shingles whose values are taken at once.
CHUNK = 4096


def shingles(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """The different shingles of the text with A-Z lower-cased, as sorted hashes; fewer words are one shingle, none is none."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *(ends[:-1]).tolist()]
    found = {joined[a:b] for a, b in zip(starts, (ends[width - 1 :] - 1).tolist())}
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found)))


def minima(h: np.ndarray) -> np.ndarray:
    """MinHash values of a set of hashes; the empty set has values of its own."""
    out = np.full(BANDS * ROWS, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for i in range(0, len(h), CHUNK):
        x = _MUL[:, None] * (h[i : i + CHUNK] ^ (h[i : i + CHUNK] >> np.uint64(31))) + _ADD[:, None]
        np.minimum(out, x.min(axis=1), out=out)
    return out


def node() -> Column:
    """Rows of one id and one text are one node."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce("text", F.lit(""))).alias("_node")


def _node(docs: DataFrame) -> DataFrame:
    """(_node, doc_id, text)."""
    return docs.select(node(), "doc_id", "text")


def signatures(docs: DataFrame) -> DataFrame:
    """(_node, doc_id, digest, n, fp, keys, sketch) of every row.

    digest: 128 bits of the set of shingles; n: its size; fp: the SimHash; keys: one for each band; sketch: a byte of
    every MinHash value.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            digest, n, fp, keys, sketch = [], [], [], [], []
            for t in b.column(2).cast(pa.binary()).to_pylist():
                h = shingles(t)
                v = minima(h)
                digest.append(xxhash.xxh3_128_digest(h.tobytes()))
                n.append(len(h))
                fp.append(fingerprint(t, WIDTH))
                keys.append([xxhash.xxh64_intdigest(v[k * ROWS : (k + 1) * ROWS].tobytes(), k) - (1 << 63) for k in range(BANDS)])
                sketch.append((v >> np.uint64(56)).astype(np.uint8).tobytes() if not len(h) else ((v * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(digest, pa.binary()), pa.array(n, pa.int32()), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.binary())], ["_node", "doc_id", "digest", "n", "fp", "keys", "sketch"])

    return _node(docs).mapInArrow(run, f"_node bigint, doc_id {docs.schema['doc_id'].dataType.simpleString()}, digest binary, n int, fp bigint, keys array<bigint>, sketch binary")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The sorted rows of each (key, _lo, _hi); small groups travel together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        t = pa.Table.from_batches(held).combine_chunks()
        k, lo, hi = (t.column(c).to_numpy() for c in range(3))
        ends = np.flatnonzero((k[1:] != k[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1
        if len(ends):
            yield t.slice(0, ends[-1])
            t = t.slice(ends[-1])
        held = t.to_batches()
    if held:
        yield pa.Table.from_batches(held)


class _Bucket:
    """The classes of one bucket of table t, or of one tile of it: rows of a table (key, _lo, _hi, _chunk, t, rep, n, fp, keys, sketch).

    masks: the bits of each SimHash table; these tables are numbered up to -1, MinHash bands from 0.
    """

    def __init__(self, rows: pa.Table, masks: list[int]):
        self.m, self.t = rows.num_rows, rows.column("t")[0].as_py()
        self.n = rows.column("n").to_numpy()
        self.fp = rows.column("fp").to_numpy().view(np.uint64)
        if self.t >= 0:
            self.keys = np.asarray(rows.column("keys").combine_chunks().flatten()).reshape(self.m, -1)
            self.sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(self.m, -1)
        self.chunk = rows.column("_chunk").to_numpy() if rows.column("_lo")[0].as_py() != rows.column("_hi")[0].as_py() else None
        if self.t < 0:
            self.earlier = np.array(masks[: self.t + len(masks)], np.uint64)
            i, j = near_pairs(self.fp, RADIUS)
            order = np.lexsort((j, i))
            self.near, self.ends = j[order], np.searchsorted(i[order], np.arange(self.m + 1))

    def candidates(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows after i that may be similar and met i in no earlier table, and how alike they look."""
        j = np.arange(i + 1, self.m) if self.t >= 0 else self.near[self.ends[i] : self.ends[i + 1]]
        if self.chunk is not None:  # pairs inside a chunk are another tile's
            j = j[self.chunk[j] != self.chunk[i]]
        j = j[np.minimum(self.n[j], self.n[i]) >= SIMILAR * np.maximum(self.n[j], self.n[i])]
        apart = self.fp[j] ^ self.fp[i]
        if self.t < 0:
            j = j[((apart[:, None] & self.earlier) != 0).all(axis=1)]
            return j, 64.0 - np.bitwise_count(self.fp[j] ^ self.fp[i])
        j = j[np.bitwise_count(apart) > RADIUS]  # SimHash has named the others
        if self.t:
            j = j[~(self.keys[j, : self.t] == self.keys[i, : self.t]).any(axis=1)]
        share = (self.sketch[j] == self.sketch[i]).mean(axis=1)
        return j[share >= AGREE], share[share >= AGREE]


def _live(rows: pa.Table, masks: list[int]) -> pa.RecordBatch | None:
    """The rows that have a candidate."""
    bucket, some = _Bucket(rows, masks), np.zeros(rows.num_rows, bool)
    for i in range(bucket.m - 1):
        j, _ = bucket.candidates(i)
        some[j] = True
        some[i] |= len(j) > 0
    return rows.filter(pa.array(some)).select(["key", "t", "rep", "n", "fp", "keys", "sketch"]).combine_chunks().to_batches()[0] if some.any() else None


def _joined(rows: pa.Table, masks: list[int]) -> pa.RecordBatch | None:
    """A forest (a, b) of the classes whose sets (column set, sorted) are similar enough."""
    bucket, sets = _Bucket(rows, masks), rows.column("set").combine_chunks()
    ends, flat, reps = sets.offsets.to_numpy(), sets.values.to_numpy(), rows.column("rep").to_numpy()
    at, a, b = list(range(bucket.m)), [], []

    def root(i: int) -> int:
        while at[i] != i:
            at[i] = at[at[i]]
            i = at[i]
        return i

    for i in range(bucket.m - 1):
        j, share = bucket.candidates(i)
        x = flat[ends[i] : ends[i + 1]]
        for k in j[np.argsort(-share, kind="stable")].tolist():
            if root(i) == root(k):
                continue
            y = flat[ends[k] : ends[k + 1]]
            both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) and len(y) else 0
            if both >= SIMILAR * (len(x) + len(y) - both):
                at[root(i)] = root(k)
                a.append(reps[i])
                b.append(reps[k])
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"]) if a else None


def _buckets(rows: DataFrame, tile: int, masks: list[int], one, schema: str) -> DataFrame:
    """``one`` applied to each bucket, or tile of a hot one, of rows (key, t, rep, n, fp, keys, sketch and more)."""
    names = ["key", "_lo", "_hi", "_chunk", *[c for c in rows.columns if c != "key"]]
    tiles = with_tiles(rows.withColumn("_h", F.xxhash64("rep")), "key", tile).repartition("key", "_lo", "_hi").sortWithinPartitions("key", "_lo", "_hi").select(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            k, lo, hi = (t.column(c).to_numpy() for c in range(3))
            cuts = np.flatnonzero((k[1:] != k[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(k)]):
                if e - s > 1 and (r := one(t.slice(s, e - s), masks)) is not None:
                    yield r

    return tiles.mapInArrow(run, schema)


def near_components(docs: DataFrame, tile: int = TILE) -> DataFrame:
    """(_node, doc_id, component) of every row; component is the least class (by its least node) reachable by links."""
    sig = cut(signatures(docs))
    classes = sig.groupBy("digest").agg(F.min("_node").alias("rep"), F.first("n").alias("n"), F.min("fp").alias("fp"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"), F.count("*").alias("size"))
    classes = cut(classes)
    masks = table_masks(blocks_for(classes.count(), RADIUS), RADIUS)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    bands = F.transform("keys", lambda x, t: F.struct(t.alias("t"), x.alias("key")))
    blocks = F.array(*[F.struct(F.lit(k - len(masks)).alias("t"), F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m).cast("bigint"))).alias("key")) for k, m in enumerate(signed)])
    rows = classes.select("rep", "n", "fp", "keys", "sketch", F.inline(F.concat(blocks, bands)))
    banded = F.col("t") >= 0  # SimHash tables need neither keys nor sketches
    rows = rows.withColumns({"keys": F.when(banded, F.col("keys")).otherwise(F.array().cast("array<bigint>")), "sketch": F.when(banded, F.col("sketch")).otherwise(F.lit(b""))})
    # a bucket of one class names no candidate
    full = rows.groupBy("key").agg(F.count("*").alias("_c")).where("_c > 1").select("key")
    rows = rows.join(full, "key", "left_semi").select("key", "t", "rep", "n", "fp", "keys", "sketch")
    live = cut(_buckets(rows, tile, masks, _live, "key bigint, t int, rep bigint, n int, fp bigint, keys array<bigint>, sketch binary").dropDuplicates(["key", "rep"]))
    wanted = live.select(F.col("rep").alias("_node")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            s = [shingles(t).view(np.int64) for t in b.column(1).cast(pa.binary()).to_pylist()]
            s = [np.sort(x) for x in s]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.list_(pa.int64()))], ["rep", "set"])

    sets = _node(docs).select("_node", "text").join(wanted, "_node", "left_semi").dropDuplicates(["_node"]).mapInArrow(run, "rep bigint, set array<bigint>")
    comp = components(_buckets(live.join(sets, "rep"), tile, masks, _joined, "a bigint, b bigint"))
    named = classes.join(comp, classes["rep"] == comp["node"], "left").select("digest", "size", F.coalesce("component", "rep").alias("component"))
    return hot_join(sig.select("_node", "doc_id", "digest"), named, ["digest"], "size", sig.count(), F.xxhash64("_node")).select("_node", "doc_id", "component")


def near_dedup_stage(docs: DataFrame, tile: int = TILE) -> DataFrame:
    """docs with one row of each component, all columns kept whatever their names.

    The row of the least id stays (one without an id only if its component has no other), of several texts with that id
    the one of the least node, and of rows that repeat both id and text that of the least hash of all columns.  Texts
    without a word, null and empty ones among them, are one component.
    """
    order = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("_node").alias("c"))
    keep = near_components(docs, tile).groupBy("component").agg(F.min(order)["c"].alias("_node")).select("_node")
    rows = whole_rows(docs, node(), row_hash(docs).alias("_r")).join(keep, "_node", "left_semi")
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("_node").orderBy("_r"))).where("_n = 1").select(f"{ROW}.*")
