"""Embedding near-dedup: iterative quantisation, multi-index Hamming tables, rerank by the original vectors.

Equal vectors form one class.  A rotation learned by iterative quantisation (Gong and Lazebnik, 2011) on a bounded
sample turns vectors into balanced bits; several rotations from different starts give as many bits as the tables need.
Each table indexes one substring of the code.  Retrieval reads only ids and codes: rows that share a substring are
candidates if their whole codes are within the Hamming radius.  Vectors are fetched for rows with a candidate only, and
the candidates are compared by cosine in double precision.  A pair is counted in the first table it shares, so link
counts add up without listing pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, cut, hot_join, with_tiles
from .simhash_dedup import forest

#: Rows of a bucket that one task compares at once; larger buckets are split into tiles.
TILE = 1024
#: Bounds of the sample that rotations are learned on: rows, and numbers in all.
SAMPLE_ROWS, SAMPLE_NUMBERS = 20_000, 4_000_000


@dataclass
class Index:
    mean: np.ndarray
    rotations: list[np.ndarray]
    bits: int
    tables: int
    radius: int = 0

    @property
    def size(self) -> int:
        return self.bits * self.tables

    def code(self, x: np.ndarray) -> np.ndarray:
        """Codes (rows, size) of unit rows x, as booleans."""
        return np.concatenate([(x - self.mean) @ r > 0 for r in self.rotations], axis=1)[:, : self.size]

    def keys(self, code: np.ndarray) -> np.ndarray:
        """Table keys (rows, tables): the substrings of the codes."""
        return (code.reshape(len(code), self.tables, self.bits) * (1 << np.arange(self.bits))).sum(axis=2).astype(np.int64)

    def pack(self, code: np.ndarray) -> np.ndarray:
        """Codes as words (rows, words) of 64 bits."""
        wide = np.zeros((len(code), -(-self.size // 64) * 64), bool)
        wide[:, : self.size] = code
        return np.packbits(wide, axis=1, bitorder="little").view("<u8")

    def unpack(self, words: np.ndarray) -> np.ndarray:
        return np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1, bitorder="little")[:, : self.size].astype(bool)


def learn_rotation(x: np.ndarray, rng: np.random.Generator, rounds: int = 20) -> np.ndarray:
    """Orthogonal r that brings sign(x r) near x r: alternate binary codes and the orthogonal Procrustes problem."""
    r = np.linalg.qr(rng.standard_normal((x.shape[1], x.shape[1])))[0]
    for _ in range(rounds):
        b = np.where(x @ r > 0, 1.0, -1.0)
        u, _, v = np.linalg.svd(x.T @ b)
        r = u @ v
    return r


def fit_index(sample: np.ndarray, rows: int, threshold: float, recall: float = 0.995, seed: int = 7) -> Index:
    """Rotations, bits a table and number of tables for ``rows`` vectors.

    Bits grow with log2(rows), so buckets stay of one size; tables follow from how often a made-up neighbour at exactly
    the threshold shares a table, measured on the sample, so that ``recall`` of such pairs share one.  The radius is a
    bit more than the farthest that a code of those neighbours is from its own.
    """
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    if dim == 1:
        return Index(np.zeros(1), [np.eye(1)], 1, 1, 1)
    bits = int(min(62, max(6, math.ceil(math.log2(max(1, rows) / 128)))))
    noise = rng.standard_normal(sample.shape)
    noise -= (noise * sample).sum(axis=1, keepdims=True) * sample
    near = threshold * sample + math.sqrt(1 - threshold**2) * noise / np.linalg.norm(noise, axis=1, keepdims=True)
    best = None
    for mean in (sample.mean(axis=0), np.zeros(dim)):  # centred bits are balanced, but may tell near vectors apart
        rotations = [learn_rotation(sample - mean, rng) for _ in range(max(1, min(4, math.ceil(bits / dim))))]
        agree = float(np.mean([((sample - mean) @ r > 0) == ((near - mean) @ r > 0) for r in rotations]))
        tables = max(1, math.ceil(math.log(1 - recall) / math.log(1 - min(0.999, agree**bits))))
        if best is None or tables < 0.7 * best.tables:
            best = Index(mean, rotations, bits, tables)
    while len(best.rotations) * dim < best.bits * best.tables:
        best.rotations.append(learn_rotation(sample - best.mean, rng))
    far = int((best.code(sample) != best.code(near)).sum(axis=1).max())
    best.radius = far + 2 + best.size // 50
    return best


def usable(v: Column) -> Column:
    """Vector present, every component present and finite, not all zero."""
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)


def _unit(col: pa.Array) -> np.ndarray:
    x = np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(col), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def candidates(index: Index, words: np.ndarray, t: int, cross: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j of one bucket of table t that are within the radius and share no earlier table, by blocks.

    cross: chunk of each row, where the bucket is a tile of two chunks and only pairs across them are its own.
    """
    m, keys = len(words), index.keys(index.unpack(words)) if t else None
    for a in range(0, m, 512):
        for b in range(a, m, 512):
            far = np.zeros((min(512, m - a), min(512, m - b)), np.int32)
            for w in range(words.shape[1]):
                far += np.bitwise_count(words[a : a + 512, None, w] ^ words[None, b : b + 512, w])
            near = far <= index.radius
            if a == b:
                near = np.triu(near, 1)
            i, j = np.nonzero(near)
            i, j = i + a, j + b
            if cross is not None and len(i):
                own = cross[i] != cross[j]
                i, j = i[own], j[own]
            if t and len(i):
                first = ~(keys[i, :t] == keys[j, :t]).any(axis=1)
                i, j = i[first], j[first]
            if len(i):
                yield i, j


def _buckets(rows: DataFrame, tile: int, more: list[str], one: Callable[[pa.Table], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``one`` applied to each bucket, or tile of a hot one, of rows (key, t, rep, words and ``more``)."""
    rows = with_tiles(rows.withColumn("_h", F.xxhash64("rep")), "key", tile).repartition("key", "_lo", "_hi").sortWithinPartitions("key", "_lo", "_hi").select("key", "_lo", "_hi", "_chunk", "t", "rep", "words", *more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now]).combine_chunks()
            k, lo, hi = (held.column(c).to_numpy() for c in ("key", "_lo", "_hi"))
            ends = np.flatnonzero((k[1:] != k[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1
            at = 0
            for e in ends.tolist():
                if e - at > 1 and (r := one(held.slice(at, e - at))) is not None:
                    yield r
                at = e
            held = held.slice(at)
        if held is not None and held.num_rows > 1 and (r := one(held)) is not None:
            yield r

    return rows.mapInArrow(run, schema)


def class_links(classes: DataFrame, index: Index, threshold: float, tile: int = TILE) -> DataFrame:
    """Rows (a, w, b): class a has links to w more vectors (b null), or a star edge of linked classes (w zero).

    classes: rep, size, vec.
    """
    kind, width = classes.schema["rep"].dataType.simpleString(), -(-index.size // 64)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            c = index.code(_unit(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in index.pack(c)]), pa.FixedSizeListArray.from_arrays(pa.array(index.keys(c).ravel()), index.tables).cast(pa.list_(pa.int64()))], ["rep", "words", "keys"])

    def table(part: pa.Table) -> tuple[np.ndarray, int, np.ndarray | None]:
        words = np.frombuffer(b"".join(part.column("words").to_pylist()), "<u8").reshape(part.num_rows, width)
        cross = part.column("_chunk").to_numpy() if part.column("_lo")[0].as_py() != part.column("_hi")[0].as_py() else None
        return words, part.column("t")[0].as_py(), cross

    def live(part: pa.Table) -> pa.RecordBatch | None:
        words, t, cross = table(part)
        some = np.zeros(part.num_rows, bool)
        for i, j in candidates(index, words, t, cross):
            some[i] = some[j] = True
        p = part.filter(pa.array(some)).select(["key", "t", "rep", "words"]).combine_chunks()
        return p.to_batches()[0] if some.any() else None

    def links(part: pa.Table) -> pa.RecordBatch | None:
        words, t, cross = table(part)
        x, size, reps = _unit(part.column("vec").combine_chunks()), part.column("size").to_numpy(), part.column("rep").to_numpy()
        w, pi, pj = np.zeros(part.num_rows, np.int64), [], []
        for i, j in candidates(index, words, t, cross):
            step = max(1, (1 << 20) // x.shape[1])
            for at in range(0, len(i), step):
                p, q = i[at : at + step], j[at : at + step]
                close = np.einsum("ij,ij->i", x[p], x[q]) >= threshold
                p, q = p[close], q[close]
                np.add.at(w, p, size[q])
                np.add.at(w, q, size[p])
                pi.append(p)
                pj.append(q)
        if not w.any():
            return None
        a, b = forest(reps, np.concatenate(pi), np.concatenate(pj))
        some = w > 0
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate((reps[some], a))), pa.array(np.concatenate((w[some], np.zeros(len(a), np.int64)))), pa.array([None] * int(some.sum()) + b.tolist(), pa.from_numpy_dtype(reps.dtype))], ["a", "w", "b"])

    slim = classes.select("rep", "vec").mapInArrow(code, f"rep {kind}, words binary, keys array<bigint>")
    slim = slim.select("rep", "words", F.posexplode("keys").alias("t", "k")).select("rep", "words", "t", (F.col("k") * index.tables + F.col("t")).alias("key"))
    # a row of a hot bucket is found in several of its tiles
    found = _buckets(slim, tile, [], live, f"key bigint, t int, rep {kind}, words binary").dropDuplicates(["key", "rep"])
    return _buckets(found.join(classes.select("rep", "size", "vec"), "rep"), tile, ["size", "vec"], links, f"a {kind}, w bigint, b {kind}")


def embedding_dedup(vectors: DataFrame, threshold: float = 0.95, seed: int = 7) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero or hold a null or non-finite component link with nothing: no links, their own
    component, kept.  Vectors of different lengths do not link.  Equal vectors (repeated rows too) link with each
    other; a row with a null id counts as a link of its copies but heads no component.  Extra columns are not read.
    """
    v = vectors.select("vec_id", F.col("embedding").alias("vec"))
    ok = usable(F.col("vec"))
    classes = cut(v.where(ok).groupBy("vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size")))
    found = None
    for dim, rows in sorted((r["d"], r["count"]) for r in classes.groupBy(F.size("vec").alias("d")).count().collect()):
        own = classes.where((F.size("vec") == dim) & F.col("rep").isNotNull())
        bound = min(SAMPLE_ROWS, max(64, SAMPLE_NUMBERS // dim))
        sample = own.orderBy(F.xxhash64("rep", F.lit(seed))).limit(bound).select("vec").toArrow().column("vec").combine_chunks()
        if not len(sample):
            continue
        links = class_links(own, fit_index(_unit(sample), rows, threshold, seed=seed), threshold)
        found = links if found is None else found.unionByName(links)
    if found is None:
        return v.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = cut(found)
    comp = components(found.where("b is not null").select("a", "b"))
    more = found.where("b is null").groupBy("a").agg(F.sum("w").alias("w"))
    done = classes.join(more, classes["rep"] == more["a"], "left").join(comp, classes["rep"] == comp["node"], "left")
    done = done.select("vec", "size", (F.col("size") - 1 + F.coalesce("w", F.lit(0))).alias("_links"), F.coalesce("component", "rep").alias("_comp"))
    total = classes.agg(F.sum("size")).first()[0]
    out = hot_join(v.where(ok), done, ["vec"], "size", total, F.xxhash64("vec_id")).select("vec_id", F.col("_links").cast("long").alias("n_links"), F.coalesce("_comp", "vec_id").alias("component_id"))
    alone = v.where(~ok).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
