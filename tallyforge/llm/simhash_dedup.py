"""SimHash near-dedup with bit-sliced comparison.

A 64-bit fingerprint per text; equal fingerprints form one class.  Two fingerprints at most ``radius`` bits apart agree
wholly on ``blocks - radius`` of ``blocks`` bit blocks, so every choice of so many blocks is one table of buckets and
no link is lost.  Inside a bucket the bit planes are stored vertically (bit p of 64 fingerprints is one word) and the
distances from a block of queries to all lanes grow together in carry-save counters.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, hot_join, slices, with_tiles

#: Rows of a bucket that one task compares at once; larger buckets are split into tiles.
TILE = 4096
#: Bits that one chunk of shingles unpacks at once.
CHUNK = 1 << 15


def fingerprint(text: str | bytes | None, width: int = 4, seed: int = 42) -> int:
    """SimHash over ``width``-word shingles of the text with A-Z lower-cased; unsigned.  No word: zero."""
    words = (text.encode() if isinstance(text, str) else text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        shingles = [joined]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = [0, *(ends[:-1]).tolist()]
        shingles = [joined[a:b] for a, b in zip(starts, (ends[width - 1 :] - 1).tolist())]
    h = np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in shingles), dtype=">u8", count=len(shingles))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), CHUNK):
        ones += np.unpackbits(h[i : i + CHUNK].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fp = np.fromiter((fingerprint(t, width, seed) for t in b.column(1).cast(pa.binary()).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    ids = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {ids}, fp bigint")


def near_pairs(fps: np.ndarray, radius: int, rows: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs i < j of uint64 fps at most ``radius`` (0 to 6) bits apart, by vertical bit planes."""
    m = len(fps)
    words = -(-m // 64)
    bits = np.zeros((64, words * 64), np.uint8)
    bits[:, :m] = np.unpackbits(fps.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).T
    planes = np.packbits(bits, axis=1, bitorder="little").view("<u8")  # plane p: bit p of 64 fingerprints a word
    lanes = np.arange(words * 64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    flip = np.uint64(0xFFFFFFFFFFFFFFFF)
    for at in range(0, m, rows):
        q = np.arange(at, min(m, at + rows))
        first = at // 64  # lanes before the first query are of no use
        # lanes at or before the query, and those of no fingerprint, count as gone from the start
        over = np.packbits((lanes[None, first * 64 :] <= q[:, None]) | (lanes[None, first * 64 :] >= m), axis=1, bitorder="little").view("<u8")
        c0, c1, c2 = (np.zeros_like(over) for _ in range(3))
        mask = np.where(bits[:, q].astype(bool), flip, np.uint64(0))
        for p in range(0, 64, 2):
            x = planes[p, first:] ^ mask[p][:, None]
            y = planes[p + 1, first:] ^ mask[p + 1][:, None]
            half = c0 ^ x
            carry = (c0 & x) | (half & y)  # carry-save: three bits of weight one become one of one and one of two
            c0 = half ^ y
            t = c1 & carry
            c1 ^= carry
            over |= c2 & t
            c2 ^= t
            if p % 16 == 14:
                beyond = over | _more(c0, c1, c2, radius)
                live = ~(beyond == flip).all(axis=1)
                if not live.any():
                    q = q[:0]
                    break
                if live.sum() < 0.7 * len(q):  # abandon the queries whose lanes all exceed the radius
                    q, over, c0, c1, c2, mask = q[live], over[live], c0[live], c1[live], c2[live], mask[:, live]
        if len(q):
            near = ~(over | _more(c0, c1, c2, radius))
            i, j = np.nonzero(np.unpackbits(near.view(np.uint8), axis=1, bitorder="little"))
            if len(i):
                found.append((q[i], j + first * 64))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _more(c0: np.ndarray, c1: np.ndarray, c2: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose three-bit counters are above radius."""
    out = np.zeros_like(c0)
    for v in range(radius + 1, 8):
        out |= (c0 if v & 1 else ~c0) & (c1 if v & 2 else ~c1) & (c2 if v & 4 else ~c2)
    return out


def forest(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star per component of the links (i, j) between positions of ids: at most one edge an id, no pair expanded."""
    label = np.arange(len(ids))
    while len(i):
        a, b = label[i], label[j]
        low = np.minimum(a, b)
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    own = label != np.arange(len(ids))
    return ids[own], ids[label[own]]


def table_masks(blocks: int, radius: int) -> list[int]:
    """One 64-bit mask for each choice of blocks - radius of the blocks."""
    cuts = [round(64 * b / blocks) for b in range(blocks + 1)]
    part = [((1 << cuts[b + 1]) - 1) ^ ((1 << cuts[b]) - 1) for b in range(blocks)]
    return [sum(part[b] for b in chosen) for chosen in combinations(range(blocks), blocks - radius)]


def blocks_for(n: int, radius: int, bucket: int = 2048) -> int:
    """The fewest blocks with n / 2**(bits of a table's key) at most ``bucket`` rows; any number finds every link."""
    b = radius + 1
    while n / 2 ** (64 * (b - radius) / b) > bucket and b < radius + 5:
        b += 1
    return b


def class_links(classes: DataFrame, radius: int = 4, tile: int = TILE) -> DataFrame:
    """Star edges (a, b) between ids of classes (fp long, rep id) whose fingerprints are within the radius."""
    masks = table_masks(blocks_for(classes.count(), radius), radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    rows = classes.select("fp", "rep", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.lit(m).cast("bigint").alias("m")) for t, m in enumerate(signed)])).alias("_m"))
    rows = rows.select("fp", "rep", F.xxhash64("_m.t", F.col("fp").bitwiseAND(F.col("_m.m"))).alias("key"), F.xxhash64("fp").alias("_h"))
    tiles = with_tiles(rows, "key", tile).repartition("key", "_lo", "_hi").sortWithinPartitions("key", "_lo", "_hi").select("key", "_lo", "_hi", "fp", "rep")
    kind = classes.schema["rep"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(fps: np.ndarray, reps: np.ndarray) -> pa.RecordBatch:
            a, b = forest(reps, *near_pairs(fps, radius))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for fps, reps in _whole_groups(batches):
            if len(fps) > 1:
                yield links(fps, reps)

    return tiles.mapInArrow(run, f"a {kind}, b {kind}").distinct()


def _whole_groups(batches: Iterator[pa.RecordBatch], least: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of sorted rows cut only between groups; small groups travel together (a link across them is still true)."""
    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        held.append(tuple(batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)))
        k, lo, hi, fp, rep = (np.concatenate([h[c] for h in held]) for c in range(5))
        ends = np.flatnonzero((k[1:] != k[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1
        at = 0
        for e in ends:
            if e - at >= least:
                yield fp[at:e].view(np.uint64), rep[at:e]
                at = e
        held = [(k[at:], lo[at:], hi[at:], fp[at:], rep[at:])]
    if held and len(held[0][0]):
        yield held[0][3].view(np.uint64), held[0][4]


def simhash_classes(docs: DataFrame, radius: int = 4, width: int = 4) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of every row and (fp, component_id, size) of every different fingerprint."""
    fps = cut(fingerprints(docs, width))
    classes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size")))
    comp = components(class_links(classes.where("rep is not null"), radius))
    out = classes.join(comp, classes["rep"] == comp["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"), "size")
    return fps, out


def simhash_dedup(docs: DataFrame, radius: int = 4, width: int = 4) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable by links).

    Null and empty texts have fingerprint zero and link like any other.  Fewer words than a shingle: the whole
    sequence is the one shingle.  Rows with a null id get the component of their fingerprint's least id.  Extra
    columns are not read.
    """
    fps, classes = simhash_classes(docs, radius, width)
    return hot_join(fps, classes, ["fp"], "size", fps.count(), F.xxhash64("doc_id")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
