"""Substring dedup by super-k-mer partitioning.

A window is ``width`` consecutive words of one document.  Its minimiser is the least hash among its ``gram``-word
grams; consecutive windows that share it form one super-k-mer.  Three passes, none of which broadcasts anything:

1. places: where each minimiser occurs, one row per minimiser and block of documents.  A minimiser that occurs once in
   the corpus needs no text to travel: its windows occur once.  ``many`` or more places in one block are a part of
   their own: only a row without places goes where the minimiser is counted, and makes it hot there.
2. strings: the other super-k-mers leave their documents as one packed string each, for the bucket of their minimiser.
   Copies within a block are settled before the shuffle.  The windows of a hot minimiser (``hot`` or more occurrences,
   or ``many`` in some block) are dealt singly by the hash of the whole window, so that a passage in a third of all
   documents fills no bucket.
3. buckets: sorting the windows of a bucket by their words, then by document and start, puts each sequence's first
   occurrence first; the others are reported as ranges to their documents.

Hashes only choose buckets; windows are compared by their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices

WORD_CACHE = 1 << 19
_M1, _M2, _P = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    """word -> 64-bit hash; forgotten as a whole when full, so memory is bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def super_kmers(words: list[bytes], width: int, gram: int, hashes: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, start, windows) of each maximal run of windows that share a minimiser.

    Where a minimiser's gram occurs again in the text, windows of one run may be equal: an entry of no windows follows,
    so that its run counts twice.
    """
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    g = h[: len(h) - gram + 1].copy()
    for k in range(1, gram):
        g = g * _P + h[k : len(h) - gram + 1 + k]
    for m in (_M1, _M2):  # finalise, so that order among grams is as good as random
        g = (g ^ (g >> np.uint64(33))) * m
    span, low, have = width - gram + 1, g, 1
    while have < span:  # least of `have` neighbours, doubled until it covers a window
        step = min(have, span - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    at = np.concatenate(([0], np.flatnonzero(low[1:] != low[:-1]) + 1))
    mm, size = low[at], np.diff(np.append(at, n))
    ordered = np.sort(g)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if len(again) and (more := np.isin(mm, again)).any():
        mm, at, size = np.concatenate((mm, mm[more])), np.concatenate((at, at[more])), np.concatenate((size, np.zeros(more.sum(), np.int64)))
    return mm, at.astype(np.int32), size.astype(np.int32)


def _places(width: int, gram: int, many: int):
    """Rows (mm, part, occ): part is 0 but for rows of ``many`` or more places; these have a row (mm, 0, none) beside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for b in batches:
            ids, mm, start, size = b.column(0), [], [], []
            for t in b.column(1).cast(pa.binary()).to_pylist():
                m, s, k = super_kmers((t or b"").split(), width, gram, hashes)
                mm.append(m)
                start.append(s)
                size.append(k)
            if not mm:
                continue
            doc = np.repeat(np.arange(len(mm)), [len(m) for m in mm])
            mm, start, size = np.concatenate(mm), np.concatenate(start), np.concatenate(size)
            if not len(mm):
                continue
            by = np.argsort(mm, kind="stable")
            cut = np.concatenate(([0], np.flatnonzero(mm[by][1:] != mm[by][:-1]) + 1, [len(mm)])).astype(np.int32)
            place = pa.StructArray.from_arrays([ids.take(pa.array(doc[by])), pa.array(start[by]), pa.array(size[by])], ["d", "s", "n"])
            keys = mm[by][cut[:-1]].view(np.int64)
            part = np.zeros(len(keys), np.int64)
            big = np.flatnonzero(np.diff(cut) >= many)
            for i in big:  # named by its first place, so that a repeated task names it alike
                first = place[int(cut[i])].as_py()
                part[i] = (xxhash.xxh64_intdigest(f"{first['d']}:{first['s']}:{keys[i]}") >> 1) | 1
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part), pa.ListArray.from_arrays(pa.array(cut), place)], ["mm", "part", "occ"])
            if len(big):
                none = pa.ListArray.from_arrays(pa.array(np.zeros(len(big) + 1, np.int32)), place[:0])
                yield pa.RecordBatch.from_arrays([pa.array(keys[big]), pa.array(np.zeros(len(big), np.int64)), none], ["mm", "part", "occ"])

    return run


def _strings(width: int, hot: int):
    """Rows (key, d, s, n, packed); packed is null for windows already known to have an earlier copy in the block, n is 0
    for a single window of a hot minimiser."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            units: dict[tuple[int, bytes, bool], list[tuple]] = {}
            for d, text, occ in zip(ids, b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist()):
                words = (text or b"").split()
                for o in occ:
                    s, n = o["s"], o["n"]
                    if o["total"] < hot:
                        units.setdefault((o["mm"], b" ".join(words[s : s + n + width - 1]), False), []).append((d, s, n))
                    else:
                        for i in range(s, s + n):
                            w = b" ".join(words[i : i + width])
                            units.setdefault((xxhash.xxh64_intdigest(w) - (1 << 63), w, True), []).append((d, i, 1))
            key, dd, ss, nn, packed, known = [], [], [], [], [], {}
            for (k, w, single), places in units.items():
                first = min(places)
                key.append(k)
                packed.append(w)
                dd.append(first[0])
                ss.append(first[1])
                nn.append(0 if single else first[2])
                for p in places:
                    if p[:2] != first[:2]:
                        known.setdefault(p[0], []).append(p[1:])
            for d, found in known.items():
                for s, e in merged(found):
                    key.append(xxhash.xxh64_intdigest(str(d)) - (1 << 63))
                    packed.append(None)
                    dd.append(d)
                    ss.append(s)
                    nn.append(e - s)
            if key:
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(dd, b.schema.field(0).type), pa.array(ss, pa.int32()), pa.array(nn, pa.int32()), pa.array(packed, pa.binary())], ["key", "d", "s", "n", "packed"])

    return run


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(start, length) ranges as sorted disjoint (start, end)."""
    out: list[list[int]] = []
    for s, n in sorted(ranges):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s + n)
        else:
            out.append([s, s + n])
    return [(s, e) for s, e in out]


def _bucket(rows: list[tuple], width: int) -> list[tuple]:
    """(d, s, n) of the windows in rows (d, s, n, packed) that are not the first of their words."""
    windows = []
    for d, s, n, packed in rows:
        if n == 1:
            windows.append((packed, d, s))
            continue
        words = packed.split()
        windows.extend((b" ".join(words[i : i + width]), d, s + i) for i in range(n))
    windows.sort()
    out, words, first = [], None, None
    for w, d, s in windows:
        if w != words:
            words, first = w, (d, s)
        elif (d, s) != first:
            out.append((d, s, 1))
    return out


def _buckets(width: int):
    """Runs (d, s, n) of windows with an earlier copy, from rows sorted by key, packed, d and s.

    Held are only the rows of one minimiser that is not hot, of which there are few; a hot window's rows stand together
    with the first place in front, so that only this one is kept, whatever the number of blocks that hold the window.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, held, last, window, place = None, [], None, None, None

        def out(found: list[tuple]) -> pa.RecordBatch:
            by: dict = {}
            for d, s, n in found:
                by.setdefault(d, []).append((s, n))
            flat = [(d, s, e - s) for d, r in by.items() for s, e in merged(r)]
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in flat], kind), pa.array([x[1] for x in flat], pa.int32()), pa.array([x[2] for x in flat], pa.int32())], ["d", "s", "n"])

        for b in batches:
            kind, found = b.schema.field(1).type, []
            for k, d, s, n, packed in zip(*(b.column(c).to_pylist() for c in range(5))):
                if packed is None:
                    found.append((d, s, n))
                elif n == 0:
                    if packed != window:
                        window, place = packed, (d, s)
                    elif (d, s) != place:
                        found.append((d, s, 1))
                else:
                    if k != last:
                        if held and (len(held) > 1 or held[0][2] > 1):
                            found += _bucket(held, width)
                        held, last = [], k
                    held.append((d, s, n, packed))
            if found:
                yield out(found)
        if held and (found := _bucket(held, width)):
            yield out(found)

    return run


def removed_ranges(docs: DataFrame, width: int = 20, gram: int = 4, hot: int = 512, many: int = 64) -> DataFrame:
    """(d, r): per document with repeated windows, the array of (s, n) runs of windows that occur earlier."""
    ids = docs.schema["doc_id"].dataType.simpleString()
    d = docs.where("doc_id is not null").select("doc_id", "text")
    places = d.mapInArrow(_places(width, gram, many), f"mm bigint, part bigint, occ array<struct<d:{ids},s:int,n:int>>")
    n = F.when((F.col("part") == 0) & (F.size("occ") > 0), F.size("occ")).otherwise(F.lit(max(2, hot)))
    places = places.withColumn("total", F.sum(n).over(Window.partitionBy("mm", "part"))).where("total > 1")
    by_doc = places.select("mm", "total", F.explode("occ").alias("o")).where("o.n > 0").groupBy(F.col("o.d").alias("_d")).agg(F.collect_list(F.struct("mm", "total", "o.s", "o.n")).alias("occ"))
    strings = d.join(by_doc, d["doc_id"] == by_doc["_d"]).select("doc_id", "text", "occ").mapInArrow(_strings(width, hot), f"key bigint, d {ids}, s int, n int, packed binary")
    found = strings.repartition("key").sortWithinPartitions("key", "packed", "d", "s").mapInArrow(_buckets(width), f"d {ids}, s int, n int")
    return found.groupBy("d").agg(F.collect_list(F.struct("s", "n")).alias("r"))


def keep_words(words: list[bytes], runs: list[tuple[int, int]], width: int) -> list[bytes]:
    """The words that no window of runs (start, windows) covers."""
    out, at = [], 0
    for s, e in merged([(s, n + width - 1) for s, n in runs]):
        out += words[at:s]
        at = e
    return out + words[at:]


def substring_dedup(docs: DataFrame, width: int = 20, gram: int = 4, hot: int = 512, many: int = 64) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256, kept_text (kept words joined by one space).

    doc_id is the key: rows that repeat it with one text are one document, none the copy of the other; with different
    texts the runs found in any of them are taken from all.  Rows without an id lose nothing and take nothing from
    others.  A null or empty text has no words, an empty table gives an empty
    one.  Of windows that tie in words the one with the smaller id, then the earlier start, stays.  A text is read whole in
    one task, whatever its length, for time linear in it.  Extra columns are not read.
    """
    d = docs.where("doc_id is not null").select("doc_id", "text")
    r = removed_ranges(docs, width, gram, hot, many)
    kinds = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            total, gone, sha, kept_text = [], [], [], []
            for text, runs in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist()):
                words = (text or b"").split()
                kept = keep_words(words, [(x["s"], x["n"]) for x in runs], width) if runs else words
                joined = b" ".join(kept)
                total.append(len(words))
                gone.append(len(words) - len(kept))
                sha.append(hashlib.sha256(joined).hexdigest())
                kept_text.append(joined)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(kept_text, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    schema = f"doc_id {kinds}, n_words bigint, n_removed bigint, kept_sha256 string, kept_text string"
    kept = d.join(r, d["doc_id"] == r["d"], "left").select("doc_id", "text", "r")
    alone = docs.where("doc_id is null").select("doc_id", "text", F.lit(None).cast("array<struct<s:int,n:int>>").alias("r"))
    return kept.unionByName(alone).mapInArrow(run, schema)
