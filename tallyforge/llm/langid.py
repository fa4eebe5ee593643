"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1.  A trigram's vector binds its letters' vectors, permuted by their place
(elementwise product of cyclic shifts); a text's vector bundles (sums) its trigrams; a language's prototype bundles the
unit vectors of its documents.  A text gets the language of the nearest prototype by cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fold, slices

DIM, N = 1024, 3
#: Learning documents a language, about; those with the least hashes.
PER_LANGUAGE = 4_000
#: Languages whose rates (one short row each) are broadcast; beyond, they are joined by shuffle.
BROADCAST = 10_000
#: Languages whose prototypes are held at once (of 8 KB each); more are compared in several passes over the texts.
GROUP = 2_000
#: Vectors of letters: own ones for the first code points, shared ones beyond.
OWN, SHARED = 1536, 512
#: Code points of a text that are taken at once: memory does not grow with the text.
BLOCK = 1 << 15


class Encoder:
    def __init__(self, dim: int = DIM, seed: int = 3):
        letters = np.random.default_rng(seed).integers(0, 2, (OWN + SHARED, dim), np.int8) * np.int8(2) - np.int8(1)
        letters[32] = np.roll(letters[OWN], 1)  # the gap between words is a letter of its own
        self.shifted = [np.roll(letters, N - 1 - k, axis=1) for k in range(N)]
        self.letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)

    def grams(self, text: str | None, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of each block of a text: its different trigrams (as codes of three letters) and how often each occurs.

        Nothing for a text without a letter.  Trigrams across blocks are counted in the later one.
        """
        low, before, some = (text or "").lower(), np.array([32], np.int64), False
        held = []
        for i in range(0, len(low), block):
            c = np.frombuffer(low[i : i + block].encode("utf-32-le", "surrogatepass"), np.uint32)
            ok = self.letter[c]
            some = some or bool(ok.any())
            c = np.where(ok, np.where(c < OWN, c, OWN + c % SHARED), 32)
            c = np.concatenate((before, c, [32] if i + block >= len(low) else [])).astype(np.int64)
            c = c[np.concatenate(([True], (c[1:] != 32) | (c[:-1] != 32)))]  # one gap, however long
            g = (c[:-2] << 22) | (c[1:-1] << 11) | c[2:]
            before = c[-2:]
            held.append(np.unique(g, return_counts=True))
            if some:  # until a letter is found the blocks are gaps only
                yield from held
                held = []

    def encode(self, text: str | None, block: int = 1024) -> np.ndarray | None:
        """Unit vector of a text, None if it has no letter."""
        out = None
        for g, n in self.grams(text):
            out = np.zeros(self.shifted[0].shape[1]) if out is None else out
            for i in range(0, len(g), block):
                p = g[i : i + block]
                v = self.shifted[0][p >> 22] * self.shifted[1][(p >> 11) & 2047] * self.shifted[2][p & 2047]
                out += n[i : i + block].astype(np.float32) @ v.astype(np.float32)
        return None if out is None else out / max(float(np.linalg.norm(out)), 1e-12)


@lru_cache(4)
def encoder(dim: int) -> Encoder:
    """One a process: letters are drawn once, not for every task."""
    return Encoder(dim)


def prototypes(docs: DataFrame, per_language: int = PER_LANGUAGE, dim: int = DIM) -> DataFrame:
    """(lang, v array<bigint>): the bundled vector of every language that has a learning document with a letter.

    A language's documents are taken at a rate that gives about ``per_language`` of them (all, if it has fewer), by
    hash of the id.  Sums are added by Spark per language and component.
    """
    train = docs.where(F.col("lang").isNotNull() & (fold(F.col("doc_id"), 4) != 2)).select("doc_id", "text", "lang")
    rate = cut(train.groupBy(F.col("lang").alias("_l")).agg((F.lit(float(per_language)) / F.count("*")).alias("_rate")))
    if rate.count() <= BROADCAST:  # texts stay where they are read; a shuffle by language would put a third of them in one task
        rate = F.broadcast(rate)
    u = F.pmod(F.xxhash64("doc_id", F.lit(31)), F.lit(1 << 20)) / float(1 << 20)
    some = train.join(rate, train["lang"] == rate["_l"]).where(u < F.col("_rate")).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sums() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([v.tolist() for v in total.values()], pa.list_(pa.int64()))], ["lang", "v"])

        e, total = encoder(dim), {}
        for b in slices(batches):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if (v := e.encode(text)) is not None:
                    # sums of integers do not depend on the order of rows
                    total[lang] = total.get(lang, 0) + np.round(v * (1 << 30)).astype(np.int64)
            if len(total) > 64:  # many languages: no task holds them all
                yield sums()
                total = {}
        if total:
            yield sums()

    sums = some.mapInArrow(run, "lang string, v array<bigint>").select("lang", F.posexplode("v").alias("k", "x")).groupBy("lang", "k").agg(F.sum("x").alias("x"))
    return sums.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda p: p["x"]).alias("v"))


def language_id(docs: DataFrame, per_language: int = PER_LANGUAGE, dim: int = DIM, group: int = GROUP) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score (cosine with the chosen prototype, at least 0).

    A null text, one without a letter, or any text if nothing could be learned, is ``und`` with score 0; ties go to
    the first language by name.  Only ``text`` is an input of a prediction.  The driver holds the prototypes of about
    ``group`` languages at a time; each further group is one more pass over the texts.
    """
    learned = cut(prototypes(docs, per_language, dim))
    parts = max(1, -(-learned.count() // group))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.lit(None).cast("string").alias("lang_pred"), F.lit(0.0).alias("score"))
    for part in range(parts):
        protos = {r["lang"]: np.array(r["v"], np.float64) for r in learned.where(F.pmod(F.xxhash64("lang"), F.lit(parts)) == part).collect()}
        protos = {k: v / n for k, v in sorted(protos.items()) if (n := np.linalg.norm(v)) > 0}
        rows = _nearest(rows, protos, dim, kind, part == parts - 1)
    return rows.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), F.coalesce("lang_pred", F.lit("und")).alias("lang_pred"), "score")


def _nearest(rows: DataFrame, protos: dict[str, np.ndarray], dim: int, kind: str, last: bool) -> DataFrame:
    """rows (doc_id, text, lang_pred, score) after comparison with one more group of prototypes; the last drops the text."""
    names = list(protos)
    matrix = np.stack([protos[k] for k in names], axis=1) if names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(dim)
        for b in slices(batches):
            lang, score = b.column(2).to_pylist(), b.column(3).to_pylist()
            for i, t in enumerate(b.column(1).to_pylist()):
                if names and (v := e.encode(t)) is not None:
                    c = v @ matrix
                    k = int(c.argmax())
                    s = float(min(1.0, max(0.0, c[k])))
                    if lang[i] is None or (-s, names[k]) < (-score[i], lang[i]):
                        lang[i], score[i] = names[k], s
            more = [] if last else [b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *more, pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", *([] if last else ["text"]), "lang_pred", "score"])

    return rows.mapInArrow(run, f"doc_id {kind}, {'' if last else 'text string, '}lang_pred string, score double")
