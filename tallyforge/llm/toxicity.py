"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The labelled sample is split in three by hash: on one part the lexicon of telling words and word beginnings is
learned, on the second the trees, on the third the calibration, so no part flatters the next.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, slices
from .labelled import held_out, labelled_docs

SAMPLE, LEXICON = 30_000, 2_000
WORD = re.compile(r"[^\W\d_]+")
OBFUSCATED = re.compile(r"(?<!\S)(?=\S*[^\W\d_])[\w@$!|*.]*[^\W\d_][\d@$!|*.]+[^\W\d_][\w@$!|*.]*")
UNLEET = str.maketrans("0134578@$!|", "oieastbasil", "*._-")
#: Second-person words of the corpus languages.
SECOND = frozenset("you your yours yourself youre du dich dir dein deine sie ihr tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros su".split())
#: Insults any corpus may hold; the learned lexicon adds to them.
INSULTS = frozenset("idiot idiots moron morons stupid dumb loser losers trash scum pathetic worthless disgusting clown fool imbecile jerk bastard crap idiota estúpido basura imbécil asqueroso idiot dumm blöd abschaum trottel arschloch connard crétin débile ordure minable".split())
PREFIX = 5
N_FEATURES = 20


def features(text: str | None, weights: dict[str, float], starts: dict[str, float]) -> list[float]:
    """Numbers of one whole text.  weights, starts: log odds of words and of word beginnings."""
    t = text or ""
    low = t.lower()
    words = WORD.findall(low)
    n = len(words)
    d = max(1, n)
    hit = [weights.get(w, 0.0) for w in words]
    begun = [starts.get(w[:PREFIX], 0.0) for w in words] if starts else []
    family = Counter(w[:PREFIX] for w, x in zip(words, begun) if x)
    top = max(family.values(), default=0)
    pos = [i for i, x in enumerate(hit) if x > 1.5]
    insults = [i for i, w in enumerate(words) if w in INSULTS]
    near = sum(any(w in SECOND for w in words[max(0, i - 5) : i + 6]) for i in {*pos, *insults})
    odd = OBFUSCATED.findall(t) if n else []
    hidden = sum(weights.get(w := x.lower().translate(UNLEET), 0.0) > 1.5 or w in INSULTS for x in odd)
    size = max(1, len(t))
    letters = max(1, sum(map(len, words)))
    upper = sum(map(str.isupper, t)) if not t.islower() else 0
    return [
        len(pos) / d, float(np.log1p(len(pos))), float(max(hit, default=0.0)), float(np.sum(hit)) / d,
        len(insults) / d, float(np.log1p(len(insults))), len({words[i] for i in pos}) / max(1, len(pos)),
        sum(x > 1.5 for x in begun) / d, float(np.log1p(sum(x > 1.5 for x in begun))), float(np.sum(begun)) / d,
        near / d, upper / letters, (t.count("!") + t.count("?")) / size, len(odd) / d,
        float(hidden), float(np.log1p(n)), top / d, float(np.log1p(top)),
        float(np.sum(hit)) / d**0.5, float(np.sum(begun)) / d**0.5,
    ]


@dataclass
class Trees:
    """Boosted trees of one depth; tree: feature and threshold per inner node, value per leaf."""

    depth: int = 3
    base: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for f, t, v in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += v[at - (2**self.depth - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, ridge: float = 5.0) -> Trees:
    """Second-order boosting of the logistic loss on histograms of quantile bins."""
    p = float(np.clip(y.mean() if len(y) else 0.0, 1e-4, 1 - 1e-4))
    model = Trees(depth, float(np.log(p / (1 - p))))
    if not len(y) or len(set(y.tolist())) < 2:
        return model
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    k = bins + 1
    m = np.full(len(y), model.base)
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-m))
        g, h = y - q, np.maximum(q * (1 - q), 1e-6)
        at = np.zeros(len(y), np.int64)
        f, t = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            gain, where = np.full(nodes, 1e-6), [None] * nodes
            for j in range(x.shape[1]):
                if not len(edges[j]):
                    continue
                key = (at - first) * k + binned[:, j]
                gl = np.bincount(key, g, nodes * k).reshape(nodes, k).cumsum(axis=1)
                hl = np.bincount(key, h, nodes * k).reshape(nodes, k).cumsum(axis=1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                s = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                s = np.where((hl > 2) & (ht - hl > 2), s, 0)[:, : len(edges[j])]
                b = s.argmax(axis=1)
                for node in np.flatnonzero(s[np.arange(nodes), b] > gain):
                    gain[node], where[node] = s[node, b[node]], (j, edges[j][b[node]])
            for node, w in enumerate(where):
                if w:
                    f[first + node], t[first + node] = w
            at = 2 * at + 1 + (x[np.arange(len(y)), f[at]] > t[at])
        leaf = at - (2**depth - 1)
        v = rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + ridge)
        model.trees.append((f, t, v))
        m += v[leaf]
    return model


def isotonic(m: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (margin, probability) of each block's middle, both rising."""
    order = np.argsort(m, kind="stable")
    blocks: list[list[float]] = []  # weight, sum of labels, sum of margins
    for a, b in zip(m[order].tolist(), y[order].tolist()):
        blocks.append([1.0, float(b), a])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            w, s, x = blocks.pop()
            blocks[-1][0] += w
            blocks[-1][1] += s
            blocks[-1][2] += x
    return np.array([x / w for w, _, x in blocks]), np.array([s / w for w, s, _ in blocks])


@dataclass
class Toxicity:
    weights: dict[str, float]
    starts: dict[str, float]
    trees: Trees
    at: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        m = self.trees.margin(x)
        if not len(self.at):
            return 1 / (1 + np.exp(-m))
        # a trace of the margin keeps the order inside a flat step of the calibration
        return np.clip(0.999 * np.interp(m, self.at, self.value) + 0.001 / (1 + np.exp(-m)), 0, 1)


def learn_lexicon(sample: DataFrame, size: int = LEXICON) -> tuple[dict[str, float], dict[str, float]]:
    """Log odds of the ``size`` words, and word beginnings, that tell most; counted per document by Spark."""
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"\p{L}+"), 0)

    def top(terms: Column) -> dict[str, float]:
        # a document counts a term a few times at most: repetition is not evidence
        per = sample.select("doc_id", "_y", F.explode(terms).alias("w")).groupBy("doc_id", "_y", "w").agg(F.least(F.count("*"), F.lit(8)).alias("n"))
        c = per.groupBy("w").agg(F.sum(F.col("n") * F.col("_y")).alias("a"), F.sum(F.col("n") * (1 - F.col("_y"))).alias("b"), F.sum("_y").alias("docs"))
        n1, n0 = (float(v or 0) + 1 for v in c.agg(F.sum("a"), F.sum("b")).first())
        odds = c.where("docs >= 4").select("w", (F.log((F.col("a") + 1) / n1) - F.log((F.col("b") + 1) / n0)).alias("s"))
        return {r["w"]: r["s"] for r in odds.where("s > 0.7").orderBy(F.desc("s"), "w").limit(size).collect()}

    return top(words), top(F.transform(words, lambda x: F.substring(x, 1, PREFIX)))


def _feature_udf(weights: dict[str, float], starts: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            f = [features(t, weights, starts) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(f, pa.list_(pa.float64()))], ["part", "_y", "f"])

    return run


def fit_toxicity(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> Toxicity:
    s = labelled_docs(docs, labels, "toxic", bound).withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(10)).cast("int"))
    s = cut(s)  # the sample is read several times, the documents once
    weights, starts = learn_lexicon(s.where("part < 4"))
    rows = s.where("part >= 4").select("part", "text", "_y").mapInArrow(_feature_udf(weights, starts), "part int, _y int, f array<double>").orderBy(F.xxhash64("f"), "_y").limit(bound).collect()
    x = np.array([r["f"] for r in rows], np.float64).reshape(-1, N_FEATURES)
    y, part = np.array([r["_y"] for r in rows], np.float64), np.array([r["part"] for r in rows], np.int64)
    trees = boost(x[part < 8], y[part < 8])
    held = part >= 8
    at, value = isotonic(trees.margin(x[held]), y[held]) if len(set(y[held].tolist())) == 2 else (np.zeros(0), np.zeros(0))
    return Toxicity(weights, starts, trees, at, value)


def toxicity(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE, threshold: float = 0.7) -> DataFrame:
    """Per row: doc_id, held_out, score (calibrated probability of label 1), predicted.

    Null and empty texts are scored by their (zero) features.  Without labels the score is near 0.  Rows of labels with
    nulls or other values are left out; repeated ids are one.  Only ``text`` is an input of a score.
    """
    model = fit_toxicity(docs, labels, bound)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = np.array([features(t, model.weights, model.starts) for t in b.column(1).to_pylist()]).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x), pa.float64())], ["doc_id", "score"])

    s = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return s.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
