"""Quality classifier by Bradley-Terry pairwise ranking.

Preference pairs (a document of label 1 over one of label 0) give logistic losses on feature differences; the score
threshold is the quantile of learned scores at the share of label 0.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from .common import ROW, slices, whole_rows
from .labelled import held_out, labelled_docs

#: Labelled documents and preference pairs used for learning.
SAMPLE, PAIRS = 20_000, 200_000
#: Pairs whose feature differences are held at once.
BLOCK = 8192
_UPPER, _LOWER, _DIGIT = (np.isin(np.arange(256), list(s)) for s in (range(65, 91), range(97, 123), range(48, 58)))
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_HIGH = np.arange(256) >= 128
_STOP, _COMMA = (np.isin(np.arange(256), list(s)) for s in (b".", b",;:"))
_MARK = ~(_UPPER | _LOWER | _DIGIT | _SPACE | _HIGH | _STOP | _COMMA)
_ENDS = re.compile(rb"[^A-Za-z0-9\x80-\xff.,;:\s]{2,}(?=\s|$)")
N_BASE = 22


def features(text: bytes | None) -> np.ndarray:
    """Numbers of one whole text; finite for any text, empty ones too."""
    b = text or b""
    c = np.bincount(np.frombuffer(b, np.uint8), minlength=256) if b else np.zeros(256, np.int64)
    words = b.split()
    n, size = len(words), max(1, len(b))
    w = max(1, n)
    lens = np.fromiter(map(len, words), np.int64, n) if n else np.zeros(1, np.int64)
    letters = max(1, c[_UPPER].sum() + c[_LOWER].sum() + c[_HIGH].sum())
    distinct = len(set(words))
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    lines = [x for x in b.split(b"\n") if x.strip()]
    p = c[c > 0] / size
    marks = c[_MARK].sum()
    return np.array(
        [
            np.log1p(n), np.log1p(len(b)), lens.mean(), lens.std(), np.log1p(lens.max()),
            distinct / w, repeats / w, c[_UPPER].sum() / letters, c[_DIGIT].sum() / size, marks / size,
            marks / w, c[_STOP].sum() / w, c[_COMMA].sum() / w, c[_HIGH].sum() / size, float(-(p * np.log2(p)).sum()) if len(p) else 0.0,
            len(_ENDS.findall(b)) / w, words.count(b"|") / w, len(set(lines)) / max(1, len(lines)), np.log1p(len(lines)), (c[33] + c[63]) / w,
            float(c.max() / size), float(n == 0),
        ]
    )


def widened(x: np.ndarray) -> np.ndarray:
    """Base features with square roots and squares, so that a linear score can bend."""
    return np.concatenate([x, np.sqrt(np.abs(x)), np.minimum(x, 50) ** 2], axis=1)


@dataclass
class Ranker:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.clip((widened(x) - self.mean) / self.scale, -6, 6) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; 0.5 is the threshold quantile."""
        return 1 / (1 + np.exp(-np.clip(self.margin(x) - self.cut, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, ridge: float = 1e-3, seed: int = 5) -> Ranker:
    """Newton steps on mean log(1 + exp(-w (x_preferred - x_other))); with one label only every score is its side."""
    w = widened(x) if len(x) else np.zeros((1, 3 * N_BASE))
    mean, scale = w.mean(axis=0), w.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Ranker(mean, scale, np.zeros(w.shape[1]), 1.0 if len(bad) and not len(good) else -1.0)
    z = np.clip((w - mean) / scale, -6, 6)
    rng = np.random.default_rng(seed)
    a, b = rng.choice(good, pairs), rng.choice(bad, pairs)
    beta = np.zeros(w.shape[1])
    for _ in range(12):
        # block by block: the differences of all pairs would be a hundred MB, and as much again for each product with them
        grad, hess = ridge * beta, ridge * np.eye(len(beta))
        for i in range(0, pairs, BLOCK):
            d = z[a[i : i + BLOCK]] - z[b[i : i + BLOCK]]
            p = 1 / (1 + np.exp(np.clip(d @ beta, -30, 30)))
            grad -= p @ d / pairs
            hess += (d * (p * (1 - p))[:, None]).T @ d / pairs
        step = np.linalg.solve(hess, grad)
        beta -= step
        if np.abs(step).max() < 1e-6:
            break
    return Ranker(mean, scale, beta, float(np.quantile(z @ beta, len(bad) / (len(good) + len(bad)))))


def _feature_rows(sample: DataFrame, bound: int) -> tuple[np.ndarray, np.ndarray]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            f = [features(t) for t in b.column(0).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.list_(pa.float64())), b.column(1)], ["f", "_y"])

    # the order, and so the model, does not depend on partitions
    rows = sample.select("text", "_y").mapInArrow(run, "f array<double>, _y int").orderBy(F.xxhash64("f"), "_y").limit(bound).collect()
    return np.array([r["f"] for r in rows], np.float64).reshape(-1, N_BASE), np.array([r["_y"] for r in rows], np.int64)


def fit_quality(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> Ranker:
    return fit(*_feature_rows(labelled_docs(docs, labels, "quality", bound), bound))


def score_quality(docs: DataFrame, model: Ranker) -> DataFrame:
    """(row, score): the rows of docs, each as one struct column, and their scores from 0 to 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            text = b.column(0).field("text").cast(pa.binary()).to_pylist()
            s = model.score(np.array([features(t) for t in text]).reshape(-1, N_BASE))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], [ROW, "score"])

    rows = whole_rows(docs)
    return rows.mapInArrow(run, StructType([*rows.schema.fields]).add("score", DoubleType()))


def quality_classifier(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted.

    Null and empty texts are scored by their (zero) features.  Without labels, or with one label only, every document
    is on that label's side (no labels: 1).  Rows of labels with nulls or other values are left out; repeated ids are
    one.  Only ``text`` is an input of a score, whatever other columns are there.
    """
    model = fit_quality(docs, labels, bound)
    s = score_quality(docs.select("doc_id", "text"), model)
    doc_id = F.col(ROW)["doc_id"]
    return s.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def quality_stage(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the documents that the classifier rejects, all columns kept whatever their names.

    The decision depends on the text alone: null and empty texts are judged by their (zero) features, repeated rows stay
    or go together.  Without labels nothing is rejected.
    """
    return score_quality(docs, fit_quality(docs, labels)).where("score >= 0.5").select(f"{ROW}.*")
