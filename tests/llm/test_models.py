import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import labelled, langid, quality, toxicity

SF = "/root/testdata/sf0.01"


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def accuracy(rows, truth):
    return np.mean([r.predicted == truth[r.doc_id] for r in rows if r.held_out and r.doc_id in truth])


def test_quality_held_out(spark):
    rows = quality.quality_classifier(table(spark, "documents"), table(spark, "labels")).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 for r in rows)
    assert accuracy(rows, {r.doc_id: r.quality for r in table(spark, "labels").collect()}) > 0.95


def test_toxicity_held_out(spark):
    rows = toxicity.toxicity(table(spark, "documents"), table(spark, "labels")).collect()
    truth = {r.doc_id: r.toxic for r in table(spark, "labels").collect()}
    assert len(rows) == 1000 and all(0 <= r.score <= 1 for r in rows)
    assert accuracy(rows, truth) > 0.9
    assert not any(r.predicted and truth.get(r.doc_id) == 0 for r in rows if r.held_out)


def test_language_held_out(spark):
    d = table(spark, "documents")
    truth = {r.doc_id: r.lang for r in d.collect()}
    rows = langid.language_id(d).collect()
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in rows if r.held_out]) > 0.97


def test_only_text_counts(spark, docs):
    """Ids, languages and sources are no inputs: equal texts get equal scores."""
    labels = spark.createDataFrame([(i * 3 + 1, i % 2, i % 2) for i in range(120)] + [(None, 1, 1), (4, None, None), (4, 1, 0), (4, 7, 7)], "doc_id bigint, quality int, toxic int")
    for op in (quality.quality_classifier, toxicity.toxicity):
        out = op(docs, labels)
        assert out.count() == docs.count()
        seen = {}
        for r in out.join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
            assert seen.setdefault(r.text, r.score) == pytest.approx(r.score)


def test_learns_from_the_fold_only(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(500)], "doc_id bigint, quality int")
    ids = labelled.sample_ids(labels, "quality", 400).select(F.col("_id").alias("doc_id"))
    assert ids.where(labelled.held_out(F.col("doc_id"))).count() == 0 and 0 < ids.count() <= 400


@pytest.mark.parametrize("rows", [[], [(1, 1, 1)], [(1, 0, 0)]])
def test_poor_labels(spark, docs, no_docs, rows):
    labels = spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")
    for op in (quality.quality_classifier, toxicity.toxicity):
        assert op(docs, labels).count() == docs.count()
        assert op(no_docs, labels).count() == 0


def test_language_edges(docs, no_docs, corpus):
    rows = langid.language_id(docs).collect()
    assert len(rows) == len(corpus) and {r.lang_pred for r in rows} <= {"en", "fr", "und"}
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in rows if r.doc_id in (700, 701, 702))
    assert langid.language_id(no_docs).collect() == []


def test_trigram_cosine_is_the_bundle():
    e = langid.Encoder(256)
    a, b = e.encode("the cat sat on the mat"), e.encode("the cat sat on the  mat!")
    assert np.allclose(a, b) and abs(np.linalg.norm(a) - 1) < 1e-9
    assert e.encode("12 34") is None and e.encode(None) is None


def test_isotonic():
    at, value = toxicity.isotonic(np.array([1.0, 2, 3, 4, 5]), np.array([0.0, 1, 0, 1, 1]))
    assert value.tolist() == [0, 0.5, 1] and (np.diff(at) > 0).all()


def test_bradley_terry_orders_pairs():
    rng = np.random.default_rng(0)
    x = np.abs(rng.standard_normal((400, quality.N_BASE)))
    y = (x[:, 3] + 0.1 * rng.standard_normal(400) > 0.7).astype(int)
    m = quality.fit(x, y, pairs=5000)
    assert np.mean((m.score(x) >= 0.5) == y) > 0.9
