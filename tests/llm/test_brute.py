"""Learned operators against plain computations, and joins on hot keys."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import common, langid, quality, toxicity


def test_bundle_by_hand():
    e = langid.Encoder(64)
    letters = e.shifted[2]  # the last letter of a trigram is not shifted
    code = [32, ord("a"), ord("b"), 32, ord("c"), 32]
    v = sum(np.roll(letters[x], 2).astype(int) * np.roll(letters[y], 1) * letters[z] for x, y, z in zip(code, code[1:], code[2:]))
    assert np.allclose(e.encode("Ab 12 c!"), v / np.linalg.norm(v))


@pytest.mark.parametrize("block", [1, 2, 3, 7, 1000])
def test_blocks_of_a_text(block):
    e = langid.Encoder(16)
    for text in ("Ab 12 c!", "  1 a", "x", "ünï código 日本 " * 5, "a" + " " * 9 + "b", "", "12 34"):
        count = Counter()
        for g, n in e.grams(text, block):
            count.update(dict(zip(g.tolist(), n.tolist())))
        whole = Counter()
        for g, n in e.grams(text, 1 << 20):
            whole.update(dict(zip(g.tolist(), n.tolist())))
        assert count == whole


def test_languages_in_groups(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(w) for _ in range(30)), lang) for i, (lang, w) in enumerate([("a", ["alma", "anna"]), ("b", ["bobo", "bubu"]), ("c", ["cici", "cece"]), ("d", ["dada", "dodo"])] * 30)]
    docs = spark.createDataFrame([*rows, (900, None, "a"), (901, "1 2", "b")], "doc_id int, text string, lang string")
    one, many = ({r.doc_id: (r.lang_pred, round(r.score, 9)) for r in langid.language_id(docs, group=g).collect()} for g in (100, 1))
    assert one == many and one[900] == one[901] == ("und", 0.0)
    assert all(one[i][0] == lang for i, _, lang in rows)


def test_first_tree_is_the_best_split():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 3))
    y = (x[:, 1] + 0.3 * rng.standard_normal(300) > 0.4).astype(float)
    model = toxicity.boost(x, y, rounds=1, depth=1, rate=1.0, ridge=5.0)
    p = y.mean()
    g, h = y - p, np.full(300, p * (1 - p))
    best = (-1.0, None)
    for j in range(3):
        for t in np.unique(np.quantile(x[:, j], np.linspace(0, 1, 49)[1:-1])):
            low = x[:, j] <= t
            if h[low].sum() > 2 and h[~low].sum() > 2:
                best = max(best, (sum(g[s].sum() ** 2 / (h[s].sum() + 5) for s in (low, ~low)), (j, t)))
    j, t = best[1]
    f, cuts, leaf = model.trees[0]
    assert (f[0], cuts[0]) == (j, t)
    low = x[:, j] <= t
    assert np.allclose(leaf, [g[s].sum() / (h[s].sum() + 5) for s in (low, ~low)])
    assert np.allclose(model.margin(x), np.log(p / (1 - p)) + np.where(low, leaf[0], leaf[1]))


def test_pairwise_loss_is_least():
    rng = np.random.default_rng(0)
    x = np.abs(rng.standard_normal((200, quality.N_BASE)))
    y = (x[:, 2] > 0.7).astype(int)
    m = quality.fit(x, y, pairs=3000, ridge=0.01)
    z = np.clip((quality.widened(x) - m.mean) / m.scale, -6, 6)
    pick = np.random.default_rng(5)
    d = z[pick.choice(np.flatnonzero(y == 1), 3000)] - z[pick.choice(np.flatnonzero(y == 0), 3000)]
    loss = lambda w: np.log1p(np.exp(-d @ w)).mean() + 0.005 * w @ w
    for k in range(len(m.weights)):
        step = np.zeros(len(m.weights))
        step[k] = 1e-4
        assert abs(loss(m.weights + step) - loss(m.weights - step)) / 2e-4 < 1e-4
    assert m.cut == pytest.approx(np.quantile(z @ m.weights, (y == 0).mean()))


def test_hot_join(spark):
    """A value that most rows have, with and without salting, inner and left."""
    rows = spark.range(4000).selectExpr("id", "case when id % 3 = 0 then 1 else id end as k")
    values = rows.where("k <> 5").groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("m"))
    for how in ("inner", "left"):
        plain = sorted((r.id, r.m or -1) for r in rows.join(values, "k", how).collect())
        assert sorted((r.id, r.m or -1) for r in common.hot_join(rows, values, ["k"], "n", 4000, F.xxhash64("id"), how, few=0).collect()) == plain


def test_components_of_hubs(spark):
    edges = [(1, k) for k in range(2, 400)] + [(500 + k, 501 + k) for k in range(60)] + [(9, 560)]
    got = {(r.node, r.component) for r in common.components(spark.createDataFrame(edges, "a int, b int"), few=0).collect()}
    assert got == {(k, 1) for k in range(2, 400)} | {(k, 1) for k in range(500, 561)}
