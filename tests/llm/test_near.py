import random
import re

import pytest

from tallyforge.llm import near_dedup as nd


def plain_shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similar(a, b):
    return a == b or (len(a & b) >= 0.8 * len(a | b))


def brute(rows):
    """The least id of each component of similar texts, every pair compared."""
    sets = [(d, plain_shingles(t)) for d, t in rows]
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if find(i) != find(j) and similar(sets[i][1], sets[j][1]):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        r = find(i)
        least[r] = min((x for x in (d, least.get(r)) if x is not None), default=None)
    return set(least.values())


def edited(rng, words, edits):
    w = list(words)
    for p in rng.sample(range(len(w)), edits):
        w[p] = f"edit{rng.randrange(10**6)}"
    return " ".join(w)


def near_corpus():
    """Copies with 0 to 9 edited words of 200 (similarity from 1 down to 0.64), alone, in a large group and in chains."""
    rng = random.Random(11)
    vocabulary = [f"word{k}" for k in range(3000)]
    texts = []
    for k in range(150):
        base = rng.choices(vocabulary, k=200)
        texts += [" ".join(base), edited(rng, base, k % 10)]
    base = rng.choices(vocabulary, k=200)
    texts += [edited(rng, base, 2) for _ in range(60)]
    for _ in range(8):
        base = edited(rng, base, 3).split()
        texts.append(" ".join(base))
    # unrelated documents that share a repeated filler only
    texts += [" ".join(rng.choices(vocabulary, k=60)) + " |" * 60 for _ in range(40)]
    ids = rng.sample(range(10**6), len(texts))
    return list(zip(ids, texts))


@pytest.mark.parametrize("tile", [nd.TILE, 16])
def test_near_stage_against_brute_force(spark, tile):
    rows = near_corpus()
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = {r.doc_id for r in nd.near_dedup_stage(df, tile).collect()}
    assert got == brute(rows)


def test_near_stage_edges(docs, no_docs, corpus):
    out = nd.near_dedup_stage(docs)
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} == brute([c[:2] for c in corpus])
    assert nd.near_dedup_stage(no_docs).collect() == []


@pytest.mark.parametrize("edits,least", [(4, 0.995), (5, 0.99)])
def test_recall_of_the_bands(edits, least):
    """Pairs of similarity 0.8 to 0.85: the share that meets in some band."""
    rng = random.Random(edits)
    met = n = 0
    while n < 400:
        base = [f"w{rng.randrange(9999)}" for _ in range(220)]
        a, b = (nd.shingles(t.encode()) for t in (" ".join(base), edited(rng, base, edits)))
        j = len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist()))
        if j >= 0.8:
            n += 1
            met += (nd.minima(a) == nd.minima(b)).reshape(nd.BANDS, nd.ROWS).all(axis=1).any()
    assert met / n >= least


def test_near_stage_on_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source")
    got = {r.doc_id for r in nd.near_dedup_stage(rows).collect()}
    assert got == brute([(r.doc_id, r.text) for r in rows.collect()])
