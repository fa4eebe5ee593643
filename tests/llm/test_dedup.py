import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyforge.llm import embed_dedup, exact_dedup, simhash_dedup, substring_dedup
from tallyforge.llm.common import components


def closure(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(1)
    links = [(i, i + 1) for i in range(60, 130)] + [(200, k) for k in range(201, 260)] + [tuple(map(int, p)) for p in rng.integers(300, 400, (70, 2))]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    want = closure({x for p in links for x in p}, links)
    assert got == {n: c for n, c in want.items() if n != c}


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(docs, corpus, weak):
    # weak: a hash that collides for most texts; the bytes keep them apart
    got = exact_dedup.exact_dedup(docs, *([lambda c: F.substring(c, 1, 1)] if weak else [])).collect()
    groups = defaultdict(list)
    for d, t, *_ in corpus:
        groups[norm(t)].append(d)
    want = []
    for d, t, *_ in corpus:
        g = groups[norm(t)]
        keep = min((x for x in g if x is not None), default=None)
        want.append((d, keep, len(g), d is not None and d == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_exact_stage(docs, corpus):
    kept = exact_dedup.dedup_stage(docs)
    assert kept.columns == docs.columns
    assert {norm(r.text) for r in kept.collect()} == {norm(c[1]) for c in corpus}


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, corpus):
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash_dedup.simhash_dedup(docs).collect()}
    fp = [(c[0], plain_fingerprint(c[1])) for c in corpus]
    least = {}
    for d, f in fp:
        least[f] = min((x for x in (d, least.get(f)) if x is not None), default=None)
    ids = {f: d for f, d in least.items() if d is not None}
    comp = closure(set(ids.values()), [(ids[a], ids[b]) for a in ids for b in ids if a != b and (a ^ b).bit_count() <= 4])
    assert got == {(d, f"{f:016x}"): comp.get(ids.get(f)) for d, f in fp}


def test_simhash_spark_hash(spark):
    assert spark.sql("select xxhash64('a b c d') h").first().h % (1 << 64) == simhash_dedup.fingerprint("A b C d")


@pytest.mark.parametrize("n,spread", [(3, 4), (300, 2), (1500, 20)])
def test_near_pairs(n, spread):
    rng = np.random.default_rng(n)
    base = rng.integers(0, 1 << 63, 1 + n // 5, dtype=np.uint64)
    fps = base[rng.integers(0, len(base), n)]
    for _ in range(spread):
        fps = np.where(rng.random(n) < 0.5, fps ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)), fps)
    i, j = simhash_dedup.near_pairs(fps, 4, rows=100)
    want = {(a, b) for a in range(n) for b in range(a + 1, n) if (int(fps[a]) ^ int(fps[b])).bit_count() <= 4}
    assert len(i) == len(want) and set(zip(i.tolist(), j.tolist())) == want


@pytest.mark.parametrize("blocks", [5, 6, 7])
def test_tables_lose_no_link(blocks):
    rng = np.random.default_rng(blocks)
    masks = simhash_dedup.table_masks(blocks, 4)
    for _ in range(300):
        flips = rng.choice(64, 4, replace=False)
        d = sum(1 << int(b) for b in flips)
        assert any(d & m == 0 for m in masks)


def test_simhash_hot_bucket(spark):
    """Buckets over the tile size are split and lose nothing."""
    rng = np.random.default_rng(3)
    fps = sorted({int(rng.integers(0, 1 << 20)) for _ in range(400)})
    rows = spark.createDataFrame([(f, k) for k, f in enumerate(fps)], "fp bigint, rep bigint")
    got = closure(set(range(len(fps))), [(r.a, r.b) for r in simhash_dedup.class_links(rows, tile=64).collect()])
    want = closure(set(range(len(fps))), [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4])
    assert got == want


def plain_substring(corpus, width):
    first, docs = {}, [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t, *_ in corpus]
    for d, w in docs:
        if d is not None:
            for i in range(len(w) - width + 1):
                k = tuple(w[i : i + width])
                first[k] = min(first.get(k, (d, i)), (d, i))
    out = set()
    for d, w in docs:
        gone = set()
        if d is not None:
            for i in range(len(w) - width + 1):
                if first[tuple(w[i : i + width])] != (d, i):
                    gone.update(range(i, i + width))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.add((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("width,gram,hot,many", [(20, 4, 512, 64), (20, 4, 2, 64), (7, 3, 3, 64), (5, 1, 512, 64), (20, 4, 512, 1), (20, 4, 512, 2), (20, 4, 512, 5), (7, 3, 9, 3)])
def test_substring(docs, corpus, width, gram, hot, many):
    rows = substring_dedup.substring_dedup(docs, width, gram, hot, many).collect()
    assert len(rows) == len(corpus)
    assert {(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in rows} == plain_substring(corpus, width)
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in rows)


def plain_links(vectors, threshold=0.95):
    ok = {i: np.array(v, float) / np.linalg.norm(np.array(v, float)) for i, v in vectors if v is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    return [(a, b) for a in ok for b in ok if a < b and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= threshold]


@pytest.mark.parametrize("tile", [4096, 16])
def test_embeddings(spark, tile, monkeypatch):
    monkeypatch.setattr(embed_dedup.class_links, "__defaults__", (tile,))
    rng = np.random.default_rng(8)
    base = rng.standard_normal((150, 24))
    rows = []
    for k in range(600):
        v = base[k % 150] + (0 if k < 150 else rng.standard_normal(24) * rng.choice([0.0, 0.05, 0.2, 0.3]))
        rows.append((k * 2, [float(np.float32(x)) for x in v]))
    rows += [(2000 + k, [float(x) for x in base[0]]) for k in range(40)]
    rows += [(3000, None), (3001, []), (3002, [0.0] * 24), (3003, [float("nan")] + [1.0] * 23), (3004, [None] + [1.0] * 23), (3005, [1.0, 2.0]), (3006, [2.0, 4.0])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id bigint, embedding array<double>, label int, rep string").repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.embedding_dedup(df).collect()}
    links = plain_links(rows)
    comp = closure([i for i, _ in rows], links)
    count = defaultdict(int)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    found = sum(n for n, _, _ in got.values()) / (2 * len(links))
    assert 0.98 <= found <= 1
    assert all(got[i][0] <= count[i] for i in got)
    assert np.mean([got[i][1] == comp[i] for i in got]) > 0.98
    assert all(k == (c == i) for i, (_, c, k) in got.items())
    assert got[3005][0] == got[3006][0] == 1 and got[2000][0] >= 40


@pytest.mark.parametrize("op", [exact_dedup.exact_dedup, simhash_dedup.simhash_dedup, substring_dedup.substring_dedup])
def test_empty(no_docs, op):
    assert op(no_docs).collect() == []


def test_empty_vectors(spark):
    assert embed_dedup.embedding_dedup(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).collect() == []
