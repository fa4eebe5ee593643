"""The pipeline, and each of its stages, against plain Python."""

import hashlib
import math
import random
import re
from collections import defaultdict
from datetime import date

import numpy as np
import pytest

import corpus_pipeline
from tallyforge.llm import mixing, quality
from tallyforge.llm import sentencepiece_codec as sc

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def plain_quality(rows, model):
    return [r for r in rows if model.score(quality.features((r["text"] or "").encode())[None])[0] >= 0.5]


def least(rows):
    """The row that stays of a group: the least id, a null one last."""
    return min(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))


def plain_exact(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "")].append(r)
    return [least(g) for g in groups.values()]


def plain_near(rows):
    def shingles(t):
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    s, at = [shingles(r["text"]) for r in rows], list(range(len(rows)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(s[i] & s[j])
            if (not s[i] and not s[j]) or (both and both >= 0.8 * (len(s[i]) + len(s[j]) - both)):
                at[root(i)] = root(j)
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[root(i)].append(r)
    return [least(g) for g in groups.values()]


def topic(t):
    low = (t or "").lower()
    return "legal" if "license" in low or "copyright" in low else "contact" if "@" in (t or "") or "://" in (t or "") else "listing" if " | " in (t or "") else "prose"


def plain_mix(rows):
    cell = lambda r: (r["source"] or "", r["lang"] or "", topic(r["text"]))
    tok = defaultdict(int)
    for r in rows:
        tok[cell(r)] += len(words(r["text"]))
    w, total = {c: float(n) for c, n in tok.items()}, sum(tok.values())
    goal = []
    for d in range(3):
        m = defaultdict(float)
        for c, n in tok.items():
            m[c[d]] += n
        z = sum(v**mixing.TEMPER for v in m.values()) or 1.0
        goal.append({k: v**mixing.TEMPER / z for k, v in m.items()})
    for _ in range(mixing.ROUNDS):
        for d in range(3):
            m = defaultdict(float)
            for c, x in w.items():
                m[c[d]] += x
            w = {c: x * goal[d][c[d]] / m[c[d]] if m[c[d]] > 0 else 0.0 for c, x in w.items()}
    part = {c: mixing.SHARE * total * w[c] for c in tok if tok[c]}
    # fill: cells in the order in which a growing factor makes them whole
    left, free, factor = mixing.SHARE * total, sum(part.values()), 1.0
    for c in sorted((c for c in part if part[c] > 0), key=lambda c: tok[c] / part[c]):
        if tok[c] / part[c] > (factor := max(1.0, left / free)):
            break
        left, free = left - tok[c], free - part[c]
    rate = {c: min(1.0, factor * part[c] / n) if n else mixing.SHARE for c, n in tok.items()}
    draw = lambda i: int(hashlib.md5(f"{'' if i is None else i}:{mixing.SALT}".encode()).hexdigest()[:8], 16) / 2**32
    return [r for r in rows if draw(r["doc_id"]) < round(rate[cell(r)], 9)]


def key(r):
    return tuple((k, str(v)) for k, v in sorted(r.items()) if k not in ("token_ids", "round_trip"))


def same(got, want):
    assert sorted(map(key, got)) == sorted(map(key, want))


def dicts(df):
    return [r.asDict() for r in df.collect()]


def test_pipeline(spark):
    """All rows of run() against the same five steps in plain Python."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == [*docs.columns, "token_ids", "round_trip"]
    model = quality.fit_quality(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = plain_mix(plain_near(plain_exact(plain_quality(dicts(docs), model))))
    got = dicts(out)
    same(got, rows)
    assert len(rows) > 20
    sp = sc.codec(sc.MODEL).sp
    assert all(r["token_ids"] == sp.encode(r["text"] or "") and r["round_trip"] for r in got)


#: Columns of the user whose names are those used inside the operators.
CLASHES = ["_score", "score", "_prob", "_src", "_u", "_tok", "_ids", "_same", "_key", "_h", "_sha", "_id", "_n", "_r", "_node", "_salt", "row", "key", "part", "c", "g", "odd.name", "we`ird"]


@pytest.fixture(scope="module")
def odd(spark):
    """Null in every column, empty texts, ties, repeated rows, one id with two texts, a long text, clashing names."""
    rng = random.Random(9)
    base = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "kappa", "omega"]) + str(rng.randrange(50)) for _ in range(60))
    rows = [(1, base), (2, base.upper()), (3, base.replace(" ", "\t\n")), (4, base + " tail"), (5, "other words altogether license"), (5, base + " more than that"), (6, ""), (7, None), (8, " \n "), (None, "no id | here"), (None, None), (9, "x" * 70_000), (10, ("long text " * 400_000)), (1, base), (1, base)]
    kinds = {c: "string" for c in CLASHES} | {"_score": "double", "_h": "date", "_ids": "array<int>", "_key": "struct<a:int>", "_n": "map<string,int>"}
    make = {"string": "s", "double": 0.25, "date": date(2024, 1, 1), "array<int>": [1], "struct<a:int>": (1,), "map<string,int>": {"a": 1}}
    data = [(i, t, ["en", None][k % 2], ["web", None, "book"][k % 3], k if k % 4 else None, *(None if (k + j) % 5 == 0 and k < 12 else make[kinds[c]] for j, c in enumerate(CLASHES))) for k, (i, t) in enumerate(rows)]
    for k in (13, 14):
        data[k] = data[0]
    return spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c.replace('`', '``')}` {kinds[c]}" for c in CLASHES)).repartition(4).cache()


PLAIN = {"exact_dedup": plain_exact, "near_dedup": plain_near, "mixture": plain_mix}


@pytest.mark.parametrize("name", STAGES)
def test_stage_on_odd_rows(spark, odd, name):
    out = STAGES[name](spark, odd, SF)
    assert [c for c in out.columns if c not in ("token_ids", "round_trip")] == odd.columns
    got, rows = dicts(out), dicts(odd)
    if name == "quality":
        want = plain_quality(rows, quality.fit_quality(odd, spark.read.parquet(f"{SF}/labels.parquet")))
    else:
        want = PLAIN.get(name, lambda r: r)(rows)
    same(got, want)
    if name == "tokens":
        sp = sc.codec(sc.MODEL).sp
        assert all(r["token_ids"] == sp.encode(r["text"] or "") and r["round_trip"] for r in got)


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name


def test_empty(spark, odd):
    for docs in (spark.read.parquet(f"{SF}/documents.parquet").limit(0), odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, SF).count() == 0, name


def test_mix_rates_are_probabilities(spark, odd):
    rates = [r.prob for r in mixing.mix_sources(odd).collect()]
    assert all(0 <= p <= 1 and not math.isnan(p) for p in rates) and np.ptp(rates) > 0


def test_mix_stage_keeps_its_share(spark):
    """What small cells cannot give, the others do."""
    docs = spark.createDataFrame([(i, "w " * (1 + i % 9), "big" if i % 40 else f"s{i % 160}", "en") for i in range(20_000)], "doc_id bigint, text string, source string, lang string")
    c = mixing.calibrated(docs, fill=True).selectExpr("sum(_tok * _prob) / sum(_tok) as kept", "max(_prob) as top", "max_by(_weight, _prob) as weight").first()
    assert c.kept == pytest.approx(mixing.SHARE, abs=1e-8) and c.top == 1 and c.weight > 1
    assert mixing.calibrated(docs).selectExpr("sum(_tok * _prob) / sum(_tok) as kept").first().kept < mixing.SHARE - 0.01
