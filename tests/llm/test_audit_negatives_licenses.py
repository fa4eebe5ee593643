"""The filter audit, hard negatives and license scans against plain Python, on odd rows."""

import itertools
import math
import random
import re

import pytest

from tallyforge.llm import filter_audit, hard_negatives, license_scan

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, source string, n bigint, part string, fails string, _h string, good int"


def fails(rows):
    least = {}
    for r in rows:
        if r[0] is not None:
            t = r[1] or ""
            least[t] = min(least.get(t, r[0]), r[0])
    for d, text, source, *_ in rows:
        t = text or ""
        w = WORD.findall(t)
        yield d, source or "", {
            f for f, bad in (("A", len(w) < 200), ("B", 100 * len(set(w)) < 50 * len(w)), ("C", 100 * len(re.findall("[A-Z]", t)) > 2 * len(t)), ("D", re.search("[#$%&*|]", t)), ("E", d is not None and d > least[t])) if bad
        }


def plain_audit(rows, labels):
    mark = {}
    for d, q, t in labels:
        old = mark.get(d, (False, False))
        mark[d] = (old[0] or q == 1, old[1] or t == 1)
    docs = [(p, f, *(mark.get(d, (False, False)) if d is not None else (False, False))) for d, p, f in fails(rows)]
    out, orders = {}, ["".join(o) for o in itertools.permutations("ABCDE")]
    for part in {p for p, *_ in docs}:
        mine = [x for x in docs if x[0] == part]
        for o in orders:
            for k, f in enumerate(o):
                before = set(o[:k])
                left = [x for x in mine if not x[1] & before]
                gone = [x for x in left if f in x[1]]
                out[part, o, k + 1] = [len(left) - len(gone), len(gone), sum(f in x[1] and bool(x[1] & before) for x in mine), sum(x[1] == {f} for x in mine), sum(x[2] for x in gone), sum(x[3] for x in gone)]
        for f in "ABCDE":
            total = sum(out[part, o, o.index(f) + 1][1] for o in orders)
            for o in orders:
                out[part, o, o.index(f) + 1].append(total)
    return out


@pytest.fixture(scope="module")
def audit_rows():
    rng = random.Random(5)
    base = [" ".join(rng.choice("abcdefghij") + str(rng.randint(0, n)) for _ in range(k)) for n, k in ((90, 250), (3, 300), (90, 30), (90, 210))]
    texts = [*base, base[0] + " #tag", base[1].upper(), base[3] + " ÀÉ " + "Z" * 40, None, "", " \n\t ", "x " * 120_000]
    rows = [(i * 2 + 1, rng.choice(texts), rng.choice(["web", "book", None]), 1, "p", "f", "h", 1) for i in range(60)]
    return [*rows, rows[3], rows[3], (None, base[0], "web", 1, "p", "f", "h", 1), (None, base[0], "web", 1, "p", "f", "h", 1), (None, None, None, 1, "p", "f", "h", 1)]


def test_filter_audit(spark, audit_rows):
    labels = [(1, 1, 0), (3, 0, 1), (5, 1, 1), (5, 0, 0), (7, None, None), (None, 1, 1), (9, 1, None), (11, None, 1), (999, 1, 1)]
    got = filter_audit.filter_audit(spark.createDataFrame(audit_rows, DOCS).repartition(4), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()
    assert {(r.part, r.filter_order, r.step): [r[c] for c in filter_audit.COUNTS] for r in got} == plain_audit(audit_rows, labels)
    assert len(got) == 600 * 3


def test_filter_audit_lattice():
    assert len(filter_audit.lattice()) == 80 and len(filter_audit.steps()) == 600
    assert sum(orders for _, f, orders in filter_audit.lattice() if f == 0) == 120


def test_filter_audit_empty(spark):
    assert filter_audit.filter_audit(spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id bigint, quality int, toxic int")).count() == 0


def plain_negatives(rows, every=50, positives=5, negatives=3):
    ok = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        c = ((label + 1) % 10 if i % 7 == 0 else label, [min(hard_negatives.LARGEST, max(-hard_negatives.LARGEST, math.floor(256 * min(1 << 28, max(-(1 << 28), x))))) for x in v])
        ok[i] = min(ok.get(i, c), c)
    out = []
    for a in (i for i in ok if i % every == 0):
        s = {i: sum(x * y for x, y in zip(ok[a][1], ok[i][1])) for i in ok if i != a and len(ok[i][1]) == len(ok[a][1])}
        for p in sorted((i for i in s if ok[i][0] == ok[a][0]), key=lambda i: (-s[i], i))[:positives]:
            n = sorted((i for i in s if ok[i][0] != ok[a][0] and 50 * s[p] <= 100 * s[i] <= 95 * s[p]), key=lambda i: (-s[i], i))[:negatives]
            out += [(a, p, k + 1, i, s[p], s[i]) for k, i in enumerate(n)]
    return sorted(out)


VECTORS = "vec_id bigint, embedding array<float>, label int, v string, id string, score double, code string"


@pytest.fixture(scope="module")
def vectors():
    rng = random.Random(9)
    rows, copy, centre = [], [0.25, -0.5, 0.125, 0.5, 0.0, 0.25], [rng.uniform(-0.5, 0.5) for _ in range(6)]
    for i in range(700):
        v = [round(rng.uniform(-0.6, 0.6), 3) for _ in range(6)]
        if i % 3 == 0:
            v = copy  # a third of all rows are one vector
        elif i % 5 == 0:
            v = [c + rng.uniform(-0.01, 0.01) for c in centre]
        rows.append((i, v, i % 4))
    rows += [(1000, None, 1), (1050, [0.1] * 6, None), (1100, [0.1, None, 0.1, 0.1, 0.1, 0.1], 1), (1150, [float("nan")] * 6, 1), (1200, [float("inf")] * 6, 2), (None, copy, 1), (1250, [0.0] * 6, 1), (1300, [0.5] * 3, 1), (1301, [0.4] * 3, 1), (1303, [0.3] * 3, 2), (1350, [], 1), (1351, [], 1), (1400, [3e30] * 6, 2), (1401, [2e30] * 6, 2), (1450, [3e30] * 100, 3), (1451, [1e30] * 100, 3), (1453, [1e30] * 50 + [0.0] * 50, 1)]
    rows += [rows[50], rows[50], (100, [0.9] * 6, 0), (51, [0.2] * 6, 3)]
    return [(i, v, label, "v", "i", 0.5, "c") for i, v, label in rows]


@pytest.mark.parametrize("tile", [(4, 64), hard_negatives.TILE])
@pytest.mark.parametrize("cells", [4, hard_negatives.CELLS])
def test_hard_negatives(spark, vectors, tile, cells):
    got = hard_negatives.hard_negatives(spark.createDataFrame(vectors, VECTORS).repartition(4), tile=tile, cells=cells).collect()
    import numpy as np

    want = plain_negatives([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label, *_ in vectors])
    assert len(want) > 50 and sorted(map(tuple, got)) == want


def test_hard_negatives_empty(spark):
    assert hard_negatives.hard_negatives(spark.createDataFrame([], VECTORS)).count() == 0
    one = spark.createDataFrame([(50, [0.5, 0.5], 1, "v", "i", 0.0, "c")], VECTORS)
    assert hard_negatives.hard_negatives(one).count() == 0  # an anchor without positives


def test_bounds_hold_scores(spark, vectors):
    """Every exact score lies within the looked-up bounds."""
    rows = hard_negatives.usable(spark.createDataFrame(vectors[:300], VECTORS)).cache()
    lows, highs = hard_negatives.cell_bounds(rows, 8)
    codes = hard_negatives.approximations(rows, lows).collect()
    whole = {r.id: r.v for r in rows.collect()}
    import numpy as np

    lo, hi = hard_negatives._tables(np.array([whole[50], whole[100]], np.int64), lows, highs)
    for r in codes:
        for k, a in enumerate((50, 100)):
            score = sum(x * y for x, y in zip(whole[a], whole[r.id]))
            at = list(enumerate(r.code))
            assert sum(lo[d][c][k] for d, c in at) <= score <= sum(hi[d][c][k] for d, c in at)


TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans(license_scan.UPPER, license_scan.LOWER)


def plain_licenses(text, templates=license_scan.TEMPLATES, share=license_scan.CONTAINMENT):
    w = TOKEN.findall((text or "").translate(LOWER))
    base = [(i, lab) for p, lab in license_scan.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    words = [re.findall(r"\w+", t.lower()) for _, t in templates]
    stride, best, labels = max(map(len, words)), 0.0, {lab for _, lab in base}
    for start in range(0, max(1, len(w) - stride), stride):
        block = set(w[start : start + 2 * stride])
        for (lab, _), toks in zip(templates, words):
            part = len(block & set(toks)) / len(set(toks))
            if part >= share - 1e-12:
                best, labels = max(best, part), labels | {lab}
    at = [i for i, _ in base]
    return len(w), len(base), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), round(1.0 if base else best, 6)


def license_texts():
    rng = random.Random(8)
    filler = lambda n: " ".join(rng.choice(["the", "of", "work", "license", "under", "Ünïcode", "licensed", "by", "a7", "software", "to", "and"]) for _ in range(n))
    texts = [None, "", " \n", "MIT License", "mit-license mit/LICENSE", "cc by cc BY-NC 4.0", "apache license apache license", "gnu general public", "GNU GENERAL\x00PUBLIC LICENSE", "İMIT LICENSE ſ", "word " * 60_000 + "MIT License"]
    for _, t in license_scan.TEMPLATES:
        w = t.split()
        texts += [f"{filler(rng.randint(0, 90))} {t} {filler(40)}", " ".join(w[: int(len(w) * 0.85)]), " ".join(w[: int(len(w) * 0.6)]), filler(31) + " " + " ".join(rng.sample(w, len(w)))]
    return [*texts, *(filler(n) for n in (1, 20, 33, 64, 65, 200))]


LICENSE_DOCS = "doc_id bigint, text string, n_words string, label string, t string, tok int, _w string"


@pytest.mark.parametrize("share", [license_scan.CONTAINMENT, 0.5])
def test_license_scan(spark, share):
    texts = license_texts()
    rows = [(i, t, "n", "l", "t", 1, "w") for i, t in enumerate(texts)]
    rows += [rows[13], (None, texts[14], "n", "l", "t", 1, "w"), (3, "no license", "n", "l", "t", 1, "w")]
    got = sorted((tuple(r) for r in license_scan.license_scan(spark.createDataFrame(rows, LICENSE_DOCS).repartition(4), share=share).collect()), key=repr)
    want = sorted(((d, *plain_licenses(t, share=share)) for d, t, *_ in rows), key=repr)
    assert got == want


def test_license_scan_empty(spark):
    assert license_scan.license_scan(spark.createDataFrame([], LICENSE_DOCS)).count() == 0
    none = license_scan.license_scan(spark.createDataFrame([(1, "mit license", "n", "l", "t", 1, "w")], LICENSE_DOCS), templates=[]).collect()
    assert none[0].labels == "mit" and none[0].score == 1.0


def test_prefix_tokens_are_the_rarest(spark):
    order = license_scan.token_order(spark.createDataFrame([(1, "a a a b b c", "", "", "", 1, "")], LICENSE_DOCS), ["a", "b", "c", "z"])
    assert order == ["z", "c", "b", "a"]
