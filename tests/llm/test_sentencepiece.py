import os
import random

import numpy as np
import pytest

from tallyforge.llm import sentencepiece_codec as sc

pytestmark = pytest.mark.skipif(not os.path.exists(sc.MODEL), reason="no model file")
TEXTS = ["", " ", "a", "hello world", " a  b \n", "x" * 300, "ab" * 200 + "é€😀" * 5, "thethethe andandand   " * 30, "Ωmega\t\x00 naïve", "▁▁a▁b", "   lead", "internationalization" * 12]


@pytest.fixture(scope="module")
def codec():
    return sc.codec(sc.MODEL)


@pytest.mark.parametrize("text", TEXTS)
def test_same_ids_as_the_library(codec, text):
    assert codec.encode(text).tolist() == codec.sp.encode(text)
    assert codec.decode(codec.encode(text)) == text.replace("▁", " ")


def in_chunks(codec, text, chunk):
    s = codec.escaped(text)
    parts = list(sc.chunked(s, chunk, codec.longest + 1))
    m = [codec.transfer(t, a, b, c == 0, c == n - 1) for c, n, t, a, b in parts]
    return [i for (c, n, t, a, b), (x, y) in zip(parts, sc.path_states(m)) for i in codec.trace(t, a, b, c == 0, c == n - 1, x, y).tolist()]


@pytest.mark.parametrize("seed", range(12))
def test_chunks_give_the_whole(codec, seed):
    rng = random.Random(seed)
    alphabet = rng.choice(["ab ", "the rina", "aeéΩ ", "0123456789", "ing tion"])
    text = "".join(rng.choice(alphabet) for _ in range(400)) + rng.choice(TEXTS)
    for chunk in (32, 57, 1000):
        assert in_chunks(codec, text, chunk) == codec.sp.encode(text)


def test_composition_is_associative(codec):
    s = codec.escaped("the theory of thermodynamics " * 12)
    m = [codec.transfer(t, a, b, c == 0, c == n - 1) for c, n, t, a, b in sc.chunked(s, 40, codec.longest + 1)]
    assert np.array_equal(sc.compose(sc.compose(m[0], m[1]), m[2]), sc.compose(m[0], sc.compose(m[1], m[2])))
    assert not np.isinf(__import__("functools").reduce(sc.compose, m)).any()


def test_documents(spark, docs, corpus, codec):
    got = sorted((str(r.doc_id), r.text or "", r._ids) for r in sc.encode_documents(docs, giant=500, chunk=120).collect())
    want = sorted((str(c[0]), c[1] or "", codec.sp.encode(c[1] or "")) for c in corpus)
    assert got == want


def test_report(docs, no_docs, corpus):
    rows = sc.codec_report(docs, giant=2000, chunk=700).collect()
    assert len(rows) == len(corpus) and all(r.round_trip for r in rows)
    assert sc.codec_report(no_docs).collect() == []
    assert sc.encode_stage(docs).columns == [*docs.columns, "token_ids"]


def test_decode_frame(docs):
    rows = sc.decode_documents(sc.encode_documents(docs)).collect()
    assert all(r._decoded == (r.text or "") for r in rows)


def test_tree_of_many_chunks(codec):
    """Odd numbers of chunks, a fixed last state, and texts without a start of a word for many chunks."""
    rng = random.Random(3)
    for n in (1, 2, 3, 7, 33):
        text = ("".join(rng.choice("abinge") for _ in range(30 * n)) + " and " + "the rain " * n)[: 40 * n]
        assert codec.encode(text, 40).tolist() == codec.sp.encode(text)
        parts = list(sc.chunked(codec.escaped(text), 40, codec.longest + 1))
        m = [codec.transfer(t, a, b, c == 0, c == k - 1) for c, k, t, a, b in parts]
        at = sc.path_states(m)
        assert sc.path_states(m, 0, at[-1][1]) == at and all(x[1] == y[0] for x, y in zip(at, at[1:]))
        assert np.array_equal(sc.product(m), __import__("functools").reduce(sc.compose, m))


def test_no_path_is_an_error():
    with pytest.raises(ValueError):
        sc.path_states([np.full((1, 2), -np.inf, np.float32), np.zeros((2, 1), np.float32)])


def test_a_text_of_megabytes(spark, codec):
    text = "the quick brown fox naïve 日本語 " * 60_000 + "x" * 40_000 + " end"
    df = spark.createDataFrame([(1, text), (2, "short")], "doc_id int, text string")
    rows = {r.doc_id: r for r in sc.encode_documents(df, check=True).collect()}
    assert rows[1]._ids == codec.sp.encode(text) and rows[1]._same and rows[2]._ids == codec.sp.encode("short")
