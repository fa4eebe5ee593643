import os

import pytest

import corpus_pipeline
from tallyforge.llm import sentencepiece_codec as sc

pytestmark = pytest.mark.skipif(not os.path.exists(sc.MODEL), reason="no model file")


def test_last_stage_decodes(spark, docs, corpus):
    """The pipeline's last stage says of every document whether its ids decode to its text."""
    stage = dict(corpus_pipeline.STAGES)["tokens"]
    out = stage(spark, docs, "")
    assert out.columns == [*docs.columns, "token_ids", "round_trip"]
    rows = out.collect()
    assert len(rows) == len(corpus) and all(r.round_trip is True for r in rows)


def test_giants_are_decoded(docs, corpus):
    rows = sc.codec_stage(docs, giant=500).collect()
    assert len(rows) == len(corpus) and all(r.round_trip is True for r in rows)


def test_a_lost_text_is_told():
    k = sc.codec(sc.MODEL)
    ids = k.encode("one two three")
    assert sc.gives_back(k, ids, "one two three") and not sc.gives_back(k, ids[1:], "one two three")
    assert sc.gives_back(k, k.encode("a▁b"), "a▁b") and sc.gives_back(k, [], None)
