from test_native import TEXTS, scanned

from tallyforge.llm import secrets


def test_repeated_rows_scan_like_one(spark):
    """Three copies of each row (same id, same text) have the spans of a single one."""
    want = scanned(spark, TEXTS)
    rows = [(i, t, "k") for i, t in enumerate(TEXTS)] * 3
    got = secrets.secret_scan(spark.createDataFrame(rows, "doc_id bigint, text string, start string").repartition(4)).collect()
    assert len(got) == 3 * len(TEXTS)
    assert any(r.n_assign for r in got) and any(r.n_linked for r in got)
    assert all(r == want[r.doc_id] for r in got)


def test_repeated_rows_without_id(spark):
    rows = [(None, TEXTS[0]), (None, TEXTS[0]), (None, TEXTS[4])]
    got = secrets.secret_scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    want = scanned(spark, [TEXTS[0], TEXTS[4]])
    assert sorted(r.spans for r in got) == sorted([want[0].spans, want[0].spans, want[1].spans])
