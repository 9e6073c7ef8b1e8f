"""The near-dedup stage on rows without doc_id and on a doc_id of several texts."""

import random

import corpus_pipeline as cp


def test_a_row_of_each_group_stays(spark):
    rng = random.Random(3)
    text = lambda: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(60))
    a, b, c, d, e = (text() for _ in range(5))
    rows = [(None, a), (None, a), (None, b), (1, c), (1, d), (1, d), (2, d), (3, e), (None, e)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in cp.dedup_near(spark, docs, "").collect()]
    assert len(got) == 5 and set(got) == {(None, a), (None, b), (1, c), (1, d), (3, e)}
