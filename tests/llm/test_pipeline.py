"""The pipeline's stages, each against plain Python on its own input."""

from collections import defaultdict

import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from symgraph.llm import packing, quality_classifier

DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def results(spark):
    """The input and the result of each stage, as collected rows."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet").withColumn("kept", F.lit("clashes"))
    out = [docs.select(*cp.DOCUMENT_COLUMNS).collect()]
    for name, stage in cp.STAGES:
        docs = cp.written(stage(spark, docs, DIR), "test")
        out.append(docs.collect())
        if name != "packing":
            assert tuple(docs.columns) == cp.DOCUMENT_COLUMNS
            docs = docs.withColumn("kept", F.lit("clashes")).withColumn("gone", F.lit(1))
    return out


def test_classifier_keeps_clean_documents(spark, results):
    before, after = results[0], results[1]
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    scores = {r.doc_id: r.score for r in quality_classifier.query(spark.read.parquet(f"{DIR}/documents.parquet"), labels).collect()}
    assert {r.doc_id for r in after} == {r.doc_id for r in before if scores[r.doc_id] >= 0.3}
    clean = {r.doc_id for r in labels.where("quality = 1").collect()}
    assert len(clean - {r.doc_id for r in after}) <= 0.01 * len(clean)
    assert {tuple(r) for r in after} <= {tuple(r) for r in before}


def test_lines_are_dropped(results):
    before, after = results[1], {r.doc_id: r for r in results[2]}
    expected = {r[0]: r for r in brute.line_dedup([(r.doc_id, r.text) for r in before])}
    import hashlib

    for r in before:
        _, _, dropped, digest = expected[r.doc_id]
        if r.doc_id in after:
            assert hashlib.sha256(after[r.doc_id].text.encode()).hexdigest() == digest and after[r.doc_id].n_chars == len(after[r.doc_id].text)
        else:
            assert dropped > 0
    assert len(after) < len(before)


def test_one_document_of_each_group_stays(results):
    before, after = results[2], {r.doc_id for r in results[3]}
    fp = {r.doc_id: brute.fingerprint(r.text) for r in before}
    component = brute.components(sorted(fp), lambda i, j: (fp[i] ^ fp[j]).bit_count() <= 4)
    assert after == set(component.values())


def test_sources_are_mixed(results):
    before, after = results[3], results[4]
    sizes, taken = defaultdict(int), defaultdict(int)
    own = {r.doc_id: r for r in before}
    for r in before:
        sizes[r.source] += len(brute.words(r.text))
    for r in after:
        taken[r.source] += len(brute.words(r.text))
        assert len(brute.words(r.text)) <= 2 * len(brute.words(own[r.doc_id].text))
    assert all(abs(taken[s] - t) <= 0.5 for s, t in brute.targets(sizes).items())


def test_all_is_packed(results):
    before, pieces = results[4], results[5]
    tokens = defaultdict(int)
    for p in pieces:
        tokens[p.doc_id] += p.length
    t = packing.WordTokenizer(packing.tokenizer_path())
    assert tokens == {r.doc_id: len(t.encode(r.text)) // 4 + 1 for r in before}
    assert sum(tokens.values()) > packing.LENGTH * max(p.sequence_id for p in pieces)


def test_run_is_all_stages(spark, results):
    assert cp.run(spark, DIR).count() == len(results[5])


def test_empty_and_null_documents(spark):
    schema = spark.read.parquet(f"{DIR}/documents.parquet").schema
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (None, "a b", "en", "s", 3), (3, "one\ntwo", "en", None, 7), (3, "one\ntwo", "en", None, 7)], schema)
    for rows in (odd, odd.limit(0)):
        docs = rows
        for _, stage in cp.STAGES:
            docs = cp.written(stage(spark, docs, DIR), "odd")
        assert docs.count() >= 0
