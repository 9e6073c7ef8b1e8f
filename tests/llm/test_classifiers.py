"""Quality classifier and toxicity: held-out accuracy, deobfuscation, awkward rows."""

import math
import zlib

import numpy as np
import pytest
from rows import DOCS, spoilt

from symgraph.llm import linear, quality_classifier, toxicity

DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")


@pytest.mark.parametrize(("module", "label", "threshold", "least"), [(quality_classifier, "quality", 0.3, 0.97), (toxicity, "toxic", 0.5, 0.95)])
def test_held_out_accuracy(tables, module, label, threshold, least):
    docs, labels = tables
    got = module.query(docs, labels).collect()
    assert len(got) == docs.count()
    truth = {r.doc_id: r[label] for r in labels.collect()}
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold)
    own = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in own) / len(own) >= least


@pytest.mark.parametrize("module", [quality_classifier, toxicity])
def test_awkward_rows(spark, awkward, no_docs, tables, module):
    labels = spark.createDataFrame([(5, 1, 0), (5, 0, 1), (6, None, 1), (None, 1, 1), (7, 1, None), (8, 0, 1), (99999, 1, 1)], "doc_id long, quality int, toxic int")
    got = module.query(awkward, labels)
    assert got.count() == awkward.count()
    assert got.where("score IS NULL OR predicted IS NULL OR held_out IS NULL").count() == 0
    assert got.where("doc_id IS NULL AND held_out").count() == 0
    assert module.query(no_docs, labels).count() == 0
    none = module.query(awkward, labels.where("false"))
    assert {r.score for r in none.collect()} == {0.5}


def test_labels_alone_are_learnt_from(tables, spark):
    """Neither the held-out fold's labels nor other columns change a score."""
    docs, labels = tables
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality", "toxic")
    renamed = docs.selectExpr("doc_id", "text", "'x' AS lang", "concat('z', source) AS source", "n_chars")
    scores = lambda d, x: {r.doc_id: r.score for r in quality_classifier.query(d, x).collect()}
    assert scores(docs, labels) == scores(renamed.repartition(5), flipped)


def test_training_is_the_update_rule():
    """One coordinate, by hand: z and n, and the weight they give."""
    fit = linear.Fit(bits=1, epochs=1, alpha=0.5, beta=1.0, l1=0.1, l2=0.2)
    w = linear.train([(np.array([1]), np.array([2.0]), 1)], fit)
    g = (0.5 - 1) * 2.0
    z, n = g, g * g
    assert w[1] == pytest.approx(-(z + 0.1) / ((1.0 + math.sqrt(n)) / 0.5 + 0.2), rel=1e-6)
    bias = -0.5
    assert w[2] == pytest.approx(-bias / ((1.0 + 0.5) / 0.5), rel=1e-6) and w[0] == 0


def test_separable_data_is_learnt():
    rng = np.random.default_rng(0)
    rows = [(np.array([k % 2, 2 + int(rng.integers(6))]), np.ones(2), k % 2) for k in range(400)]
    w = linear.train(rows, linear.Fit(bits=3, epochs=3, l1=0.1))
    assert all((w[-1] + w[ids].sum() > 0) == y for ids, _, y in rows)


def model_of(*texts):
    """Costs as character_model() counts them, for a few texts."""
    batch = next(toxicity._counts(iter([_batch(texts)])))
    n = np.zeros(toxicity.SYMBOLS**3)
    n[batch.column("gram").to_numpy()] = batch.column("n").to_numpy()
    n = n.reshape((toxicity.SYMBOLS,) * 3)
    pairs = (n.sum(0) + 0.1) / (n.sum(0) + 0.1).sum(1, keepdims=True)
    return -np.log((n + 20 * pairs[None]) / (n.sum(2, keepdims=True) + 20))


def _batch(texts):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(list(texts), pa.string())], ["text"])


@pytest.fixture(scope="module")
def restorer():
    words = "the silly person is an idiot and a loser and a moron who is stupid and worthless trash nobody wants to see here again"
    return toxicity.Restorer(model_of(*[words] * 40))


@pytest.mark.parametrize(
    ("written", "meant"),
    [("1d10t", "idiot"), ("i d i o t", "idiot"), ("i.d.i.o.t", "idiot"), ("l0ser", "loser"), ("stuuuupid", "stupid"), ("$tup1d!!", "stupid"), ("M0R0N", "moron"), ("w0rthl3ss,", "worthless"), ("tr@sh", "trash")],
)
def test_deobfuscation(restorer, written, meant):
    assert meant in restorer.words(f"You are {written} today")


def test_plain_words_stay_and_long_spans_end(restorer):
    assert restorer.words("The (silly) person's café 555-5132 ***") == {"the", "silly", "person's", "café", "555-5132"}
    assert restorer.words("a1" * 5000) and restorer.words("a " * 5000) and restorer.words("") == set()


def test_viterbi_is_the_best_path(restorer):
    """Against all paths of a small lattice."""
    from itertools import product

    for span in ("1d10t", "l0o0ser", "aaab1"):
        slots = [*toxicity.lattice(span), [(" ", 0.0)]]

        def cost(path):
            a = b = 0
            total = 0.0
            for string, more in path:
                total += more
                for c in string:
                    s = toxicity._symbol(c)
                    total += restorer.costs[a][b][s]
                    a, b = b, s
            return total

        best = min(product(*slots), key=cost)
        found = toxicity.decode(span, restorer.costs)
        assert found == "".join(s for s, _ in best)[:-1]


def test_counts_of_pieces_are_those_of_the_whole():
    text = "abc déf " * 50
    pieces = list(toxicity._cut(text, 7))
    whole = f"  {text} "
    assert "".join(p[2:] for p in pieces) == whole[2:] and all(len(p) <= 9 for p in pieces)


def test_toxic_documents_in_any_writing(spark, tables):
    docs, labels = tables
    rows = [(10_000 + k, f"The quiet house by the river was warm. {w} They walked home.", "en", "s", 1) for k, w in enumerate(("1d10t m0r0n", "i d i o t and m o r o n", "idiiiot moroooon", "all is well"))]
    extra = spark.createDataFrame(spoilt(rows), DOCS).select(*docs.columns)
    got = {r.doc_id: r.score for r in toxicity.query(docs.unionByName(extra), labels).where("doc_id >= 10000").collect()}
    assert min(got[10_000], got[10_001], got[10_002]) > 2 * got[10_003]
