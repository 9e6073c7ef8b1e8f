"""Scores and updates of the linear models, computed plainly from their definitions."""

import math
import re
from collections import defaultdict

import numpy as np
import pytest
from xxhash import xxh32_intdigest

from symgraph.llm import linear, quality_classifier, toxicity
from symgraph.llm.quality_classifier import FIT, SCALE

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")


def sigmoid(x):
    return 1 / (1 + math.exp(-x))


def plain_shape(word):
    out = ""
    for c in word:
        k = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        out += k if not out or out[-1] != k else ""
    return out


def quality_features(text, bits):
    """Feature number -> value: each kind's shares, times SCALE."""
    words = [p for w in re.findall(r"[^\x20\x09-\x0D]+", text) for p in (w[k : k + 32] for k in range(0, len(w), 32))]
    word = [xxh32_intdigest(w.lower().encode()) for w in words]
    form = [xxh32_intdigest(plain_shape(w).encode(), 7) for w in words]
    mix = lambda h, salt: ((h * 0x9E3779B97F4A7C15 + salt) % 2**64 >> 32) >> 32 - bits
    pair = lambda hs: [(a * 31 + b) % 2**64 for a, b in zip(hs, hs[1:], strict=False)]
    kinds = [(word, 1), (form, 2), (pair(word), 3), (pair(form), 4), ([int(a == b) for a, b in zip(word, word[1:], strict=False)], 5)]
    out = defaultdict(float)
    for hashes, salt in kinds:
        for h in hashes:
            out[mix(h, salt)] += SCALE / len(hashes)
    return out


def test_quality_scores(spark, tables):
    docs, labels = tables
    long = spark.createDataFrame([(10**6 + k, t, "en", "s", 1) for k, t in enumerate(["日本語" * 400, "aB3$" * 3000, "", None, "one"])], docs.schema)
    docs = docs.unionByName(long)
    weights = quality_classifier.model(docs, labels)
    got = {r.doc_id: r.score for r in quality_classifier.query(docs, labels).collect()}
    assert np.count_nonzero(weights) > 50
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    for i, text in texts.items():
        dot = float(weights[-1]) + sum(float(weights[f]) * v for f, v in quality_features(text, FIT.bits).items())
        assert got[i] == pytest.approx(sigmoid(dot), abs=1e-6), i
    # Training sees the features that scoring sees.
    run = quality_classifier.features(FIT.bits)
    for text in list(texts.values())[:40]:
        ((ids, values),) = run([text])
        plain = quality_features(text, FIT.bits)
        assert dict(zip(ids.tolist(), values.tolist(), strict=True)) == pytest.approx(plain, abs=1e-4)


def test_the_whole_of_a_long_word_counts():
    f = quality_classifier.Featurizer(FIT.bits)
    a, b = ("x" * 5000 + end for end in ("abc", "!?1"))
    assert any((p != q).any() if len(p) == len(q) else True for p, q in zip(f.kinds(a), f.kinds(b), strict=True))


def test_toxicity_scores(tables):
    docs, labels = tables
    costs, weights = toxicity.model(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.query(docs, labels).collect()}
    restorer, bits = toxicity.Restorer(costs), toxicity.FIT.bits
    assert np.count_nonzero(weights) > 3
    for r in docs.select("doc_id", "text").collect():
        found = set()
        for w in restorer.words(r.text or ""):
            found |= {xxh32_intdigest(p.encode()) >> 32 - bits for p in [w, *(w[:k] + "~" for k in (4, 5, 6, 7) if len(w) >= k)]}
        assert got[r.doc_id] == pytest.approx(sigmoid(float(weights[-1]) + sum(float(weights[f]) for f in found)), abs=1e-9)


def test_character_costs(tables):
    docs, _ = tables
    symbol = lambda c: ord(c) - 96 if "a" <= c <= "z" else 27 if c.isalpha() else 0
    n = np.zeros((28, 28, 28))
    for r in docs.select("text").collect():
        s = [0, 0, *(symbol(c.lower()[0]) for c in r.text or ""), 0]
        for a, b, c in zip(s, s[1:], s[2:], strict=False):
            n[a, b, c] += 1
    pairs = n.sum(0) + 0.1
    pairs /= pairs.sum(1, keepdims=True)
    assert np.allclose(toxicity.character_model(docs), -np.log((n + 20 * pairs[None]) / (n.sum(2, keepdims=True) + 20)))


def plain_training(samples, fit):
    """Follow the regularised leader, a coordinate at a time, in dictionaries; the bias is the coordinate None."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        rate = (fit.beta + math.sqrt(n[i])) / fit.alpha
        if i is None:
            return -z[i] / rate
        return 0.0 if abs(z[i]) <= fit.l1 else (math.copysign(fit.l1, z[i]) - z[i]) / (rate + fit.l2)

    for epoch in range(fit.epochs):
        for k in np.random.default_rng(epoch).permutation(len(samples)):
            ids, values, label = samples[k]
            w = {i: weight(i) for i in [*ids.tolist(), None]}
            x = {**dict(zip(ids.tolist(), values.tolist(), strict=True)), None: 1.0}
            error = (sigmoid(sum(w[i] * v for i, v in x.items())) - label) * (fit.positive if label else 1.0)
            for i, v in x.items():
                g = error * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / fit.alpha * w[i]
                n[i] += g * g
    return weight


def test_training_is_the_plain_rule():
    rng = np.random.default_rng(3)
    fit = linear.Fit(bits=5, epochs=3, alpha=0.4, l1=0.2, l2=0.7, positive=1.5)
    samples = [(np.sort(rng.choice(32, rng.integers(0, 9), replace=False)), None, int(rng.integers(2))) for _ in range(120)]
    samples = [(ids, rng.normal(size=len(ids)), y) for ids, _, y in samples]
    got, plain = linear.train(samples, fit), plain_training(samples, fit)
    assert got == pytest.approx([plain(i) for i in [*range(32), None]], abs=1e-5)
