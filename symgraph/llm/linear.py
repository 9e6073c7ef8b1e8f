"""Logistic regression on hashed features, trained with follow-the-regularised-leader updates."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows a model is fitted on at most: those first by a hash of doc_id.
SAMPLE = 8192


@dataclass(frozen=True)
class Fit:
    bits: int = 18
    epochs: int = 4
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.5
    l2: float = 1.0
    positive: float = 1.0  # weight of a label of 1


def train(samples: Iterable[tuple], fit: Fit):
    """samples: (ids, values, label), ids distinct. Returns the weights, the last one the bias.

    Per coordinate: z gathers gradients less what the rate's change explains, n their squares; the weight is
    zero within l1, else what minimises the regularised sum so far. The bias is free of l1.
    """
    import numpy as np

    z, n = np.zeros((1 << fit.bits) + 1), np.zeros((1 << fit.bits) + 1)
    bias = 1 << fit.bits

    def weights(at):
        zi = z[at]
        w = (np.sign(zi) * fit.l1 - zi) / ((fit.beta + np.sqrt(n[at])) / fit.alpha + fit.l2)
        return np.where(np.abs(zi) <= fit.l1, 0.0, w)

    def free(at):
        return -z[at] / ((fit.beta + np.sqrt(n[at])) / fit.alpha)

    samples = list(samples)
    for epoch in range(fit.epochs):
        for k in np.random.default_rng(epoch).permutation(len(samples)):
            ids, values, label = samples[k]
            w, b = weights(ids), free(bias)
            error = (1 / (1 + np.exp(-np.clip(b + w @ values, -35, 35))) - label) * (fit.positive if label else 1.0)
            for at, old, g in ((ids, w, error * values), (bias, b, error)):
                g2 = g * g
                z[at] += g - (np.sqrt(n[at] + g2) - np.sqrt(n[at])) / fit.alpha * old
                n[at] += g2
    out = weights(slice(None))
    out[bias] = free(bias)
    return out.astype(np.float32)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, label: str, limit: int = SAMPLE) -> DataFrame:
    """text and label of at most limit labelled documents outside the held-out fold.

    Labels that repeat count as their largest; null ones aren't used. What is broadcast has limit rows.
    """
    own = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    own = own.groupBy(F.col("doc_id").alias("l_id")).agg(F.max(label).cast("int").alias("label"))
    chosen = own.orderBy(F.xxhash64("l_id"), "l_id").limit(limit)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", text.alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id")).select("doc_id", "text", "label")


def fitted(sample: DataFrame, features: Callable, fit: Fit):
    """The weights for a bounded sample of text and label, computed in one task on an executor.

    features(texts) yields (ids, values) of each text. No labels: all weights zero.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        rows = []
        for b in batches:
            ids, texts, labels = (b.column(c).to_pylist() for c in ("doc_id", "text", "label"))
            rows += [(i, *f, y) for i, f, y in zip(ids, features(texts), labels, strict=True)]
        rows.sort(key=lambda r: (r[0], r[3], len(r[1])))  # tasks deliver them in any order
        w = train([r[1:] for r in rows], fit) if rows else np.zeros((1 << fit.bits) + 1, np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary())], ["w"])

    import numpy as np

    found = sample.repartition(1).mapInArrow(run, "w binary").collect()
    return np.frombuffer(found[0][0], np.float32) if found else np.zeros((1 << fit.bits) + 1, np.float32)


def sigmoid(x: float) -> float:
    from math import exp

    return 1 / (1 + exp(-x)) if x >= 0 else (e := exp(x)) / (1 + e)
