"""Quality classifier: logistic regression on hashed word n-grams."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linear import SAMPLE, Fit, fitted, held_out, labelled, sigmoid

FIT = Fit(bits=18, epochs=4, alpha=0.5, l1=0.3, l2=0.5)
THRESHOLD = 0.3
#: A feature's value is its share of the text's features of its kind, times this.
SCALE = 20.0
REMEMBERED = 300_000
_RUNS = re.compile(r"(.)\1+", re.S)
#: Words; longer ones, as of texts without white space, count as so many words of 32 characters.
_WORD = re.compile(r"[^\x20\x09-\x0D]{1,32}")


def shape(word: str) -> str:
    """The word with letters as a or A, digits as 0, and repeats left out."""
    kinds = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word)
    return _RUNS.sub(r"\1", kinds)


class Featurizer:
    """Hashed uni- and bigrams of the words, of their shapes, and of a word with itself."""

    def __init__(self, bits: int):
        self.bits = bits
        self.known: dict[str, int] = {}

    def _hash(self, word: str) -> int:
        from xxhash import xxh32_intdigest

        return xxh32_intdigest(word.lower().encode()) << 32 | xxh32_intdigest(shape(word).encode(), 7)

    def kinds(self, text: str) -> list:
        """Arrays of feature numbers, one for each kind that the text has."""
        import numpy as np

        words, known = _WORD.findall(text), self.known
        if not words:
            return []
        new = [w for w in set(words) if w not in known]
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = list(set(words))
        known.update((w, self._hash(w)) for w in new)
        both = np.fromiter((known[w] for w in words), np.uint64, len(words))
        word, form = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
        low = np.uint64(32 - self.bits)
        mix = lambda h, salt: ((h * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)) >> np.uint64(32)) >> low
        out = [mix(word, 1), mix(form, 2)]
        if len(words) > 1:
            out.append(mix(word[:-1] * np.uint64(31) + word[1:], 3))
            out.append(mix(form[:-1] * np.uint64(31) + form[1:], 4))
            out.append(mix((word[1:] == word[:-1]).astype(np.uint64), 5))
        return out


def features(bits: int) -> Callable:
    """For fitted(): (ids, values) of each text."""

    def run(texts: list[str]) -> Iterator[tuple]:
        import numpy as np

        featurizer = Featurizer(bits)
        for t in texts:
            kinds = featurizer.kinds(t)
            if not kinds:
                yield np.zeros(0, np.int32), np.zeros(0, np.float32)
                continue
            at = np.concatenate(kinds).astype(np.int64)
            values = np.concatenate([np.full(len(k), SCALE / len(k)) for k in kinds])
            ids, where = np.unique(at, return_inverse=True)
            yield ids.astype(np.int32), np.bincount(where, values).astype(np.float32)

    return run


def model(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE, fit: Fit = FIT):
    """The weights learnt from at most limit labelled documents outside the held-out fold."""
    return fitted(labelled(docs, labels, "quality", limit), features(fit.bits), fit)


def scorer(weights, bits: int) -> Callable:
    """texts -> scores: the sparse dot product of a text's features with the weights."""
    featurizer = Featurizer(bits)

    def run(texts: list[str | None]) -> list[float]:
        out = []
        for t in texts:
            dot = float(weights[-1]) + sum(SCALE * float(weights[k].mean(dtype="f8")) for k in featurizer.kinds(t or ""))
            out.append(sigmoid(dot))
        return out

    return run


def scored(docs: DataFrame, weights, bits: int, *more: str) -> DataFrame:
    """doc_id, more and score of every document; only the weights, of fixed size, are broadcast."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        score = scorer(sent.value, bits)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score(b.column("text").to_pylist()), pa.float64())], [*b.schema.names, "score"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *more)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", score double"
    return rows.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE, threshold: float = THRESHOLD, fit: Fit = FIT) -> DataFrame:
    """A row a document: doc_id, held_out, score (0 to 1, higher: quality 1 likelier), predicted.

    Whole texts are scored; null and empty ones have the bias alone. Without labels all scores are 0.5. A
    null doc_id is in no fold and has no label. Rows that repeat are scored each. No rows: no rows.
    """
    out = scored(docs, model(docs, labels, limit, fit), fit.bits)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, columns: tuple[str, ...], threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with columns, that the classifier doesn't reject."""
    rest = [c for c in columns if c not in ("doc_id", "text")]
    out = scored(docs, model(docs, labels), FIT.bits, *rest)
    return out.where(F.col("score") >= threshold).select(*columns)


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return classify(docs, labels)
