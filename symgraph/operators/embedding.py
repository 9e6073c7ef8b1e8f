"""Embedding: providers of vectors, and vectors from token vectors."""

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType


class Provider(Protocol):
    """Vectors for rows of owner_type, owner_key, text: those columns' keys with vector."""

    def embed(self, texts: DataFrame) -> DataFrame: ...


class NoProvider:
    """No vectors: searches have no semantic signal."""

    def embed(self, texts: DataFrame) -> DataFrame:
        return texts.select("owner_type", "owner_key", F.lit(None).cast("array<float>").alias("vector")).where("false")


class TableProvider:
    """Vectors that are in a table already."""

    def __init__(self, vectors: DataFrame):
        self.vectors = vectors

    def embed(self, texts: DataFrame) -> DataFrame:
        return texts.select("owner_type", "owner_key").join(self.vectors, ["owner_type", "owner_key"])


class ModelProvider:
    """Vectors by a function of a batch of texts, made once a worker by load(); batches are halved while they don't
    fit in memory, and stay so."""

    def __init__(self, load, batch: int = 32, dimension: int = 384):
        self.load, self.batch, self.dimension = load, batch, dimension

    def embed(self, texts: DataFrame) -> DataFrame:
        load, batch, dimension = self.load, self.batch, self.dimension

        @F.pandas_udf(ArrayType(FloatType()))  # type: ignore[call-overload]
        def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model, size = load(), batch
            for part in parts:
                rows, at = [], 0
                while at < len(part):
                    try:
                        found = np.asarray(model(part.iloc[at : at + size].tolist()), np.float32)
                    except MemoryError:
                        if size == 1:
                            raise
                        size //= 2
                        continue
                    if found.shape[1] != dimension:
                        raise ValueError(f"vectors have {found.shape[1]} numbers, not {dimension}")
                    rows += list(found)
                    at += size
                yield pd.Series(rows)

        return texts.select("owner_type", "owner_key", run("text").alias("vector"))


def mean_pooled(tokens: Column, mask: Column) -> Column:
    """The mean of the token vectors that the mask keeps, scaled to length 1; without any, null."""
    kept = F.filter(tokens, lambda t, i: F.get(mask, i) > 0)
    n = F.size(kept)
    zero = F.transform(F.get(tokens, 0), lambda x: F.lit(0.0))
    total = F.aggregate(kept, zero, lambda a, t: F.zip_with(a, t, lambda x, y: x + y.cast("double")))
    norm = F.sqrt(F.aggregate(total, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(n > 0, F.transform(total, lambda x: F.when(norm > 0, x / norm).otherwise(x)))
