"""Pieces that several corpus operators share.

Conventions of all operators in this package: a word is ``[^\\x20\\x09-\\x0D]+``; a null text
counts as an empty one; only the columns an operator names are read, so further columns of
any name pass by; rows that repeat are kept as often as they came in.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import removed, shared_dir

#: ASCII white space, as characters, as a Java regex class and a word's regex.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

_written: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def new_path(spark: SparkSession, name: str) -> str:
    """A new folder's path under the shared one, removed when Python ends, or before by discard()."""
    path = f"{shared_dir(spark)}/symgraph-{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(discard)
    _written[path] = spark
    return path


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, outlives any executor."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Removes written() tables that nothing reads any more; without any named, all that were written, of
    results too. For a long session, after a result has been saved or shown."""
    files = {f.rpartition("/")[0] for t in tables for f in t.inputFiles()}
    for path, spark in list(_written.items()):
        own = path.partition(":")[2].lstrip("/")
        if tables and not any(f.partition(":")[2].lstrip("/") == own for f in files):
            continue
        if spark.sparkContext._jsc is not None:  # else the session has ended before: its folder is the cluster's to clean
            removed(spark, path)
        del _written[path]


def let(value: Column, use) -> Column:
    """use(value) with value computed once, however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased only. lower() does that alone where all bytes are ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def hash_pair(*cols: Column) -> list[Column]:
    """Two 64-bit hashes with different seeds: 128 bits, so that no two lines of 100 TB are taken for one."""
    return [F.xxhash64(*cols), F.xxhash64(F.lit("second"), *cols)]


def rekeyed(h: Column) -> Column:
    """h under another name for the optimizer: a join on it deals both sides out anew, and the
    adaptive planner may split what is skewed. A join on an aggregate's own key could not be split."""
    return h.bitwiseXOR(F.lit(0x5DEECE66D))


def sorted_in(df: DataFrame) -> DataFrame:
    """df as one side of a join that both sides are dealt out and sorted for, whatever their estimated size. To Spark, what
    an explode makes is as small as what it was made of, so that it might collect millions of rows in the driver to broadcast."""
    return df.hint("merge")


def rows_of(df: DataFrame, *more: str) -> DataFrame:
    """doc_id, more, text (null: empty) and th; (doc_id, th) names a row, equal rows alike."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return df.select("doc_id", *more, text.alias("text"), F.xxhash64(text).alias("th"))
