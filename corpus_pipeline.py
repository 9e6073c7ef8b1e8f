"""The corpus pipeline over documents: five stages, each written and read again by the next.

In all stages a null text counts as an empty one, columns other than those of documents pass by unread, and no rows give
no rows. Rows that repeat are kept by the first two stages, made one by the third, and are documents of their own
in the last two. Rows without doc_id are documents like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symgraph.llm import line_dedup, mixing, packing, quality_classifier, simhash
from symgraph.llm.common import DOCUMENT_COLUMNS, documents, sorted_in, table, written


def _typed(docs: DataFrame) -> DataFrame:
    """The columns of documents alone, whatever else a table has."""
    kinds = {"doc_id": "long", "n_chars": "long"}
    return docs.select(*(F.col(c).cast(kinds.get(c, "string")) for c in DOCUMENT_COLUMNS))


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject: those that score 0.3 or more. Empty texts have the score
    of the bias alone. Labels of the held-out fold aren't learnt from."""
    return quality_classifier.accepted(_typed(docs), table(spark, sf_dir, "labels"), DOCUMENT_COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stay in another; one of which nothing is left goes if it lost a line. Empty
    texts stay. A null doc_id counts as one document, and holds a line only if no other does."""
    out = line_dedup.dedup_lines(_typed(docs), more=("lang", "source"))
    out = out.where((F.col("n_dropped") == 0) | (F.btrim("kept") != ""))
    out = out.withColumn("text", F.col("kept")).withColumn("n_chars", F.char_length("kept").cast("long"))
    return out.select(*DOCUMENT_COLUMNS)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least doc_id, one row of those that repeat it.

    Rows of one doc_id with different texts are documents of their own. Rows without doc_id come after
    those that have one; those of a fingerprint that no other row has are a group, of which one stays.
    """
    docs = _typed(docs).withColumn("th", F.xxhash64(F.coalesce("text", F.lit(""))))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    first = simhash.near_duplicates(docs).groupBy("root").agg(F.min(order).alias("o"))
    first = written(first.select(F.col("o.doc_id").alias("f_id"), F.col("o.th").alias("f_th")), "first")
    kept = docs.join(sorted_in(first), F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("th") == F.col("f_th")), "left_semi")
    return kept.dropDuplicates(["doc_id", "th"]).select(*DOCUMENT_COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the words that the mix takes of them, as often as it does. Those without a word go; null
    sources are a source."""
    return mixing.mixed_documents(_typed(docs), DOCUMENT_COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens in sequences. An empty text is its end's id alone."""
    return packing.query(_typed(docs))


STAGES = [
    ("quality classifier", classify),
    ("line dedup", dedup_lines),
    ("SimHash near-dedup", dedup_near),
    ("mixing sources", mix_sources),
    ("packing", pack),
]

#: The classifier, the fingerprints and the tokenizer aren't SQL; the tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each one's result written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k}")
    return docs
