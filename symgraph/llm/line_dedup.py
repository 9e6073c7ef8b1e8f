"""Line dedup: lines that many documents share stay in one of them only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, ascii_lower, hash_pair, let, rekeyed, rows_of, written

MIN_DOCS = 3
MIN_CHARS = 20


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def shared_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> tuple[DataFrame, DataFrame]:
    """The long lines (doc_id, th, pos, h1, h2) and the shared keys (h1, h2, holder, n_docs).

    A key's documents are counted after one row a key and document is left, both times with
    partial sums on the map side, so a line of a third of all documents is no hot task.
    """
    lines = rows_of(docs).select("doc_id", "th", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.select("doc_id", "th", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    h1, h2 = hash_pair(F.col("key"))
    lines = lines.select("doc_id", "th", "pos", h1.alias("h1"), h2.alias("h2"))
    shared = (
        lines.select("h1", "h2", "doc_id").distinct()
        .groupBy("h1", "h2").agg(F.max("doc_id").alias("holder"), F.count(F.lit(1)).alias("n_docs"))
        .where(F.col("n_docs") >= min_docs)
    )
    return lines, shared


def dropped_positions(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, th and the sorted positions of the lines that go; only rows that lose a line."""
    lines, shared = shared_lines(docs, min_docs, min_chars)
    left = lines.withColumns({"j1": rekeyed(F.col("h1")), "j2": rekeyed(F.col("h2"))}).drop("h1", "h2")
    right = shared.select(rekeyed(F.col("h1")).alias("j1"), rekeyed(F.col("h2")).alias("j2"), "holder")
    gone = left.join(right, ["j1", "j2"]).where(~F.col("doc_id").eqNullSafe(F.col("holder")))
    return gone.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("pos")).alias("gone"))


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, more: tuple[str, ...] = ()) -> DataFrame:
    """A row a document: doc_id, the columns more, n_lines, n_dropped, kept (the text that is left).

    A text is split at ``\\n``; null and empty ones are one empty line. A line's key is the line
    stripped of ASCII white space with A-Z lower-cased. A key of at least min_chars code points
    in at least min_docs documents (by doc_id; a null doc_id is one document, and holds a key
    only if no other does) loses all lines but those of its largest doc_id, where repeats stay.
    Rows that repeat a doc_id are one document, each row losing its own lines. No rows: no rows.
    """
    # Written, so that its size is known: while it is small, texts need no shuffle to meet it.
    gone = written(dropped_positions(docs, min_docs, min_chars).select(F.col("doc_id").alias("g_id"), F.col("th").alias("g_th"), "gone"), "gone")
    rows = rows_of(docs, *more)
    both = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("th") == F.col("g_th")), "left")

    def left_over(lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
        return F.array_join(F.transform(kept, lambda p: F.get(lines, p)), "\n")

    lines = F.split("text", "\n")
    return both.select(
        "doc_id",
        *more,
        F.size(lines).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(let(lines, left_over)).alias("kept"),
    )


def query(docs: DataFrame) -> DataFrame:
    out = dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
