"""Edges of source text: who calls, instantiates and returns what. Sites of calls come from the chunkers."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as sx
from .intervals import interval_join

#: Lines count as so many columns where spans are compared.
LINE_WIDTH = 100_000
IMPORT_KINDS = ("import_statement", "import_from_statement")
SITES = "file_path string, what string, s_line int, s_col int, e_line int, e_col int"


def sites(files: DataFrame, language: str) -> DataFrame:
    """files: relative_path, content. Callees, new expressions, decorators and returns of the files of a language."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from .. import chunkers

        found = {"python": chunkers.python_sites, "typescript": chunkers.brace_sites}[language]
        names = [x.split()[0] for x in SITES.split(", ")]
        kinds = [pa.string(), pa.string(), *[pa.int32()] * 4]
        for b in batches:
            for path, data in zip(b.column("relative_path").to_pylist(), b.column("content").to_pylist(), strict=True):
                rows = [(path, *s) for s in found(bytes(data or b""))] if chunkers.language_of(path) == language else []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return files.select("relative_path", "content").mapInArrow(run, SITES)


def python_sites(files: DataFrame) -> DataFrame:
    return sites(files, "python")


def _inside_site(occurrences: DataFrame, sites: DataFrame) -> DataFrame:
    """Occurrences, not definitions or imports, within sites of their file, by line and column."""
    occ = occurrences.where("symbol <> '' AND NOT is_definition AND NOT is_import")
    pairs = interval_join(occ, sites, ["file_path"], "start_line", "s_line", "e_line")
    start = sx.position(F.col("start_line"), F.col("start_col")) >= sx.position(F.col("s_line"), F.col("s_col"))
    end = sx.position(F.col("end_line"), F.col("end_col")) <= sx.position(F.col("e_line"), F.col("e_col"))
    return pairs.where(start & end)


def _around(sites: DataFrame, chunks: DataFrame) -> DataFrame:
    """sites with src_symbol, the primary symbol of the smallest chunk, not an import, that holds their lines."""
    spans = chunks.where("primary_symbol <> ''").where(~F.col("kind").isin(*IMPORT_KINDS))
    spans = spans.select("file_path", "chunk_key", "primary_symbol", F.col("start_line").alias("c_start"), F.col("end_line").alias("c_end"))
    pairs = interval_join(sites, spans, ["file_path"], "s_line", "c_start", "c_end").where("e_line <= c_end")
    key = ["file_path", "what", "s_line", "s_col", "e_line", "e_col"]
    return pairs.groupBy(*key).agg(F.min_by("primary_symbol", F.struct(F.col("c_end") - F.col("c_start"), "c_start", "chunk_key")).alias("src_symbol"))


def call_edges(sites: DataFrame, occurrences: DataFrame, chunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """src_symbol, dst_symbol, kind: calls and instantiates by the smallest occurrence in the callee, or anywhere in
    a new expression, returns by every one read in a return statement; each once."""
    key = ["file_path", "what", "s_line", "s_col", "e_line", "e_col"]
    around = _around(sites, chunks)
    inside = _inside_site(occurrences, sites)
    span = (F.col("end_line") - F.col("start_line")) * LINE_WIDTH + F.col("end_col") - F.col("start_col")
    callee = inside.where("what IN ('call', 'decorator', 'new')").groupBy(*key).agg(F.min_by("symbol", F.struct(span, "start_line", "start_col")).alias("dst_symbol"))
    classes = symbols.where("kind = 'class'").select(F.col("scip_symbol").alias("dst_symbol"), F.lit(True).alias("is_class")).distinct()
    calls = callee.join(classes, "dst_symbol", "left").withColumn("kind", F.when(F.col("is_class") | (F.col("what") == "new"), "instantiates").otherwise("calls")).drop("is_class")
    returned = inside.where("what = 'return' AND is_read").select(*key, F.col("symbol").alias("dst_symbol"), F.lit("returns").alias("kind"))
    both = calls.select(*key, "dst_symbol", "kind").unionByName(returned)
    return both.join(around, key).select("src_symbol", "dst_symbol", "kind").distinct()
