"""An index in a store, built once table after table, and read by searches."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as fx
from ..sources.corpus import Corpus
from . import derive
from .tables import Store

#: What symbols of a corpus begin with.
CORPUS_SYMBOL = "txt "
CORPUS_ADAPTER = "text"


class StoredIndex:
    """The tables of a root in a store, of all adapters or one, as one snapshot; searches see it unchanged."""

    def __init__(self, store: Store, root: str, adapter: str | None = None):
        self.store, self.root = store, root
        self.spark = store.spark
        self.snapshot = [r for r in store.manifest() if r[1] == root and adapter in (None, r[2])]

    def table(self, name: str) -> DataFrame:
        return self.store.table(name, self.snapshot)

    @staticmethod
    def _abs_path(file_path) -> F.Column:
        return F.when(F.col(file_path).startswith("/"), F.col(file_path)).otherwise(F.concat("root_path", F.lit("/"), F.col(file_path)))

    @cached_property
    def symbols(self) -> DataFrame:
        return self.table("symbols").select(
            "root_path", "scip_symbol", "display_name", "kind", self._abs_path("file_path").alias("abs_path"), "file_path", F.col("def_start_line").alias("def_line"),
            F.col("def_end_line").alias("def_end_line"), F.col("def_start_col").alias("def_col"), "signature", "doc_summary",
        )

    @cached_property
    def chunks(self) -> DataFrame:
        return self.table("chunks").withColumn("abs_path", self._abs_path("file_path"))

    @property
    def plain_chunks(self) -> DataFrame:
        return self.chunks.drop("text", "retrieval_text")

    @cached_property
    def occurrences(self) -> DataFrame:
        return self.table("occurrences").withColumns({"abs_path": self._abs_path("file_path"), "line": F.col("start_line"), "col": F.col("start_col")})

    @property
    def links(self) -> DataFrame:
        return self.table("chunk_symbols")

    @property
    def edges(self) -> DataFrame:
        return self.table("edges")

    @property
    def vectors(self) -> DataFrame:
        return self.table("embeddings").select("owner_type", "owner_key", "vector")

    @cached_property
    def has_vectors(self) -> bool:
        return not self.vectors.limit(1).isEmpty()


def _named(symbol: str):
    return F.concat(F.lit(CORPUS_SYMBOL), F.col(symbol))


def _bare(symbol: str):
    return F.substring(F.col(symbol), len(CORPUS_SYMBOL) + 1, 1 << 30)


def store_corpus(corpus: Corpus, store: Store, root: str, adapter: str = CORPUS_ADAPTER, with_vectors: bool = True) -> None:
    """All tables of a corpus into a store, in one published version. Each is written once, and what is derived
    from it reads what was written: definitions, then occurrences, chunks, links and edges."""
    stage = lambda name, rows: store.stage(name, root, adapter, rows)
    doc_id = F.regexp_extract("file_path", r"d(-?\d+)\.txt$", 1).cast("long").alias("doc_id")
    symbols = corpus.symbols.select("scip_symbol", "display_name", "kind", F.col("abs_path").alias("file_path"), F.col("def_line").alias("def_start_line"), F.col("def_col").alias("def_start_col"), F.col("def_line").alias("def_end_line"), F.col("def_col").alias("def_end_col"), "signature", "doc_summary")
    symbols, found = stage("symbols", symbols)
    corpus.definitions = found.select(F.lit(root).alias("root_path"), F.col("display_name").alias("symbol"), doc_id, F.col("def_start_line").alias("line"), F.col("def_start_col").alias("col"))
    path = F.concat("root_path", F.lit("/d"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_path")
    flags = ("is_definition", "is_import", "is_write", "is_read")
    occurrences = corpus.occurrences.select(path, _named("symbol").alias("symbol"), F.col("line").alias("start_line"), F.col("col").alias("start_col"), F.col("line").alias("end_line"), F.col("col").alias("end_col"), "syntax_kind", *flags)
    occurrences, found = stage("occurrences", occurrences)
    corpus.occurrences = found.select(doc_id, "root_path", F.col("start_line").alias("line"), F.col("start_col").alias("col"), _bare("symbol").alias("symbol"), *flags, "syntax_kind")
    index = derive.Index(corpus)
    chunks, found = stage("chunks", index.chunks.withColumnsRenamed({"abs_path": "file_path"}).withColumn("primary_symbol", _named("primary_symbol")))
    plain = found.select(doc_id, "root_path", F.col("file_path").alias("abs_path"), "kind", "start_line", "end_line", "chunk_key", "name", _bare("primary_symbol").alias("primary_symbol"))
    links = derive.chunk_symbol_links(plain, corpus.occurrences).withColumn("symbol", _named("symbol"))
    edges = derive.occurrence_edges(plain, corpus.occurrences).unionByName(derive.contains_edges(plain)).withColumn("provenance", F.lit("hybrid"))
    edges = edges.unionByName(derive.reference_edges(corpus.symbols).withColumn("provenance", F.lit("scip")))
    edges = edges.withColumns({"src_symbol": _named("src_symbol"), "dst_symbol": _named("dst_symbol")})
    files = corpus.files.select(F.col("abs_path").alias("relative_path"), "abs_path", "language", fx.content_hash(F.col("text")).alias("content_hash"), fx.line_count(F.col("text")).alias("line_count"))
    project = store.spark.createDataFrame([(root, adapter)], "name string, language string")
    payload = {"projects": project, "files": files, "symbols": symbols, "occurrences": occurrences, "chunks": chunks, "chunk_symbols": links, "edges": edges}
    if with_vectors:
        modules = plain.where("kind = 'module'").select(F.col("doc_id").alias("vec_id"), F.col("chunk_key").alias("owner_key"))
        vectors = corpus.vectors.join(modules, "vec_id").select(F.lit("chunk").alias("owner_type"), "owner_key", F.lit("table").alias("model"), F.col("embedding").alias("vector"))
        payload["embeddings"] = vectors
    store.replace(root, adapter, payload)
