"""A document corpus as a source tree: files, chunks, symbols and occurrences.

Documents are files of the project (/corpus/<source>, <lang>-text). A file's chunks are the whole text
(module), runs of five lines (block) and lines. Words are symbols; a symbol is defined where it first stands
in its project, and other occurrences import, write, read or use it by their line and column.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring as sx
from ..functions import text as fx

BLOCK_LINES = 5
#: Shared ids up to which they are sent to the texts; above, texts and ids are sorted and merged.
FEW_IDS = 10_000
KINDS = ("function", "method", "class", "interface", "type", "variable", "module")


def root_of(source: str) -> str:
    return f"/corpus/{source}"


@dataclass
class Corpus:
    """The model's tables over documents, lazily. source restricts all of them to one project root, which
    reaches the scan as a filter."""

    spark: SparkSession
    sf_dir: str
    source: str | None = None

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def documents(self) -> DataFrame:
        docs = self.table("documents")
        return docs if self.source is None else docs.where(F.col("source") == self.source)

    @cached_property
    def files(self) -> DataFrame:
        root = F.concat(F.lit("/corpus/"), F.col("source"))
        path = F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".txt"))
        return self.documents.select(
            "doc_id", root.alias("root_path"), F.concat("lang", F.lit("-text")).alias("adapter_id"), path.alias("relative_path"),
            F.concat(root, F.lit("/"), path).alias("abs_path"), F.col("lang").alias("language"), "text",
        )

    @cached_property
    def lines(self) -> DataFrame:
        split = F.posexplode(F.split("text", "\n")).alias("line", "line_text")
        return self.files.select("doc_id", "root_path", "adapter_id", "abs_path", split)

    @cached_property
    def words(self) -> DataFrame:
        """A row a word: doc_id, root_path, line, col, symbol."""
        split = F.posexplode(F.split("line_text", " ")).alias("col", "word")
        out = self.lines.select("doc_id", "root_path", "line", split)
        out = out.select("doc_id", "root_path", "line", "col", self.symbol_of(F.col("word")).alias("symbol"))
        return out.where(F.octet_length("symbol") >= fx.MIN_TERM_BYTES)

    @staticmethod
    def symbol_of(word: Column) -> Column:
        return F.lower(F.btrim(word, F.lit(fx.TERM_EDGES)))

    @cached_property
    def definitions(self) -> DataFrame:
        """A row a symbol and root: where it first stands. Partial minima, so common words are no hot task; of
        document, line and column in one number, so that they are found by hashing, without sorting the words."""
        document = F.lit(sx.PLACE_COLS * sx.PLACE_COLS).cast("decimal(19,0)")
        at = F.col("doc_id").cast("decimal(19,0)") * document + sx.place(F.col("line"), F.col("col")).cast("decimal(19,0)")
        out = self.words.groupBy("root_path", "symbol").agg(F.min(at.cast("decimal(38,0)")).alias("d"))
        out = out.withColumn("doc_id", F.expr(f"d div {sx.PLACE_COLS * sx.PLACE_COLS}")).withColumn("at", (F.col("d") % document).cast("long"))
        return out.select("root_path", "symbol", "doc_id", F.shiftright("at", 31).cast("int").alias("line"), F.col("at").bitwiseAND(F.lit(sx.PLACE_COLS - 1)).cast("int").alias("col"))

    @cached_property
    def symbols(self) -> DataFrame:
        kind = F.get(F.lit(list(KINDS)), (F.char_length("symbol") % len(KINDS)).cast("int"))
        path = F.concat("root_path", F.lit("/d"), F.col("doc_id").cast("string"), F.lit(".txt"))
        return self.definitions.select(
            "root_path", F.concat(F.lit("txt "), "symbol").alias("scip_symbol"), F.col("symbol").alias("display_name"), kind.alias("kind"),
            path.alias("abs_path"), "doc_id", F.col("line").alias("def_line"), F.col("col").alias("def_col"),
            F.concat("symbol", F.lit("()")).alias("signature"), F.lit("").alias("doc_summary"),
        )

    @cached_property
    def occurrences(self) -> DataFrame:
        """words with is_definition, is_import, is_write, is_read and syntax_kind. Definitions meet the lines, of which
        there are far fewer than words."""
        defs = self.definitions.groupBy(F.col("doc_id").alias("d"), F.col("line").alias("l")).agg(F.collect_list("col").alias("defs"))
        lines = self.lines.select("doc_id", "root_path", "line", "line_text")
        lines = lines.join(defs, (F.col("doc_id") == F.col("d")) & (F.col("line") == F.col("l")), "left")
        words = lines.select("doc_id", "root_path", "line", "defs", F.posexplode(F.split("line_text", " ")).alias("col", "word"))
        here = words.withColumn("symbol", self.symbol_of(F.col("word"))).where(F.octet_length("symbol") >= fx.MIN_TERM_BYTES)
        out = here.withColumn("is_definition", F.coalesce(F.array_contains("defs", F.col("col")), F.lit(False)))
        return out.select("doc_id", "root_path", "line", "col", "symbol", "is_definition", *self.flags_of(F.col("is_definition"), F.col("line"), F.col("col")))

    @staticmethod
    def flags_of(is_definition: Column, line: Column, col: Column) -> list[Column]:
        """is_import, is_write, is_read and syntax_kind of an occurrence."""
        other = ~is_definition & (line > 0)
        return [
            (~is_definition & (line == 0)).alias("is_import"), (other & (col % 3 == 0)).alias("is_write"), (other & (col % 3 == 1)).alias("is_read"),
            F.when(col % 2 == 0, "identifier").otherwise("").alias("syntax_kind"),
        ]

    @cached_property
    def ids_repeat(self) -> int:
        """How many ids documents share, which their ids alone tell. The chunks of such documents are those of one file."""
        ids = self.documents.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
        return ids.where("n > 1").count()

    @cached_property
    def placed_words(self) -> DataFrame:
        """words of documents that have an id, with the place that spans_held() takes: the number of lines of their document
        or, where ids repeat, which chunks of all documents of the id hold the line, of which there is one an end."""
        files = self.files.where("doc_id IS NOT NULL AND text IS NOT NULL")
        lines = files.select("doc_id", "root_path", F.split("text", "\n").alias("lines")).withColumn("n_lines", F.size("lines"))
        if self.ids_repeat:
            sizes = lines.groupBy("doc_id").agg(F.collect_set("n_lines").alias("sizes")).where(F.size("sizes") > 1)
            lines = lines.join(F.broadcast(sizes) if self.ids_repeat <= FEW_IDS else sizes, "doc_id", "left").withColumn("n_lines", F.coalesce("sizes", F.array("n_lines")))
        lines = lines.select("doc_id", "root_path", "n_lines", F.posexplode("lines").alias("line", "line_text"))
        place = self._place(F.col("line"), F.col("n_lines")) if self.ids_repeat else F.col("n_lines")
        lines = lines.select("doc_id", "root_path", "line", "line_text", place.alias("place"))
        out = lines.select("doc_id", "root_path", "place", "line", F.posexplode(F.split("line_text", " ")).alias("col", "word"))
        out = out.withColumn("symbol", self.symbol_of(F.col("word"))).drop("word")
        return out.where(F.octet_length("symbol") >= fx.MIN_TERM_BYTES)

    def _place(self, line: Column, sizes: Column) -> Column:
        """How many modules and blocks of the documents of these sizes hold a line, and the end of the first by key, in
        one number: 31 bits of the module's end, three of the lines of a block ahead of its end, three and 26 of how many."""
        ends = F.transform(F.filter(sizes, lambda n: n > line), lambda n: n - 1)
        start = line - line % BLOCK_LINES
        blocks = F.array_distinct(F.transform(ends, lambda end: F.least(end, start + (BLOCK_LINES - 1))))
        first = lambda of: F.substring_index(F.array_min(F.transform(of, lambda end: F.concat(end.cast("string"), F.lit(":")))), ":", 1).cast("long")
        many = F.shiftleft(F.size(blocks).cast("long"), 34).bitwiseOR(F.shiftleft(F.size(ends).cast("long"), 37))
        return first(ends).bitwiseOR(F.shiftleft(first(blocks) - start, 31)).bitwiseOR(many)

    @staticmethod
    def spans_at(line: Column, n_lines: Column) -> dict[str, tuple[Column, Column]]:
        """By kind, the first and last line of the chunk that holds a line: those of _pieces()."""
        block = line - line % BLOCK_LINES
        return {"module": (F.lit(0), n_lines - 1), "block": (block, F.least(block + (BLOCK_LINES - 1), n_lines - 1)), "line": (line, line)}

    def spans_held(self, line: Column) -> dict[str, tuple[Column, Column, Column]]:
        """By kind, the first and last line of the chunk that holds a line of placed_words, of several the first by key,
        and how many do; several begin on the same line."""
        place = F.col("place")
        if not self.ids_repeat:
            return {kind: (*span, F.lit(1)) for kind, span in self.spans_at(line, place).items()}
        bits = lambda at, n: F.shiftright(place, at).bitwiseAND(F.lit((1 << n) - 1)).cast("int")
        block = line - line % BLOCK_LINES
        return {"module": (F.lit(0), bits(0, 31), bits(37, 26)), "block": (block, block + bits(31, 3), bits(34, 3)), "line": (line, line, F.lit(1))}

    def _pieces(self, with_text: bool) -> DataFrame:
        """Chunks, made from the lines within a document's row: only its own text goes on with a chunk."""
        size = F.size("lines")
        piece = lambda kind, start, end, text: F.struct(F.lit(kind).alias("kind"), start.cast("int").alias("start_line"), end.cast("int").alias("end_line"), text.alias("text"))
        until = lambda b: F.least(b * BLOCK_LINES + BLOCK_LINES, size)
        joined = lambda b: F.array_join(F.slice("lines", b * BLOCK_LINES + 1, F.lit(BLOCK_LINES)), "\n")
        head = lambda b: F.get("lines", b * BLOCK_LINES)
        module = F.array(piece("module", F.lit(0), size - 1, F.col("text") if with_text else F.get("lines", F.lit(0))))
        numbers = F.sequence(F.lit(0), F.floor((size - 1) / BLOCK_LINES).cast("int"))
        blocks = F.transform(numbers, lambda b: piece("block", b * BLOCK_LINES, until(b) - 1, joined(b) if with_text else head(b)))
        each = F.transform("lines", lambda x, k: piece("line", k, k, x))
        files = self.files.select("doc_id", "root_path", "abs_path", "text", F.split("text", "\n").alias("lines"))
        out = files.select("doc_id", "root_path", "abs_path", F.explode(F.concat(module, blocks, each)).alias("c"))
        path = F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".txt"))
        key = fx.chunk_key(path, F.col("c.start_line"), F.col("c.end_line"), F.col("c.kind")).alias("chunk_key")
        return out.select("doc_id", "root_path", "abs_path", "c.kind", "c.start_line", "c.end_line", key, F.col("c.text").alias("text"))

    @cached_property
    def chunks(self) -> DataFrame:
        """Modules, blocks and lines: doc_id, root_path, abs_path, kind, start_line, end_line, chunk_key, name."""
        return self._named(self._pieces(False)).drop("text")

    @cached_property
    def chunk_texts(self) -> DataFrame:
        """chunks with text and header_text."""
        return self._named(self._pieces(True)).withColumn("header_text", F.substring_index("text", "\n", 1))

    def _named(self, pieces: DataFrame) -> DataFrame:
        """The name is the first line's first word."""
        first = F.substring_index(F.substring_index("text", "\n", 1), " ", 1)
        return pieces.withColumn("name", self.symbol_of(first))

    @cached_property
    def vectors(self) -> DataFrame:
        """vec_id, embedding and label; a vector belongs to the module chunk of the document of its number."""
        return self.table("embeddings")
