"""The index of a source tree: symbol indexes, and chunks of the files, joined by line and column."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..adapters import Adapter
from ..chunkers import chunk_files
from ..functions import scoring as sx
from ..functions import text as fx
from ..sources import scip
from . import call_edges, derive
from .embedding import NoProvider, Provider
from .intervals import interval_join
from .tables import Store

FLAGS = ("is_definition", "is_import", "is_write", "is_read")
#: Lines count as so many columns where widths are compared.
LINE_WIDTH = 100_000


def _at(prefix: str) -> Column:
    return sx.place(F.col(f"{prefix}_line"), F.col(f"{prefix}_col"))


def contained(points: DataFrame, chunks: DataFrame, prefix: str = "") -> DataFrame:
    """Pairs of a point and a chunk of its file of which the lines and columns hold the point's range, which is
    in the columns <prefix>start_line and so on. The chunk's columns begin with c_."""
    spans = chunks.select(*(F.col(c).alias(c if c == "file_path" else f"c_{c}") for c in chunks.columns))
    pairs = interval_join(points, spans, ["file_path"], f"{prefix}start_line", "c_start_line", "c_end_line")
    return pairs.where((_at(f"{prefix}start") >= _at("c_start")) & (_at(f"{prefix}end") <= _at("c_end")))


def primary_symbols(chunks: DataFrame, occurrences: DataFrame, symbols: DataFrame) -> DataFrame:
    """chunk_key and primary_symbol: of the definitions within a chunk's lines the first of its name, else that
    of the fewest lines, of equal ones the first."""
    names = symbols.select(F.col("scip_symbol").alias("symbol"), "display_name")
    defs = occurrences.where("is_definition").join(names, "symbol")
    defs = defs.select("file_path", "symbol", "display_name", "enclosing_start_line", "enclosing_end_line", F.struct("doc_ord", "occ_ord").alias("nr"))
    spans = chunks.select("file_path", "chunk_key", "name", F.col("start_line").alias("c_start"), F.col("end_line").alias("c_end"))
    pairs = interval_join(defs, spans, ["file_path"], "enclosing_start_line", "c_start", "c_end").where("enclosing_end_line <= c_end")
    named = (F.col("name") != "") & (F.col("display_name") == F.col("name"))
    lines = F.when(named, -1).otherwise(F.col("enclosing_end_line") - F.col("enclosing_start_line"))
    return pairs.groupBy("chunk_key").agg(F.min_by("symbol", F.struct(lines.alias("lines"), "nr")).alias("primary_symbol"))


def chunk_symbol_links(chunks: DataFrame, occurrences: DataFrame) -> DataFrame:
    """chunk_key, symbol, role, weight, each once: what a chunk is of, and the roles of the occurrences in it."""
    spans = chunks.select("file_path", "chunk_key", "start_line", "start_col", "end_line", "end_col")
    pairs = contained(occurrences.where("symbol <> ''"), spans)
    roles = derive.roles(*(F.col(f) for f in FLAGS), F.col("syntax_kind"))
    links = pairs.select(F.col("c_chunk_key").alias("chunk_key"), "symbol", F.explode(roles).alias("role"))
    own = chunks.where("primary_symbol <> ''").select("chunk_key", F.col("primary_symbol").alias("symbol"), F.lit("defines").alias("role"))
    return own.unionByName(links).distinct().withColumn("weight", sx.looked_up(F.col("role"), sx.LINK_WEIGHTS, 0.0))


def occurrence_edges(chunks: DataFrame, occurrences: DataFrame, ignored: tuple[str, ...]) -> DataFrame:
    """src_symbol, dst_symbol, kind: what modules import, and what the chunk around an occurrence's enclosing range
    defines, writes, reads or uses. Around it is the narrowest chunk, of equal ones the first, not of an ignored kind."""
    occ = occurrences.where("symbol <> ''").withColumn("occ", F.struct("file_path", "doc_ord", "occ_ord"))
    modules = chunks.where("kind = 'module' AND primary_symbol <> ''").select("file_path", F.col("primary_symbol").alias("src_symbol"))
    imports = occ.where("is_import").join(modules, "file_path").select("src_symbol", F.col("symbol").alias("dst_symbol"), F.lit("imports").alias("kind"))
    spans = chunks.where("primary_symbol <> ''").where(~F.col("kind").isin(*ignored))
    spans = spans.select("file_path", "chunk_key", "primary_symbol", "start_byte", "end_byte", "start_line", "start_col", "end_line", "end_col")
    width = (F.col("c_end_line") - F.col("c_start_line")) * LINE_WIDTH + F.col("c_end_col") - F.col("c_start_col")
    order = F.struct(width.alias("w"), "c_start_byte", -F.col("c_end_byte"), "c_chunk_key")
    around = contained(occ, spans, "enclosing_").groupBy("occ").agg(F.min_by("c_primary_symbol", order).alias("src_symbol"))
    inner = occ.join(around, "occ").where("src_symbol <> symbol")
    none = ~(F.col("is_definition") | F.col("is_import") | F.col("is_read") | F.col("is_write"))
    kinds = {"defines": F.col("is_definition") & ~F.col("is_import"), "writes": F.col("is_write"), "reads": F.col("is_read"), "uses": none}
    others = inner.select("src_symbol", F.col("symbol").alias("dst_symbol"), F.explode(F.array_compact(F.array(*(F.when(t, k) for k, t in kinds.items())))).alias("kind"))
    return imports.unionByName(others).distinct()


def _listed(rows: DataFrame, by: str, name: str, order: list, most: int | None = None) -> DataFrame:
    """by and an array of the distinct names in order, `most` of them at most."""
    first = rows.groupBy(by, name).agg(F.min(F.struct(*order)).alias("o"))
    first = first.withColumn("nr", F.row_number().over(Window.partitionBy(by).orderBy("o", name)))
    first = first if most is None else first.where(F.col("nr") <= most)
    return first.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct("nr", name))), lambda s: s[name]).alias("names"))


def retrieval_texts(chunks: DataFrame, symbols: DataFrame, occurrences: DataFrame, edges: DataFrame) -> DataFrame:
    """chunk_key and retrieval_text: who a chunk is, its signature, what it stands in, implements and is typed by, its
    documentation, the first 15 names it refers to, and its text."""
    named = symbols.where("display_name <> ''").select("scip_symbol", "display_name")
    spans = chunks.select("file_path", "chunk_key", "start_line", "start_col", "end_line", "end_col")
    roles = derive.roles(*(F.col(f) for f in FLAGS), F.col("syntax_kind"))
    refs = contained(occurrences.where("symbol <> ''").where(F.exists(roles, lambda r: r != "defines")), spans)
    refs = refs.join(named, F.col("symbol") == F.col("scip_symbol"), "left")
    refs = refs.select(F.col("c_chunk_key").alias("chunk_key"), F.coalesce("display_name", "symbol").alias("name"), "start_line", "start_col")
    uses = _listed(refs, "chunk_key", "name", ["start_line", "start_col"], 15).withColumnRenamed("names", "uses")
    related = edges.where("kind IN ('implementation', 'type_definition')").join(named, F.col("dst_symbol") == F.col("scip_symbol"))
    lists = [
        _listed(related.where(F.col("kind") == kind).select("src_symbol", "display_name"), "src_symbol", "display_name", ["display_name"])
        .select(F.col("src_symbol").alias("scip_symbol"), F.col("names").alias(name))
        for kind, name in (("implementation", "impls"), ("type_definition", "typed"))
    ]
    parents = named.select(F.col("scip_symbol").alias("enclosing_symbol"), F.col("display_name").alias("inside"))
    about = symbols.join(parents, "enclosing_symbol", "left")
    for names in lists:
        about = about.join(names, "scip_symbol", "left")
    about = about.select(F.col("scip_symbol").alias("primary_symbol"), "display_name", "signature", "doc_summary", "inside", "impls", "typed")
    rows = chunks.join(about, "primary_symbol", "left").join(uses, "chunk_key", "left")
    part = lambda before, value, after: F.when(value != "", F.concat(F.lit(before), value, F.lit(after))).otherwise("")
    joined = lambda c: F.coalesce(F.array_join(c, ", "), F.lit(""))
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    name = F.when(empty("display_name") != "", F.col("display_name")).otherwise(F.col("name"))
    text = F.concat(
        derive.preamble(name, F.col("kind"), F.col("file_path")), part(" Signature: ", empty("signature"), "."), part(" Defined inside ", empty("inside"), "."),
        part(" Implements ", joined("impls"), "."), part(" Type defined by ", joined("typed"), "."), part(" ", fx.strip_code_fences(empty("doc_summary")), ""),
        part(" Uses ", joined("uses"), "."), F.lit("\n\n"), F.col("text"),
    )
    return rows.select("chunk_key", text.alias("retrieval_text"))


@dataclass
class Source:
    """What a unit's index is built from: documents of its symbol index and files with their content. unchanged
    and cached_* come from an index of before; see reindex()."""

    root: str
    adapter: Adapter
    documents: DataFrame
    files: DataFrame
    provider: Provider = field(default_factory=NoProvider)
    model: str = "none"
    project: dict = field(default_factory=dict)
    unchanged: DataFrame | None = None
    cached_chunks: DataFrame | None = None
    cached_vectors: DataFrame | None = None


def build(store: Store, source: Source) -> None:
    """Writes all tables of a unit into a store, in one version. A document whose file is not there is an error; one
    of which the path leaves the root is left out."""
    spark, root, adapter = store.spark, source.root, source.adapter
    stage = lambda name, rows: store.stage(name, root, adapter.id, rows)
    path = fx.clean_path(F.col("relative_path"))
    docs = source.documents.withColumn("relative_path", F.when(F.col("is_external"), "").otherwise(path))
    docs = docs.where(F.col("is_external") | (fx.inside_root(F.col("relative_path")) & ~F.col("relative_path").isin("", "."))).persist()
    paths = docs.where("NOT is_external").groupBy("relative_path").agg(F.first("language").alias("language"))
    gone = paths.join(source.files, "relative_path", "left_anti").select("relative_path").take(3)
    if gone:
        raise FileNotFoundError(f"the index names files that aren't there: {', '.join(r[0] for r in gone)}")
    files = source.files.join(paths, "relative_path").select(
        "relative_path", F.concat(F.lit(root + "/"), "relative_path").alias("abs_path"), F.lit(adapter.language).alias("language"), F.sha2("content", 256).alias("content_hash"),
        fx.line_count(F.decode("content", "UTF-8")).alias("line_count"), "content",
    )
    occurrences = scip.occurrences(docs).where("symbol <> ''")
    symbols = scip.located(scip.symbols(docs, adapter.display_name), scip.occurrences(docs), adapter.display_name)
    symbols_entry, symbols = stage("symbols", symbols)
    # The order of occurrences isn't stored; it only decides between definitions of one name and width.
    changed = files if source.unchanged is None else files.join(source.unchanged, "relative_path", "left_anti")
    pieces = chunk_files(changed)
    if source.cached_chunks is not None and source.unchanged is not None:
        old = source.cached_chunks.join(source.unchanged.select(F.col("relative_path").alias("file_path")), "file_path", "left_semi")
        pieces = pieces.unionByName(old.select(*pieces.columns))
    pieces = pieces.persist()
    chunks = pieces.join(derive.parents(pieces, "file_path"), "chunk_key", "left").join(primary_symbols(pieces, occurrences, symbols), "chunk_key", "left").persist()
    links_entry, links = stage("chunk_symbols", chunk_symbol_links(chunks, occurrences))
    scip_edges = scip.relationship_edges(docs).unionByName(scip.contains_edges(docs))
    derived = occurrence_edges(chunks, occurrences, adapter.import_kinds)
    sites = adapter.sites(files.select("relative_path", "content"))
    if sites is not None:
        derived = derived.unionByName(call_edges.call_edges(sites, occurrences, chunks, symbols)).distinct()
    texts = retrieval_texts(chunks, symbols, occurrences, scip_edges)
    chunks_entry, stored = stage("chunks", chunks.join(texts, "chunk_key"))
    owners = stored.select(F.lit("chunk").alias("owner_type"), F.col("chunk_key").alias("owner_key"), F.col("retrieval_text").alias("text"))
    owners = owners.withColumn("text_hash", fx.content_hash(F.col("text")))
    told = symbols.select(F.lit("symbol").alias("owner_type"), F.col("scip_symbol").alias("owner_key"), fx.symbol_record_text(symbols).alias("text"))
    owners = owners.unionByName(told.withColumn("text_hash", fx.content_hash(F.col("text"))))
    kept, new = None, owners
    if source.cached_vectors is not None:
        key = ["owner_type", "owner_key", "text_hash"]
        kept = source.cached_vectors.join(owners.select(*key), key, "left_semi")
        new = owners.join(kept.select("owner_type", "owner_key"), ["owner_type", "owner_key"], "left_anti")
    vectors = source.provider.embed(new.select("owner_type", "owner_key", "text")).join(owners, ["owner_type", "owner_key"])
    vectors = vectors.select("owner_type", "owner_key", F.lit(source.model).alias("model"), "text_hash", "text", "vector")
    vectors = vectors if kept is None else vectors.unionByName(kept.select(*vectors.columns))
    row = {"name": root.rpartition("/")[2], "language": adapter.language, **source.project}
    project = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row)).withColumn("last_indexed_at", F.current_timestamp())
    payload = {
        "projects": project, "files": files.drop("content"), "symbols": symbols_entry, "occurrences": occurrences, "chunks": chunks_entry, "chunk_symbols": links_entry,
        "edges": scip_edges.unionByName(derived.withColumn("provenance", F.lit("hybrid"))).distinct(), "embeddings": vectors,
    }
    try:
        store.replace(root, adapter.id, payload)
    finally:
        for df in (docs, pieces, chunks):
            df.unpersist()


def reindex(store: Store, source: Source) -> int:
    """build() anew, but files whose hash is the stored one keep their chunks, and texts of a known hash their
    vectors. How many files were chunked again."""
    of = lambda name: store.table(name, [r for r in store.manifest() if r[1] == source.root and r[2] == source.adapter.id])
    now = source.files.select("relative_path", F.sha2("content", 256).alias("content_hash"))
    source.unchanged = now.join(of("files").select("relative_path", "content_hash"), ["relative_path", "content_hash"], "left_semi").select("relative_path")
    source.cached_chunks, source.cached_vectors = of("chunks"), of("embeddings")
    own = source.documents.where("NOT is_external").select(fx.clean_path(F.col("relative_path")).alias("relative_path"))
    n = source.files.join(own, "relative_path", "left_semi").join(source.unchanged, "relative_path", "left_anti").count()
    build(store, source)
    return n
