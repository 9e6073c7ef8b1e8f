"""Queries on the model and what is derived from it, over all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring as sx
from ..functions import text as fx
from ..operators import derive
from ..operators.intervals import first_by
from ..sources import scip
from ..sources.corpus import Corpus
from .model_sql import EDGES, model


def files_manifest(spark, sf_dir):
    files = Corpus(spark, sf_dir).files
    return files.select("relative_path", "root_path", "language", fx.content_hash(F.col("text")).alias("content_hash"), fx.line_count(F.col("text")).alias("line_count"), F.substring_index("text", "\n", 1).alias("header"))


FILES_MANIFEST = """
SELECT 'd' || doc_id || '.txt' AS relative_path, '/corpus/' || source AS root_path, lang AS language, sha256(text) AS content_hash,
  CAST(CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + CASE WHEN text LIKE '%' || chr(10) THEN 0 ELSE 1 END END AS INTEGER) AS line_count,
  split_part(text, chr(10), 1) AS header
FROM documents"""


def line_chunks(spark, sf_dir):
    lines = Corpus(spark, sf_dir).lines
    return lines.select("doc_id", "line", F.octet_length("line_text").alias("bytes"), F.substring_index("line_text", " ", 1).alias("first_word"))


LINE_CHUNKS = model() + "\nSELECT doc_id, line, CAST(strlen(line_text) AS INTEGER) AS bytes, split_part(line_text, ' ', 1) AS first_word FROM lines"


def token_occurrences(spark, sf_dir):
    return Corpus(spark, sf_dir).words.select("doc_id", "line", "col", "symbol")


TOKEN_OCCURRENCES = model() + "\nSELECT doc_id, line, col, symbol FROM words"


def chunk_hierarchy(spark, sf_dir):
    return derive.parents(derive.chunk_spans(Corpus(spark, sf_dir)))


CHUNK_HIERARCHY = model() + """, offsets AS (
  SELECT doc_id, line, strlen(line_text) AS size, coalesce(sum(strlen(line_text) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM lines
), spans AS (
  SELECT c.doc_id, c.chunk_key, a.ahead AS sb, b.ahead + b.size AS eb
  FROM chunks c JOIN offsets a ON a.doc_id = c.doc_id AND a.line = c.start_line JOIN offsets b ON b.doc_id = c.doc_id AND b.line = c.end_line
), pairs AS (
  SELECT i.chunk_key, o.chunk_key AS parent_key, row_number() OVER (PARTITION BY i.chunk_key ORDER BY o.eb - o.sb, o.sb, -o.eb, o.chunk_key) AS rn
  FROM spans i JOIN spans o ON i.doc_id = o.doc_id AND o.eb > o.sb AND o.chunk_key <> i.chunk_key AND o.sb <= i.sb AND o.eb >= i.eb
)
SELECT c.chunk_key, p.parent_key FROM chunks c LEFT JOIN pairs p ON p.chunk_key = c.chunk_key AND p.rn = 1"""


def symbol_definitions(spark, sf_dir):
    return Corpus(spark, sf_dir).symbols.select("root_path", "display_name", "kind", "abs_path", "def_line", "def_col", "signature")


SYMBOL_DEFINITIONS = model() + "\nSELECT root_path, display_name, kind, abs_path, def_line, def_col, signature FROM symbols"


def primary_symbol(spark, sf_dir):
    corpus = Corpus(spark, sf_dir)
    return derive.primary_symbols(corpus.chunks, corpus.definitions)


PRIMARY_SYMBOL = model() + "\nSELECT chunk_key, primary_symbol FROM prim"


def chunk_symbol_links(spark, sf_dir):
    return derive.chunk_symbol_totals(Corpus(spark, sf_dir))


CHUNK_SYMBOL_LINKS = model() + """
SELECT symbol, role, split_part(chunk_key, ':', 4) AS chunk_kind, count(*) AS n_chunks, min(chunk_key) AS first_chunk, max(weight) AS weight FROM links GROUP BY ALL"""


def occurrence_edges(spark, sf_dir):
    corpus = Corpus(spark, sf_dir)
    primary = derive.primary_symbols(corpus.chunks, corpus.definitions)
    return derive.occurrence_edges(corpus.chunks.join(primary, "chunk_key", "left"), corpus.occurrences)


OCCURRENCE_EDGES = model() + "\nSELECT src_symbol, dst_symbol, kind FROM occurrence_edges"


def retrieval_text(spark, sf_dir):
    corpus = Corpus(spark, sf_dir)
    primary = derive.primary_symbols(corpus.chunks, corpus.definitions)
    blocks = corpus.chunks.where("kind = 'block'")
    names = derive.reference_names(None, corpus.occurrences, blocks)
    rows = corpus.chunk_texts.where("kind = 'block'").join(primary, "chunk_key", "left").join(names, "chunk_key", "left")
    signature = F.coalesce(F.concat("primary_symbol", F.lit("()")), F.lit(""))
    text = derive.retrieval_text(F.coalesce("primary_symbol", "name"), F.col("kind"), F.col("abs_path"), signature, F.lit(""), F.col("names"), F.col("text"))
    return rows.select("chunk_key", F.sha2(text, 256).alias("text_hash"), F.octet_length(text).alias("bytes"), F.size(F.coalesce("names", F.array().cast("array<string>"))).alias("n_names"))


RETRIEVAL_TEXT = model() + """, firsts AS (
  SELECT c.chunk_key, o.symbol, min(o.line * 1000000 + o.col) AS place
  FROM (SELECT DISTINCT doc_id, line, col, symbol FROM occ_roles WHERE role <> 'defines') o
  JOIN chunks c ON c.kind = 'block' AND c.doc_id = o.doc_id AND o.line BETWEEN c.start_line AND c.end_line GROUP BY ALL
), names AS (
  SELECT chunk_key, string_agg(symbol, ', ' ORDER BY nr) AS uses, count(*) AS n FROM (
    SELECT *, row_number() OVER (PARTITION BY chunk_key ORDER BY place, symbol) AS nr FROM firsts) WHERE nr <= 15 GROUP BY chunk_key
), texts AS (
  SELECT p.chunk_key, coalesce(n.n, 0) AS n,
    CASE WHEN coalesce(primary_symbol, name) <> '' THEN coalesce(primary_symbol, name) || ' is a block in ' || abs_path || '.' ELSE 'A block in ' || abs_path || '.' END
    || CASE WHEN primary_symbol IS NOT NULL THEN ' Signature: ' || primary_symbol || '().' ELSE '' END
    || CASE WHEN n.uses IS NOT NULL THEN ' Uses ' || n.uses || '.' ELSE '' END || chr(10) || chr(10) || text AS t
  FROM pchunks p LEFT JOIN names n ON n.chunk_key = p.chunk_key WHERE p.kind = 'block'
)
SELECT chunk_key, sha256(t) AS text_hash, CAST(strlen(t) AS INTEGER) AS bytes, CAST(n AS INTEGER) AS n_names FROM texts"""


def query_terms(spark, sf_dir):
    docs = Corpus(spark, sf_dir).documents
    head = F.substring_index("text", "\n", 1)
    return docs.select("doc_id", F.array_join(fx.search_terms_column(head), "|").alias("terms"), F.size(fx.search_terms_column(head)).alias("n_terms"))


QUERY_TERMS = f"""
WITH t AS (SELECT doc_id, list_filter(list_transform(string_split_regex(lower(split_part(text, chr(10), 1)), '\\s+'), w -> trim(w, {EDGES})), w -> strlen(w) >= 3) AS ws FROM documents),
u AS (SELECT doc_id, list_transform(list_filter(list_zip(ws, range(1, len(ws) + 1)), p -> list_position(ws, p[1]) = p[2]), p -> p[1]) AS ws FROM t)
SELECT doc_id, array_to_string(ws, '|') AS terms, CAST(len(ws) AS INTEGER) AS n_terms FROM u"""


def text_terms(spark, sf_dir):
    """The search terms of whole texts."""
    terms = fx.search_terms_column(F.col("text"))
    return Corpus(spark, sf_dir).documents.select("doc_id", F.sha2(F.array_join(terms, "|"), 256).alias("terms"), F.size(terms).alias("n_terms"))


TEXT_TERMS = f"""
WITH t AS (SELECT doc_id, unnest(string_split_regex(lower(text), '\\s+')) AS w, unnest(range(1, len(string_split_regex(lower(text), '\\s+')) + 1)) AS i FROM documents),
u AS (SELECT doc_id, w, min(i) AS i FROM (SELECT doc_id, trim(w, {EDGES}) AS w, i FROM t) WHERE strlen(w) >= 3 GROUP BY doc_id, w)
SELECT d.doc_id, sha256(coalesce(string_agg(u.w, '|' ORDER BY u.i), '')) AS terms, CAST(count(u.w) AS INTEGER) AS n_terms FROM documents d LEFT JOIN u ON u.doc_id = d.doc_id GROUP BY d.doc_id"""


def identifier_test(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    docs = Corpus(spark, sf_dir).words.select(F.col("symbol").alias("name")).distinct()
    names = parts.select(F.col("p_name").alias("name")).union(parts.select("p_brand")).distinct().union(docs).distinct()
    return names.select("name", fx.is_identifier_column(F.col("name")).alias("is_identifier"))


IDENTIFIER_TEST = model() + """
SELECT name, regexp_full_match(name, '[A-Za-z_][A-Za-z0-9_./:#()\\-]*') AS is_identifier
FROM (SELECT p_name AS name FROM part UNION SELECT p_brand FROM part UNION SELECT symbol FROM words)"""


def position_compare(spark, sf_dir):
    words = Corpus(spark, sf_dir).words
    ends = words.groupBy("doc_id").agg(F.max(sx.position(F.col("line"), F.col("col"))).alias("last"), F.min(sx.position(F.col("line"), F.col("col"))).alias("first"))
    return ends.select("doc_id", "first", "last", (F.col("last") > F.col("first")).alias("spans"))


POSITION_COMPARE = model() + """
SELECT doc_id, min(CAST(line AS BIGINT) * 1048576 + col) AS first, max(CAST(line AS BIGINT) * 1048576 + col) AS last,
  max(CAST(line AS BIGINT) * 1048576 + col) > min(CAST(line AS BIGINT) * 1048576 + col) AS spans FROM words GROUP BY doc_id"""


def symbol_records(spark, sf_dir):
    """Symbols as records: a name from the first source that isn't blank, a kind, a short documentation."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    given = F.when(F.col("page_id") % 3 == 0, "  ").when(F.col("page_id") % 3 == 1, title).otherwise("")
    doc = F.substring(fx.flatten_doc(title), 1, 40)
    return pages.select("page_id", fx.first_non_empty(given, fx.display_name(F.col("url"))).alias("display_name"), fx.first_non_empty(F.lit(None).cast("string"), F.lit("symbol")).alias("kind"), doc.alias("doc_summary"))


SYMBOL_RECORDS = """
WITH t AS (SELECT page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages),
s AS (SELECT *, split_part(replace(replace(split_part(split_part(rtrim(regexp_replace(url, '^local ', ''), '.#:/!'), '/', -1), ':', -1), ').', ''), '()', ''), '(', 1) AS n FROM t),
d AS (SELECT *, regexp_extract(replace(n, '`', ''), '([^#.]*)$', 1) AS shown, CASE WHEN page_id % 3 = 1 THEN title ELSE '' END AS given FROM s)
SELECT page_id, CASE WHEN trim(given) <> '' THEN given WHEN trim(shown) <> '' THEN shown ELSE '' END AS display_name, 'symbol' AS kind,
  substr(trim(regexp_replace(regexp_replace(title, '```[a-z]*', ' ', 'g'), '\\s+', ' ', 'g')), 1, 40) AS doc_summary FROM d"""


def relationship_edges(spark, sf_dir):
    """Up to four edges of a relationship with flags; here flags are the bits of a line number. The operator leaves out
    edges without a symbol, so that a null key is one of its own on the way."""
    rel = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_linenumber")
    flags = {"is_reference": 1, "is_implementation": 2, "is_type_definition": 4, "is_definition": 8}
    named = lambda key: F.coalesce(F.col(key).cast("string"), F.lit("null"))
    number = lambda name: F.nullif(F.col(name), F.lit("null")).cast("long")
    related = F.struct(named("l_partkey").alias("symbol"), *(sx.has_bit(F.col("l_linenumber"), bit).alias(f) for f, bit in flags.items()))
    symbol = F.struct(named("l_orderkey").alias("symbol"), F.array(related).alias("relationships"))
    edges = scip.relationship_edges(rel.select(F.array(symbol).alias("symbols")))
    return edges.withColumns({c: number(c) for c in ("src_symbol", "dst_symbol")})


RELATIONSHIP_EDGES = " UNION ".join(
    f"SELECT l_orderkey AS src_symbol, l_partkey AS dst_symbol, '{kind}' AS kind, 'scip' AS provenance FROM lineitem WHERE l_orderkey % 10 = 1 AND l_linenumber & {bit} <> 0"
    for kind, bit in (("reference", 1), ("implementation", 2), ("type_definition", 4), ("definition", 8))
)


def role_bits(spark, sf_dir):
    """Ranges of three numbers and bits of roles, decoded."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    line = F.col("l_linenumber")
    r = sx.decoded_range(F.when(line % 2 == 0, F.array(line, line + 1, line + 4)).otherwise(F.array(line, line + 1, line + 2, line + 3)))
    rows = rows.select("l_orderkey", "l_linenumber", r.alias("r"))
    bits = F.col("l_linenumber")
    return rows.select("l_orderkey", "l_linenumber", "r.start_line", "r.start_col", "r.end_line", "r.end_col", sx.has_bit(bits, sx.DEFINITION).alias("is_definition"), sx.has_bit(bits, sx.IMPORT).alias("is_import"), sx.has_bit(bits, sx.WRITE).alias("is_write"))


ROLE_BITS = """
SELECT l_orderkey, l_linenumber, l_linenumber AS start_line, l_linenumber + 1 AS start_col,
  CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber ELSE l_linenumber + 2 END AS end_line, CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber + 4 ELSE l_linenumber + 3 END AS end_col,
  l_linenumber & 1 <> 0 AS is_definition, l_linenumber & 2 <> 0 AS is_import, l_linenumber & 4 <> 0 AS is_write FROM lineitem"""


def last_definition_wins(spark, sf_dir):
    """Records of several sources for one key: the highest priority, and of it the last, wins."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", "l_orderkey", "l_linenumber", "l_returnflag")
    priority = F.when(F.col("l_returnflag") == "R", 3).when(F.col("l_returnflag") == "A", 2).otherwise(1)
    rows = items.withColumn("priority", priority)
    return first_by(rows, ["l_partkey"], [F.desc("priority"), F.desc("l_orderkey"), F.desc("l_linenumber")])


LAST_DEFINITION_WINS = """
SELECT l_partkey, l_orderkey, l_linenumber, l_returnflag, priority FROM (
  SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY priority DESC, l_orderkey DESC, l_linenumber DESC) AS rn FROM (
    SELECT l_partkey, l_orderkey, l_linenumber, l_returnflag, CASE l_returnflag WHEN 'R' THEN 3 WHEN 'A' THEN 2 ELSE 1 END AS priority FROM lineitem)) WHERE rn = 1"""


def edge_order(spark, sf_dir):
    """Edges in the order in which they are stored, by number; nulls are last, as in the SQL."""
    edges = relationship_edges(spark, sf_dir)
    return edges.orderBy(*(F.col(c).asc_nulls_last() for c in ("src_symbol", "dst_symbol", "kind"))).select("src_symbol", "dst_symbol", "kind")


EDGE_ORDER = f"SELECT src_symbol, dst_symbol, kind FROM ({RELATIONSHIP_EDGES}) WHERE src_symbol < 2000 ORDER BY ALL"

QUERIES = {
    f.__name__: f
    for f in (
        files_manifest, line_chunks, token_occurrences, chunk_hierarchy, symbol_definitions, primary_symbol, chunk_symbol_links, occurrence_edges,
        retrieval_text, query_terms, text_terms, identifier_test, position_compare, symbol_records, relationship_edges, role_bits, last_definition_wins, edge_order,
    )
}
ORACLES = {name: globals()[name.upper()] for name in QUERIES}
