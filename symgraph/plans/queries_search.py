"""Queries of retrieval: on one project root, whole tables where an operator has no root."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring as sx
from ..functions import text as fx
from ..operators import build, ranking, retrieval
from ..operators.build import StoredIndex
from ..operators.derive import Index
from ..operators.tables import Store
from ..session import scratch
from ..sources.corpus import Corpus, root_of
from . import model_sql as m
from .router import Router

SOURCE, QUERY, WORDS, VECTOR, LIMIT = "src0", "thea", "thea reor", 0, 10


def index(spark, sf_dir, source: str | None = SOURCE) -> Index:
    return Index(Corpus(spark, sf_dir, source))


def vector(spark, sf_dir, vec_id: int = VECTOR) -> list[float]:
    """A query's vector: one row, here from the table of vectors."""
    row = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(F.col("vec_id") == vec_id).select("embedding").first()
    return [float(x) for x in row[0]]


_STORED: dict[tuple, StoredIndex] = {}


def stored(spark, sf_dir, source: str = SOURCE) -> StoredIndex:
    """The index of a source's documents: built at the first search of a session, and again if their tables change."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{t}.parquet") for t in ("documents", "embeddings")]
    key = (spark.sparkContext.applicationId, sf_dir, source, *(p.getFileSystem(conf).getFileStatus(p).getModificationTime() for p in paths))
    if key not in _STORED:
        store = Store(spark, scratch(spark))
        build.store_corpus(Corpus(spark, sf_dir, source), store, root_of(source))
        _STORED[key] = StoredIndex(store, root_of(source))
    return _STORED[key]


def _word(symbol: str):
    """A corpus' symbol without what symbols of a store begin with."""
    return F.substring(symbol, len(build.CORPUS_SYMBOL) + 1, 1 << 30).alias(symbol)


def router(spark, sf_dir) -> Router:
    return Router(stored(spark, sf_dir), lambda query: vector(spark, sf_dir))


def lexical_chunk_search(spark, sf_dir):
    chunks = index(spark, sf_dir, None).chunks
    return retrieval.search_chunks(chunks, WORDS, 50).select("chunk_key", "score", "rank")


LEXICAL_CHUNK_SEARCH = f"{m.model()},\n{m.lexical_chunks(WORDS, fx.search_terms(WORDS), 50)}\nSELECT chunk_key, score, CAST(rank AS INTEGER) AS rank FROM lexical_chunks"


def symbol_search(spark, sf_dir):
    return retrieval.search_symbols(Corpus(spark, sf_dir).symbols, QUERY, 40).select("root_path", "display_name", "score", "rank")


SYMBOL_SEARCH = f"{m.model()},\n{m.lexical_symbols(QUERY, 40)}\nSELECT root_path, display_name, score, CAST(rank AS INTEGER) AS rank FROM lexical_symbols"


def find_definitions(spark, sf_dir):
    return retrieval.find_definitions(Corpus(spark, sf_dir).symbols, QUERY, 25).select("root_path", "display_name", "abs_path", "rule", "rank")


FIND_DEFINITIONS = f"{m.model()},\n{m.found_definitions(QUERY, 25)}\nSELECT root_path, display_name, abs_path, rule, CAST(rank AS INTEGER) AS rank FROM found"


def supplier_definitions(spark, sf_dir):
    """The same search on names of suppliers."""
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    symbols = rows.select(F.col("s_name").alias("display_name"), F.concat(F.lit("s "), "s_name").alias("scip_symbol"), F.concat(F.lit("/nations/"), F.col("s_nationkey").cast("string"), F.when(F.col("s_suppkey") % 2 == 0, "/tests/").otherwise("/"), "s_name").alias("abs_path"), F.col("s_suppkey").alias("def_line"))
    return retrieval.find_definitions(symbols, "supplier", 30).select("display_name", "abs_path", "rule", "in_tests", "rank")


SUPPLIER_DEFINITIONS = """WITH symbols AS (
  SELECT s_name AS display_name, 's ' || s_name AS scip_symbol, '/nations/' || s_nationkey || CASE WHEN s_suppkey % 2 = 0 THEN '/tests/' ELSE '/' END || s_name AS abs_path, s_suppkey AS def_line FROM supplier
),
""" + m.found_definitions("supplier", 30) + "\nSELECT display_name, abs_path, rule, in_tests, CAST(rank AS INTEGER) AS rank FROM found"  # fmt: skip


def resolve_definition(spark, sf_dir):
    found = retrieval.find_definitions(Corpus(spark, sf_dir).symbols, QUERY, 25)
    out = ranking.resolved_definition(found, QUERY)
    return out.select("root_path", "display_name", "abs_path", "kind", "ambiguous", F.round("specificity", 9).alias("specificity"))


RESOLVE_DEFINITION = f"{m.model()},\n{m.found_definitions(QUERY, 25)},\n{m.resolved(QUERY)}\nSELECT root_path, display_name, abs_path, kind, ambiguous, CAST(round(specificity, 9) AS DOUBLE) AS specificity FROM resolved"


def knn_l2(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return retrieval.nearest(vectors, vector(spark, sf_dir), 60).select("vec_id", "label", F.round("distance", 6).alias("distance"))


_QUERY_VECTOR = f"(SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = {VECTOR})"
KNN_L2 = f"""SELECT vec_id, label, round(list_distance(CAST(embedding AS DOUBLE[]), {_QUERY_VECTOR}), 6) AS distance
FROM embeddings ORDER BY list_distance(CAST(embedding AS DOUBLE[]), {_QUERY_VECTOR}), vec_id LIMIT 60"""


def vector_search(spark, sf_dir):
    own = index(spark, sf_dir)
    hits = retrieval.search_vectors(own.plain_chunks, own.vectors, vector(spark, sf_dir), ranking.pool_size(LIMIT))
    return hits.select("chunk_key", "abs_path", "primary_symbol", F.round("distance", 6).alias("distance"), "rank")


VECTOR_SEARCH = f"{m.model(SOURCE)},\n{m.semantic(VECTOR, 60)}\nSELECT chunk_key, abs_path, primary_symbol, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM near_hits"


def foreign_first_search(spark, sf_dir):
    """The nearest of all projects first, then the project's, as the store did it."""
    own = index(spark, sf_dir)
    hits = retrieval.search_vectors(own.plain_chunks, own.vectors, vector(spark, sf_dir), 200, foreign_first=True)
    return hits.select("chunk_key", F.round("distance", 6).alias("distance"))


FOREIGN_FIRST_SEARCH = f"""{m.model(SOURCE)}, near AS (
  SELECT vec_id, list_distance(CAST(embedding AS DOUBLE[]), {_QUERY_VECTOR}) AS distance FROM embeddings ORDER BY distance, vec_id LIMIT 200)
SELECT c.chunk_key, round(n.distance, 6) AS distance FROM near n JOIN chunks c ON c.doc_id = n.vec_id AND c.kind = 'module'"""


def similarity_floor(spark, sf_dir):
    near = retrieval.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), vector(spark, sf_dir), 100)
    hits = retrieval.ranked(near, ["distance", "vec_id"], 100)
    return ranking.above_floor(hits).select("vec_id", F.round("similarity", 6).alias("similarity"))


SIMILARITY_FLOOR = f"""WITH near AS (
  SELECT vec_id, list_distance(CAST(embedding AS DOUBLE[]), {_QUERY_VECTOR}) AS distance FROM embeddings ORDER BY distance, vec_id LIMIT 100
), s AS (SELECT vec_id, CASE WHEN distance <= 0 THEN 1.0 ELSE 1.0 / (1.0 + distance) END AS similarity, row_number() OVER (ORDER BY distance, vec_id) AS nr FROM near)
SELECT vec_id, CAST(round(similarity, 6) AS DOUBLE) AS similarity FROM s WHERE similarity >= greatest(0.2, 0.7 * (SELECT max(similarity) FROM s)) OR nr = 1"""


def low_confidence_gate(spark, sf_dir):
    """Vectors as single-token queries with their nearest other vector: shown, or held back for want of evidence."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    query = vector(spark, sf_dir)
    rows = e.select("vec_id", sx.similarity(retrieval.l2_distance(F.col("embedding"), query)).alias("similarity"))
    one, more = (ranking.enough(F.col("similarity"), n) for n in (1, 2))
    return rows.select("vec_id", one.alias("shown_one_term"), more.alias("shown_terms"))


LOW_CONFIDENCE_GATE = f"""WITH s AS (SELECT vec_id, list_distance(CAST(embedding AS DOUBLE[]), {_QUERY_VECTOR}) AS d FROM embeddings)
SELECT vec_id, CASE WHEN d <= 0 THEN 1.0 ELSE 1.0 / (1.0 + d) END >= 0.55 AS shown_one_term, CASE WHEN d <= 0 THEN 1.0 ELSE 1.0 / (1.0 + d) END >= 0.44 AS shown_terms FROM s"""


def reference_family(spark, sf_dir):
    own = index(spark, sf_dir)
    seeds = own.symbols.where(F.col("display_name").startswith("the")).select(F.col("display_name").alias("symbol"))
    family = retrieval.reference_family(own.edges, seeds)
    refs = retrieval.list_references(own.occurrences, own.edges, seeds, None)
    return family.join(refs.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_references")), "symbol", "left").select("symbol", F.coalesce("n_references", F.lit(0)).alias("n_references"))


_FAMILY = """seed AS (SELECT display_name AS symbol FROM symbols WHERE starts_with(display_name, 'the')), family AS (
  SELECT symbol FROM seed
  UNION SELECT dst_symbol FROM edges WHERE kind = 'reference' AND src_symbol IN (SELECT symbol FROM seed)
  UNION SELECT src_symbol FROM edges WHERE kind = 'reference' AND dst_symbol IN (SELECT symbol FROM seed)
)"""
REFERENCE_FAMILY = f"{m.model(SOURCE)}, {_FAMILY}\nSELECT f.symbol, count(o.symbol) AS n_references FROM family f LEFT JOIN occurrences o ON o.symbol = f.symbol AND NOT o.is_definition GROUP BY f.symbol"


def list_references(spark, sf_dir):
    own = index(spark, sf_dir)
    seeds = spark.createDataFrame([(QUERY,)], "symbol string")
    return retrieval.list_references(own.occurrences, own.edges, seeds, 40)


LIST_REFERENCES = f"""{m.model(SOURCE)}, seed(symbol) AS (VALUES ('{QUERY}')), family AS (
  SELECT symbol FROM seed
  UNION SELECT dst_symbol FROM edges WHERE kind = 'reference' AND src_symbol IN (SELECT symbol FROM seed)
  UNION SELECT src_symbol FROM edges WHERE kind = 'reference' AND dst_symbol IN (SELECT symbol FROM seed)
)
SELECT symbol, root_path || '/d' || doc_id || '.txt' AS abs_path, line, col, syntax_kind FROM occurrences
WHERE NOT is_definition AND symbol IN (SELECT symbol FROM family) ORDER BY abs_path, line, col LIMIT 40"""


def definition_chunk(spark, sf_dir):
    chunks = index(spark, sf_dir, None).plain_chunks
    return retrieval.definition_chunks(chunks).select("root_path", "primary_symbol", "chunk_key", "start_line")


DEFINITION_CHUNK = f"{m.model()},\n{m.DEFINITION_CHUNKS}\nSELECT root_path, primary_symbol, chunk_key, start_line FROM definition_chunks"


def linked_symbols(spark, sf_dir):
    own = index(spark, sf_dir)
    wanted = own.plain_chunks.where(F.col("name") == "the").select("chunk_key")
    return retrieval.linked_symbols(own.links, wanted)


LINKED_SYMBOLS = f"{m.model(SOURCE)}\nSELECT chunk_key, symbol, role, weight FROM links WHERE chunk_key IN (SELECT chunk_key FROM chunks WHERE name = 'the') ORDER BY chunk_key, weight DESC, symbol"


def neighbor_chunks(spark, sf_dir):
    chunks = Corpus(spark, sf_dir, SOURCE).chunks
    seed = chunks.where("kind = 'block'").orderBy(F.desc("start_line"), "chunk_key").limit(1)
    return retrieval.neighbours(chunks, seed, 6).select("chunk_key", "start_line", "line_distance")


NEIGHBOR_CHUNKS = f"""{m.model(SOURCE)}, seed AS (SELECT * FROM chunks WHERE kind = 'block' ORDER BY start_line DESC, chunk_key LIMIT 1)
SELECT c.chunk_key, c.start_line, abs(c.start_line - s.start_line) AS line_distance FROM chunks c, seed s
WHERE c.doc_id = s.doc_id AND c.chunk_key <> s.chunk_key ORDER BY line_distance, c.start_line, c.chunk_key LIMIT 6"""


def neighbor_turns(spark, sf_dir):
    """The turns nearest to the third one of each conversation."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role")
    seed = rows.where("turn = 2").select(F.col("conv_id").alias("s_id"), F.col("turn").alias("s_turn"))
    near = rows.join(seed, F.col("conv_id") == F.col("s_id")).withColumn("turn_distance", F.abs(F.col("turn") - F.col("s_turn"))).where("turn_distance BETWEEN 1 AND 2")
    return near.select("conv_id", "turn", "role", "turn_distance")


NEIGHBOR_TURNS = """SELECT c.conv_id, c.turn, c.role, abs(c.turn - s.turn) AS turn_distance FROM conversations c JOIN conversations s ON s.conv_id = c.conv_id AND s.turn = 2
WHERE abs(c.turn - s.turn) BETWEEN 1 AND 2"""


def related_chunks(spark, sf_dir):
    own = index(spark, sf_dir)
    seeds = own.symbols.where(F.char_length("display_name") == 5).select(F.col("display_name").alias("symbol"))
    return retrieval.related_chunks(own.plain_chunks, own.edges, seeds, 6).select("seed", "relation_kind", "direction", "chunk_key", "abs_path", "start_line")


RELATED_CHUNKS = f"{m.model(SOURCE)}, five AS (SELECT display_name AS symbol FROM symbols WHERE length(display_name) = 5),\n{m.related('five', 6)}\nSELECT seed, relation_kind, direction, chunk_key, abs_path, start_line FROM related"


def fusion_scores(spark, sf_dir):
    r = router(spark, sf_dir)
    signals = r.signals(QUERY, LIMIT, _hybrid_plan())
    return ranking.fused(r.boosts(signals)).select("chunk_key", "kind", F.round("score", 9).alias("score"))


def _hybrid_plan():
    from .router import plan_of

    return plan_of("hybrid", QUERY)


_TERMS = fx.search_terms(QUERY)
_HYBRID = m.hybrid(SOURCE, QUERY, _TERMS, VECTOR, LIMIT)
FUSION_SCORES = _HYBRID + "\nSELECT chunk_key, kind, round(score, 9) AS score FROM fused"


def seed_symbols(spark, sf_dir):
    r = router(spark, sf_dir)
    boosts = r.boosts(r.signals(QUERY, LIMIT, _hybrid_plan()))
    return ranking.seed_symbols(boosts, r.index.links).select(_word("symbol"), F.round("weight", 9).alias("weight"))


SEED_SYMBOLS = _HYBRID + "\nSELECT symbol, round(weight, 9) AS weight FROM seeds"


def graph_expansion(spark, sf_dir):
    r = router(spark, sf_dir)
    boosts = r.boosts(r.signals(QUERY, LIMIT, _hybrid_plan()))
    seeds = ranking.seed_symbols(boosts, r.index.links)
    grown = ranking.graph_boosts(r.index.plain_chunks, r.index.edges, seeds, LIMIT)
    return grown.groupBy("chunk_key").agg(F.count(F.lit(1)).alias("n_relations"), F.round(F.sum("boost"), 9).alias("boost"))


GRAPH_EXPANSION = _HYBRID + f"""
SELECT c.chunk_key, count(*) AS n_relations, round(sum(18 * (s.weight / 120.0) * {m.EDGE_WEIGHT}), 9) AS boost FROM related c JOIN seeds s ON s.symbol = c.seed GROUP BY c.chunk_key"""


def _shown(hits):
    return hits.select("chunk_key", "kind", "start_line", "score", F.round("probability", 9).alias("probability"), "rank")


_SHOW = "\nSELECT chunk_key, kind, start_line, score, round(probability, 9) AS probability, CAST(rank AS INTEGER) AS rank FROM hits"


def hybrid_search(spark, sf_dir):
    return _shown(router(spark, sf_dir).search(QUERY, LIMIT, "hybrid"))


HYBRID_SEARCH = _HYBRID + _SHOW


def search_mode_symbol(spark, sf_dir):
    return _shown(router(spark, sf_dir).search(QUERY, LIMIT, "symbol"))


SEARCH_MODE_SYMBOL = m.hybrid(SOURCE, QUERY, _TERMS, VECTOR, LIMIT, chunks=False, near=False, graph=False) + _SHOW


def search_mode_semantic(spark, sf_dir):
    return _shown(router(spark, sf_dir).search(QUERY, LIMIT, "semantic"))


SEARCH_MODE_SEMANTIC = m.hybrid(SOURCE, QUERY, _TERMS, VECTOR, LIMIT, exact=False, symbols=False, chunks=False, graph=False) + _SHOW


def search_mode_graph(spark, sf_dir):
    return _shown(router(spark, sf_dir).search(QUERY, LIMIT, "graph"))


SEARCH_MODE_GRAPH = m.hybrid(SOURCE, QUERY, _TERMS, VECTOR, LIMIT, chunks=False) + _SHOW


def search_mode_auto(spark, sf_dir):
    return _shown(router(spark, sf_dir).search(QUERY, LIMIT))


SEARCH_MODE_AUTO = _HYBRID + _SHOW  # an identifier: hybrid with a gate, which lexical hits pass


def search_mode_auto_words(spark, sf_dir):
    return _shown(router(spark, sf_dir).search(WORDS, LIMIT))


_WORDS_CHAIN = m.hybrid(SOURCE, WORDS, fx.search_terms(WORDS), VECTOR, LIMIT, exact=False)
SEARCH_MODE_AUTO_WORDS = _WORDS_CHAIN + _SHOW + """
WHERE EXISTS (SELECT 1 FROM lexical_symbols) OR EXISTS (SELECT 1 FROM lexical_chunks) OR EXISTS (SELECT 1 FROM semantic WHERE rank = 0 AND similarity >= 0.44)"""


#: A word that its project defines, in a chunk that it names.
EXACT = "eden"
_EXACT_TERMS = fx.search_terms(EXACT)


def exact_search_symbol(spark, sf_dir):
    return _shown(router(spark, sf_dir).search(EXACT, LIMIT, "symbol"))


EXACT_SEARCH_SYMBOL = m.hybrid(SOURCE, EXACT, _EXACT_TERMS, VECTOR, LIMIT, chunks=False, near=False, graph=False) + _SHOW


def exact_search_graph(spark, sf_dir):
    return _shown(router(spark, sf_dir).search(EXACT, LIMIT, "graph"))


EXACT_SEARCH_GRAPH = m.hybrid(SOURCE, EXACT, _EXACT_TERMS, VECTOR, LIMIT, chunks=False) + _SHOW


def exact_search_hybrid(spark, sf_dir):
    return _shown(router(spark, sf_dir).search(EXACT, LIMIT, "hybrid"))


EXACT_SEARCH_HYBRID = m.hybrid(SOURCE, EXACT, _EXACT_TERMS, VECTOR, LIMIT) + _SHOW


def exact_definition(spark, sf_dir):
    return router(spark, sf_dir).definition(EXACT)


EXACT_DEFINITION = f"""{m.model(SOURCE)},\n{m.DEFINITION_CHUNKS},\n{m.found_definitions(EXACT, 8)},\n{m.resolved(EXACT)}
SELECT r.display_name, r.scip_symbol, r.abs_path, r.def_line, r.ambiguous, c.chunk_key, c.start_line, c.end_line FROM resolved r LEFT JOIN definition_chunks c ON c.primary_symbol = r.display_name"""


def exact_context_related(spark, sf_dir):
    """Chunks related to the seed of a context; the seed is the best hit after the rules for seeds."""
    return router(spark, sf_dir).context(EXACT, LIMIT, "hybrid")["related"].select("chunk_key", _word("seed"), "relation_kind", "direction", "rank")


EXACT_CONTEXT_RELATED = m.hybrid(SOURCE, EXACT, _EXACT_TERMS, VECTOR, LIMIT) + f""", context_seed AS (
  SELECT * FROM (SELECT *, round(score * {m.RERANK} * CASE WHEN kind = 'module' THEN 0.22 ELSE 1.0 END * CASE WHEN name = '{EXACT}' THEN 1.6 ELSE 1.0 END, 9) AS seed_score FROM hits)
  ORDER BY seed_score DESC, rank LIMIT 1
), own AS (
  SELECT symbol, max(weight * ({m.ROLE_WEIGHT})::DOUBLE) AS weight FROM links WHERE chunk_key = (SELECT chunk_key FROM context_seed) GROUP BY symbol
), best AS (SELECT *, row_number() OVER (ORDER BY round(weight, 9) DESC, symbol) - 1 AS seed_rank FROM own QUALIFY seed_rank < 4),
{m.related('best', 6, 'near_seed')}, once AS (
  SELECT r.*, b.seed_rank, row_number() OVER (PARTITION BY chunk_key ORDER BY b.seed_rank, r.nr) AS again FROM near_seed r JOIN best b ON b.symbol = r.seed
)
SELECT chunk_key, seed, relation_kind, direction, CAST(row_number() OVER (ORDER BY seed_rank, nr) - 1 AS INTEGER) AS rank FROM once WHERE again = 1 ORDER BY rank LIMIT {LIMIT}"""


def softmax_probabilities(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = e.select("vec_id", "label", (10 * sx.similarity(retrieval.l2_distance(F.col("embedding"), vector(spark, sf_dir)))).alias("score"))
    rows = ranking.shares(ranking.shares(rows, F.col("score"), "a", 4.0), F.col("score"), "l", 1.0, "label")
    return rows.select("vec_id", F.round("a", 9).alias("all_t4"), F.round("l", 9).alias("label_t1"))


SOFTMAX_PROBABILITIES = f"""WITH s AS (SELECT vec_id, label, list_distance(CAST(embedding AS DOUBLE[]), {_QUERY_VECTOR}) AS d FROM embeddings),
t AS (SELECT vec_id, label, (10 * CASE WHEN d <= 0 THEN 1.0 ELSE 1.0 / (1.0 + d) END)::DOUBLE AS score FROM s),
u AS (SELECT *, exp((score - max(score) OVER ()) / 4.0) AS w4, exp(score - max(score) OVER (PARTITION BY label)) AS w1 FROM t)
SELECT vec_id, round(w4 / sum(w4) OVER (), 9) AS all_t4, round(w1 / sum(w1) OVER (PARTITION BY label), 9) AS label_t1 FROM u"""


def _probabilities(spark, sf_dir):
    near = retrieval.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), vector(spark, sf_dir), LIMIT)
    hits = retrieval.ranked(near, ["distance", "vec_id"], LIMIT)
    return hits.withColumn("probability", sx.softmax(12 * sx.similarity(F.col("distance")), 1.0)).select("vec_id", "rank", "probability")


def adaptive_clip(spark, sf_dir):
    out = ranking.clipped(_probabilities(spark, sf_dir))
    return out.select("vec_id", "rank", F.round("probability", 9).alias("probability"))


ADAPTIVE_CLIP = f"""WITH near AS (
  SELECT vec_id, list_distance(CAST(embedding AS DOUBLE[]), {_QUERY_VECTOR}) AS d FROM embeddings ORDER BY d, vec_id LIMIT {LIMIT}
), s AS (SELECT vec_id, row_number() OVER (ORDER BY d, vec_id) - 1 AS rank, (12 * CASE WHEN d <= 0 THEN 1.0 ELSE 1.0 / (1.0 + d) END)::DOUBLE AS score FROM near),
w AS (SELECT *, exp(score - max(score) OVER ()) AS w FROM s), p AS (SELECT vec_id, rank, w / sum(w) OVER () AS probability FROM w),
c AS (SELECT *, sum(probability) OVER (ORDER BY rank) AS mass, lead(probability) OVER (ORDER BY rank) AS next FROM p),
k AS (SELECT min(CASE WHEN mass >= 0.90 AND next <= 0.05 THEN rank END) AS last FROM c)
SELECT vec_id, CAST(rank AS INTEGER) AS rank, round(CASE WHEN last IS NULL THEN probability ELSE probability / sum(probability) OVER () END, 9) AS probability
FROM c, k WHERE last IS NULL OR rank <= last"""


def context_seed(spark, sf_dir):
    seed = ranking.context_seed(router(spark, sf_dir).search(QUERY, LIMIT), QUERY, fx.is_identifier(QUERY))
    return seed.select("chunk_key", "kind", "seed_score")


_SEED = f""", context_seed AS (
  SELECT * FROM (SELECT *, round(score * {m.RERANK} * CASE WHEN kind = 'module' THEN 0.22 ELSE 1.0 END * CASE WHEN name = '{QUERY}' THEN 1.6 ELSE 1.0 END, 9) AS seed_score FROM hits)
  ORDER BY seed_score DESC, rank LIMIT 1
)"""
CONTEXT_SEED = _HYBRID + _SEED + "\nSELECT chunk_key, kind, CAST(seed_score AS DOUBLE) AS seed_score FROM context_seed"


def context_neighbours(spark, sf_dir):
    return router(spark, sf_dir).context(QUERY, LIMIT)["neighbours"].select("chunk_key", "line_distance")


CONTEXT_NEIGHBOURS = _HYBRID + _SEED + """
SELECT c.chunk_key, abs(c.start_line - s.start_line) AS line_distance FROM pchunks c, pchunks s
WHERE s.chunk_key = (SELECT chunk_key FROM context_seed) AND c.doc_id = s.doc_id AND c.chunk_key <> s.chunk_key ORDER BY line_distance, c.start_line, c.chunk_key LIMIT 4"""


def seed_chunk_related(spark, sf_dir):
    own = index(spark, sf_dir)
    seed = own.plain_chunks.where("kind = 'module'").orderBy("chunk_key").limit(1)
    out = ranking.seed_chunk_related(own.plain_chunks, own.edges, own.links, seed, LIMIT)
    return out.select("chunk_key", "seed", "relation_kind", "direction", "rank")


_SEED_RELATED = f"""own AS (
  SELECT symbol, max(weight * ({m.ROLE_WEIGHT})::DOUBLE) AS weight FROM links WHERE chunk_key = (SELECT min(chunk_key) FROM chunks WHERE kind = 'module') GROUP BY symbol
), best AS (SELECT *, row_number() OVER (ORDER BY round(weight, 9) DESC, symbol) - 1 AS seed_rank FROM own QUALIFY seed_rank < 4),
{m.related('best', 6)}, once AS (
  SELECT r.*, b.seed_rank, row_number() OVER (PARTITION BY chunk_key ORDER BY b.seed_rank, r.nr) AS again FROM related r JOIN best b ON b.symbol = r.seed
)"""
SEED_CHUNK_RELATED = f"{m.model(SOURCE)}, {_SEED_RELATED}\nSELECT chunk_key, seed, relation_kind, direction, CAST(row_number() OVER (ORDER BY seed_rank, nr) - 1 AS INTEGER) AS rank FROM once WHERE again = 1 ORDER BY rank LIMIT {LIMIT}"


def definition_query(spark, sf_dir):
    return router(spark, sf_dir).definition(QUERY)


DEFINITION_QUERY = f"""{m.model(SOURCE)},\n{m.DEFINITION_CHUNKS},\n{m.found_definitions(QUERY, 8)},\n{m.resolved(QUERY)}
SELECT r.display_name, r.scip_symbol, r.abs_path, r.def_line, r.ambiguous, c.chunk_key, c.start_line, c.end_line FROM resolved r LEFT JOIN definition_chunks c ON c.primary_symbol = r.display_name"""


def references_query(spark, sf_dir):
    return router(spark, sf_dir).references(QUERY, None).groupBy(_word("symbol")).agg(F.count(F.lit(1)).alias("n"), F.min("abs_path").alias("first_path"))


REFERENCES_QUERY = f"""{m.model(SOURCE)},\n{m.found_definitions(QUERY, 8)},\n{m.resolved(QUERY)}, seed AS (
  SELECT display_name AS symbol FROM found WHERE display_name = '{QUERY}' OR scip_symbol = '{QUERY}' UNION SELECT display_name FROM resolved
), family AS (
  SELECT symbol FROM seed
  UNION SELECT dst_symbol FROM edges WHERE kind = 'reference' AND src_symbol IN (SELECT symbol FROM seed)
  UNION SELECT src_symbol FROM edges WHERE kind = 'reference' AND dst_symbol IN (SELECT symbol FROM seed)
)
SELECT symbol, count(*) AS n, min(root_path || '/d' || doc_id || '.txt') AS first_path FROM occurrences WHERE NOT is_definition AND symbol IN (SELECT symbol FROM family) GROUP BY symbol"""


def symbol_vector_search(spark, sf_dir):
    """Vectors of symbols: the same search, with the files of the symbols joined where there are any."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    near = retrieval.nearest(vectors, vector(spark, sf_dir, 1), 30).select("vec_id", "distance")
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("k"), "n_name")
    return near.join(nations, F.col("vec_id") == F.col("k"), "left").select("vec_id", F.round("distance", 6).alias("distance"), F.coalesce("n_name", F.lit("")).alias("file_name"))


SYMBOL_VECTOR_SEARCH = """WITH near AS (
  SELECT vec_id, list_distance(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 1)) AS distance FROM embeddings ORDER BY distance, vec_id LIMIT 30)
SELECT vec_id, round(distance, 6) AS distance, coalesce(n_name, '') AS file_name FROM near LEFT JOIN nation ON n_nationkey = vec_id"""


def vector_norm(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.round(retrieval.vector_norm(F.col("embedding")), 5).alias("norm"), F.size("embedding").alias("n"))


VECTOR_NORM = """SELECT vec_id, round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), x -> x * x))), 5) AS norm, CAST(len(embedding) AS INTEGER) AS n FROM embeddings"""


def rank_weight(spark, sf_dir):
    """Reciprocal rank weights of suppliers by balance within their nation."""
    from pyspark.sql import Window

    w = Window.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey")
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return rows.select("s_suppkey", F.round(sx.rank_weight(F.row_number().over(w) - 1), 9).alias("weight"))


RANK_WEIGHT = "SELECT s_suppkey, round(1.0::DOUBLE / row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey), 9) AS weight FROM supplier"

QUERIES = {
    f.__name__: f
    for f in (
        lexical_chunk_search, symbol_search, find_definitions, supplier_definitions, resolve_definition, knn_l2, vector_search, foreign_first_search,
        similarity_floor, low_confidence_gate, reference_family, list_references, definition_chunk, linked_symbols, neighbor_chunks, neighbor_turns,
        related_chunks, fusion_scores, seed_symbols, graph_expansion, hybrid_search, search_mode_symbol, search_mode_semantic, search_mode_graph,
        search_mode_auto, search_mode_auto_words, exact_search_symbol, exact_search_graph, exact_search_hybrid, exact_definition,
        exact_context_related, softmax_probabilities, adaptive_clip, context_seed, context_neighbours, seed_chunk_related,
        definition_query, references_query, symbol_vector_search, vector_norm, rank_weight,
    )
}
ORACLES = {name: globals()[name.upper()] for name in QUERIES}
