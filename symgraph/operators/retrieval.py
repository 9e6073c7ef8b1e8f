"""Store queries: lexical, vector and symbol search, definitions, references, neighbours, related chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as fx
from .intervals import first_by

HIT = ("chunk_key", "abs_path", "kind", "name", "start_line", "end_line", "primary_symbol")


def chunk_score(query: str, literal: bool = False) -> tuple[Column, Column]:
    """The additive score of a chunk and the predicate that it matches at all."""
    c = {n: F.col(n) for n in ("retrieval_text", "name", "header_text", "text")}
    weight = lambda p, w: F.when(p, w).otherwise(0.0)
    contains = lambda column, q: fx.like(c[column], q, literal)
    base = [contains("retrieval_text", query), fx.like(c["name"], query, literal, prefix=True), contains("header_text", query), contains("text", query)]
    score = sum((weight(p, w) for p, w in zip(base, (8.0, 4.0, 3.0, 2.0), strict=True)), F.lit(0.0))
    terms = fx.search_terms(query)
    for t in terms:
        score = score + weight(contains("retrieval_text", t), 1.25) + weight(contains("header_text", t), 0.75)
    return score, fx.any_of(base + [contains("retrieval_text", t) for t in terms])


def search_chunks(chunks: DataFrame, query: str, limit: int, literal: bool = False) -> DataFrame:
    """The best chunks by text with score and rank from 0; a blank query is an error."""
    if not query.strip():
        raise ValueError("the query is blank")
    score, matches = chunk_score(query, literal)
    hits = chunks.where(matches).withColumn("score", score).select(*HIT, "score")
    return ranked(hits, [F.desc("score"), "start_line", "abs_path", "chunk_key"], limit)


def ranked(hits: DataFrame, order: list, limit: int) -> DataFrame:
    """The first `limit` rows in order, with rank. The limit keeps the window's one partition small."""
    top = hits.orderBy(*order).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)) - 1)


def held(df: DataFrame) -> DataFrame:
    """A result that its limits bound, brought to the driver once, so that no later step computes it again."""
    return df.sparkSession.createDataFrame(df.toArrow(), df.schema)


def any_in(column: str, rows: DataFrame, of: str) -> Column:
    """column is one of the values of a held() frame: constants, which reach the scan as a filter."""
    return F.col(column).isin(sorted({r[0] for r in rows.select(of).collect()} - {None}))


def l2_distance(vector: Column, query: list[float]) -> Column:
    """Distance from a constant vector, in double, in the vector's order."""
    squares = F.zip_with(vector, F.lit([float(x) for x in query]), lambda a, b: (a.cast("double") - b) * (a.cast("double") - b))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def vector_norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def nearest(vectors: DataFrame, query: list[float], limit: int, key: str = "vec_id") -> DataFrame:
    """The nearest vectors by exact distance: a scan, and a top-k that every task cuts to k rows."""
    return vectors.withColumn("distance", l2_distance(F.col("embedding"), query)).orderBy("distance", key).limit(limit)


def search_vectors(chunks: DataFrame, vectors: DataFrame, query: list[float], limit: int, foreign_first: bool = False) -> DataFrame:
    """Chunks by the distance of their vectors, which name them by owner_key, or by vec_id as the number of the
    document of a module chunk. The project's filter comes first; with foreign_first the nearest of
    all projects are taken before it, as the store did."""
    if "vec_id" in vectors.columns:
        key, own = "vec_id", chunks.where("kind = 'module'").select(*HIT, F.col("doc_id").alias("vec_id"))
    else:
        key, own = "owner_key", chunks.select(*HIT, F.col("chunk_key").alias("owner_key"))
        vectors = vectors.where("owner_type = 'chunk'").withColumnRenamed("vector", "embedding")
    if not foreign_first:
        vectors = vectors.join(own.select(key), key, "left_semi")
    top = nearest(vectors.select(key, "embedding"), query, limit, key).select(key, "distance")
    hits = own.join(F.broadcast(top), key)  # of `limit` rows
    return ranked(hits.select(*HIT, "distance"), ["distance", "start_line", "chunk_key"], limit)


def search_symbols(symbols: DataFrame, query: str, limit: int) -> DataFrame:
    """Symbols by name, symbol, documentation or signature: the first rule that matches gives the score."""
    c = {n: F.col(n) for n in ("display_name", "scip_symbol", "doc_summary", "signature")}
    rules = [
        (c["display_name"] == query, 1.0), (c["scip_symbol"] == query, 0.98), (fx.like(c["display_name"], query, prefix=True), 0.86),
        (fx.like(c["scip_symbol"], query, prefix=True), 0.82), (fx.like(c["doc_summary"], query), 0.55), (fx.like(c["signature"], query), 0.45),
    ]
    wide = [fx.like(c[n], query) for n in ("display_name", "scip_symbol", "doc_summary", "signature")]
    score = F.lit(0.30)
    for rule, value in reversed(rules):
        score = F.when(rule, value).otherwise(score)
    hits = symbols.where(fx.any_of([r for r, _ in rules] + wide)).withColumn("score", score)
    return ranked(hits, [F.desc("score"), F.char_length("display_name"), "display_name", "root_path"], limit)


def find_definitions(symbols: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Symbols of the name, exact ones first, tests last, short names before long ones."""
    name, scip = F.col("display_name"), F.col("scip_symbol")
    found = symbols.where((name == query) | (scip == query) | fx.like(name, query) | fx.like(scip, query))
    rule = F.when(name == query, 0).when(scip == query, 1).when(fx.like(name, query, prefix=True), 2).otherwise(3)
    tests = F.when(F.col("abs_path").like("%/tests/%"), 1).otherwise(0)
    found = found.withColumn("rule", rule).withColumn("in_tests", tests)
    order = ["rule", "in_tests", F.char_length("display_name"), "abs_path", "def_line", "display_name"]
    return ranked(found, order, limit if limit > 0 else 10)


def reference_family(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """seeds: symbol. The seeds and what refers to them or they refer to, each once."""
    refs = edges.where("kind = 'reference'")
    out = refs.join(seeds, F.col("src_symbol") == F.col("symbol"), "left_semi").select(F.col("dst_symbol").alias("symbol"))
    back = refs.join(seeds, F.col("dst_symbol") == F.col("symbol"), "left_semi").select(F.col("src_symbol").alias("symbol"))
    return seeds.select("symbol").union(out).union(back).distinct()


def list_references(occurrences: DataFrame, edges: DataFrame, seeds: DataFrame, limit: int | None = 10) -> DataFrame:
    """Occurrences, not definitions, of the seeds' reference family, by path, line and column."""
    family = reference_family(edges, seeds)
    out = occurrences.where(~F.col("is_definition")).join(family, "symbol", "left_semi")
    if "abs_path" not in out.columns:
        out = out.withColumn("abs_path", F.concat("root_path", F.lit("/d"), F.col("doc_id").cast("string"), F.lit(".txt")))
    out = out.select("symbol", "abs_path", "line", "col", "syntax_kind")
    return out if limit is None else out.orderBy("abs_path", "line", "col").limit(limit if limit > 0 else 10)


def definition_chunks(chunks: DataFrame) -> DataFrame:
    """Each primary symbol's first chunk."""
    return first_by(chunks.where("primary_symbol IS NOT NULL"), ["root_path", "primary_symbol"], ["start_line", "chunk_key"])


def linked_symbols(links: DataFrame, chunk_keys: DataFrame) -> DataFrame:
    """Links of some chunks, by chunk, weight and symbol."""
    return links.join(chunk_keys, "chunk_key", "left_semi").orderBy("chunk_key", F.desc("weight"), "symbol")


def neighbours(chunks: DataFrame, seed: DataFrame, limit: int) -> DataFrame:
    """Chunks of the seed's file nearest to it by start line. seed has one row, or none: abs_path, chunk_key, start_line."""
    one = F.broadcast(seed.select(F.col("abs_path").alias("s_path"), F.col("chunk_key").alias("s_key"), F.col("start_line").alias("s_line")).limit(1))
    near = chunks.join(one, F.col("abs_path") == F.col("s_path")).where("chunk_key <> s_key")
    near = near.withColumn("line_distance", F.abs(F.col("start_line") - F.col("s_line"))).drop("s_path", "s_key", "s_line")
    return near.orderBy("line_distance", "start_line", "chunk_key").limit(limit)


def _directions(chunks: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Chunks at the other end of the seeds' edges: seed, relation_kind, direction, and the hit."""
    hit = chunks.where("primary_symbol IS NOT NULL").select(*HIT)
    sides = []
    for direction, here, there in (("outgoing", "src_symbol", "dst_symbol"), ("incoming", "dst_symbol", "src_symbol")):
        ends = edges.join(seeds, F.col(here) == F.col("symbol"))
        ends = ends.select(F.col("symbol").alias("seed"), F.col("kind").alias("relation_kind"), F.lit(direction).alias("direction"), F.col(there).alias("end_symbol"))
        sides.append(ends.join(hit, F.col("end_symbol") == F.col("primary_symbol")).drop("end_symbol"))
    return sides[0].unionByName(sides[1])


def related_chunks(chunks: DataFrame, edges: DataFrame, seeds: DataFrame, limit: int, dedup_first: bool = False) -> DataFrame:
    """For each seed (symbol) its first `limit` related chunks by relation, direction, path and line, then
    each relation, direction and chunk once. dedup_first takes the limit of distinct ones instead."""
    found = _directions(chunks, edges, seeds)
    key = ["seed", "relation_kind", "direction", "chunk_key"]
    found = found.dropDuplicates(key) if dedup_first else found
    w = Window.partitionBy("seed").orderBy("relation_kind", "direction", "abs_path", "start_line", "chunk_key")
    found = found.withColumn("nr", F.row_number().over(w)).where(F.col("nr") <= limit)
    return found.dropDuplicates(key)
