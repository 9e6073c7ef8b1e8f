"""Fusion of search signals, graph expansion, reranking, probabilities and the choice of definitions and seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring as sx
from .retrieval import HIT, any_in, definition_chunks, held, ranked, related_chunks

CANDIDATES, SEEDS, SEED_SYMBOLS, RELATED = 6, 3, 4, 6
TEMPERATURE = 4.0
ABSOLUTE_FLOOR, RELATIVE_FLOOR = 0.20, 0.70
ONE_TERM_FLOOR, TERMS_FLOOR = 0.55, 0.44
CLIP_MASS, CLIP_NEXT = 0.90, 0.05
POOL_FACTOR, POOL_LEAST, POOL_MOST = 6, 60, 200


def everything():
    """The window over all rows: of hits and candidates only, of which there are few."""
    return Window.partitionBy()


def pool_size(limit: int) -> int:
    """Vectors to look at for a limit of hits."""
    return min(max(POOL_FACTOR * max(1, limit), POOL_LEAST), POOL_MOST)


def candidates(found: DataFrame, query: str) -> DataFrame:
    """Of find_definitions' rows those that may be meant, the most specific first, with place, and whether that is
    ambiguous. Exact names count alone if there are any."""
    exact = (F.col("display_name") == query) | (F.col("scip_symbol") == query)
    rows = found.withColumn("exact", exact).withColumn("n_exact", F.sum(F.col("exact").cast("int")).over(everything()))
    rows = rows.where((F.col("n_exact") == 0) | F.col("exact")).withColumn("ambiguous", F.count(F.lit(1)).over(everything()) > 1)
    end = F.coalesce("def_end_line", "def_line") if "def_end_line" in found.columns else F.col("def_line")
    score = sx.specificity(F.col("abs_path"), F.col("kind"), F.col("doc_summary"), F.col("def_line"), end)
    return rows.withColumn("specificity", score).orderBy(F.desc("specificity"), "rank")


def resolved_definition(found: DataFrame, query: str) -> DataFrame:
    """The first of candidates(): the definition that is meant, and whether that was ambiguous."""
    return candidates(found, query).limit(1)


def above_floor(hits: DataFrame) -> DataFrame:
    """Vector hits not far less similar than the best; the best itself in any case."""
    rows = hits.withColumn("similarity", sx.similarity(F.col("distance")))
    floor = F.greatest(F.lit(ABSOLUTE_FLOOR), RELATIVE_FLOOR * F.max("similarity").over(everything()))
    return rows.withColumn("floor", floor).where((F.col("similarity") >= F.col("floor")) | (F.col("rank") == 0)).drop("floor")


def passes_gate(n_lexical: int, best_similarity: float | None, n_terms: int) -> bool:
    """Whether there is enough evidence to show hits at all: something lexical, or one similar enough."""
    if n_lexical > 0:
        return True
    return best_similarity is not None and best_similarity >= (ONE_TERM_FLOOR if n_terms < 2 else TERMS_FLOOR)


def enough(similarity, n_terms: int):
    """passes_gate() of a similarity without anything lexical, as a column."""
    return similarity >= (ONE_TERM_FLOOR if n_terms < 2 else TERMS_FLOOR)


def gated(hits: DataFrame, lexical: list[DataFrame], semantic: DataFrame, n_terms: int) -> DataFrame:
    """hits if passes_gate(), as one plan: the gate is a row that hits are joined to."""
    rows = [x.select(F.lit(True).alias("ok")).limit(1) for x in lexical]
    rows.append(semantic.where("rank = 0").where(enough(sx.similarity(F.col("distance")), n_terms)).select(F.lit(True).alias("ok")).limit(1))
    gate = rows[0]
    for r in rows[1:]:
        gate = gate.union(r)
    return hits.join(F.broadcast(gate.distinct()), F.lit(True), "left_semi")


BOOST = "chunk_key string, abs_path string, kind string, name string, start_line int, end_line int, primary_symbol string, boost double"


def signal_boosts(chunks: DataFrame, exact: DataFrame | None, lexical_symbols: DataFrame | None, lexical_chunks: DataFrame | None, semantic: DataFrame | None) -> DataFrame:
    """A row a signal and chunk: the hit's columns and boost. Symbols stand for their definition chunks. The signals
    are held() lists; without any, no rows."""
    parts = []
    symbols = []
    if exact is not None:
        symbols.append(exact.select(F.col("scip_symbol").alias("primary_symbol"), F.lit(sx.EXACT_BOOST).alias("boost")))
    if lexical_symbols is not None:
        symbols.append(lexical_symbols.select(F.col("scip_symbol").alias("primary_symbol"), (70 * F.col("score") * sx.rank_weight(F.col("rank"))).alias("boost")))
    if symbols:
        wanted = symbols[0] if len(symbols) == 1 else symbols[0].unionByName(symbols[1])
        own = chunks.where(any_in("primary_symbol", wanted, "primary_symbol"))
        parts.append(definition_chunks(own).select(*HIT).join(F.broadcast(wanted), "primary_symbol").select(*HIT, "boost"))
    if lexical_chunks is not None:
        parts.append(lexical_chunks.select(*HIT, (28 * sx.rank_weight(F.col("rank"))).alias("boost")))
    if semantic is not None:
        parts.append(semantic.select(*HIT, (55 * sx.similarity(F.col("distance")) * sx.rank_weight(F.col("rank"))).alias("boost")))
    out = chunks.sparkSession.createDataFrame([], BOOST)
    for p in parts:
        out = out.unionByName(p)
    return out


def fused(boosts: DataFrame) -> DataFrame:
    return boosts.groupBy(*HIT).agg(F.sum("boost").alias("score"))


def seed_symbols(boosts: DataFrame, links: DataFrame, limit: int = SEEDS) -> DataFrame:
    """symbol and weight: the strongest of the signals' symbols and of those linked to the best candidates."""
    own = boosts.where("boost > 0 AND primary_symbol IS NOT NULL").select(F.col("primary_symbol").alias("symbol"), F.col("boost").alias("weight"))
    top = held(ranked(fused(boosts), [F.desc("score"), "chunk_key"], CANDIDATES).select("chunk_key", "score"))
    linked = links.where(any_in("chunk_key", top, "chunk_key")).join(F.broadcast(top), "chunk_key")
    weight = F.col("weight") * sx.seed_share(F.col("score")) * sx.role_weight(F.col("role"))
    linked = linked.select("symbol", weight.alias("weight"))
    out = own.unionByName(linked).where("weight > 0").groupBy("symbol").agg(F.max("weight").alias("weight"))
    return held(out.orderBy(F.desc(F.round("weight", 9)), "symbol").limit(limit))


def graph_boosts(chunks: DataFrame, edges: DataFrame, seeds: DataFrame, limit: int) -> DataFrame:
    """A row a relation of a seed: the hit's columns and boost."""
    weights = F.broadcast(seeds.select(F.col("symbol").alias("seed"), "weight"))  # SEEDS rows
    near = edges.where(any_in("src_symbol", seeds, "symbol") | any_in("dst_symbol", seeds, "symbol"))
    related = related_chunks(chunks, near, F.broadcast(seeds.select("symbol")), min(RELATED, limit)).join(weights, "seed")
    boost = 18 * sx.seed_share(F.col("weight")) * sx.edge_weight(F.col("relation_kind"), F.col("direction"))
    return related.select(*HIT, boost.alias("boost"))


def final_ranking(boosts: DataFrame, limit: int) -> DataFrame:
    """Summed, reranked, with probabilities over all candidates, cut to limit; rank from 0."""
    score = sx.reranked(F.col("score"), F.col("kind"), F.col("start_line"), F.col("end_line"))
    rows = fused(boosts).withColumn("score", F.round(score, 9))
    rows = rows.withColumn("probability", sx.softmax(F.col("score"), TEMPERATURE))
    return ranked(rows, [F.desc("score"), "abs_path", "start_line", "chunk_key"], limit)


def shares(rows: DataFrame, score, name: str, temperature: float = 1.0, by: str | None = None) -> DataFrame:
    """rows with their share of exp(score / temperature) among all, or all of the same `by`: by two aggregates, for
    tables of any size, where softmax() over a window would hold them in one task."""
    t = temperature if temperature > 0 else 1.0
    key = F.lit(0) if by is None else F.col(by)
    rows = rows.withColumns({"_s": score, "_by": key})
    top = rows.groupBy("_by").agg(F.max("_s").alias("_top"))
    weighed = rows.join(top.select(F.col("_by").alias("_b"), "_top"), F.col("_by").eqNullSafe(F.col("_b"))).drop("_b")
    weighed = weighed.withColumn("_w", F.exp((F.col("_s") - F.col("_top")) / t))
    total = weighed.groupBy("_by").agg(F.sum("_w").alias("_total"))
    out = weighed.join(total.select(F.col("_by").alias("_b"), "_total"), F.col("_by").eqNullSafe(F.col("_b")))
    return out.withColumn(name, F.col("_w") / F.col("_total")).drop("_s", "_by", "_b", "_top", "_w", "_total")


def clipped(hits: DataFrame) -> DataFrame:
    """hits: rank, probability. Cut after the rows that hold CLIP_MASS, if the next one has little; what is left is
    scaled to one. If some probability isn't positive they all stay."""
    w = Window.orderBy("rank")
    mass = F.sum("probability").over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = hits.withColumn("mass", mass).withColumn("next", F.lead("probability").over(w))
    cut = F.when((F.col("mass") >= CLIP_MASS) & (F.col("next") <= CLIP_NEXT), F.col("rank"))
    rows = rows.withColumn("last", F.min(cut).over(everything())).where(F.col("last").isNull() | (F.col("rank") <= F.col("last")))
    total, least = F.sum("probability").over(everything()), F.min("probability").over(everything())
    scaled = F.when(F.col("last").isNull() | (least <= 0), F.col("probability")).otherwise(F.col("probability") / total)
    return rows.withColumn("probability", scaled).drop("mass", "next", "last")


def context_seed(hits: DataFrame, query: str, identifier: bool) -> DataFrame:
    """The hit that a context is built around."""
    score = sx.context_seed_score(F.col("score"), F.col("kind"), F.col("name"), F.col("start_line"), F.col("end_line"), query, identifier)
    return hits.withColumn("seed_score", F.round(score, 9)).orderBy(F.desc("seed_score"), "rank").limit(1)


def seed_chunk_related(chunks: DataFrame, edges: DataFrame, links: DataFrame, seed: DataFrame, limit: int) -> DataFrame:
    """seed: chunk_key, one row at most. Chunks related to the symbols it is most linked to, each once, in the symbols' order."""
    own = links.where(any_in("chunk_key", held(seed.select("chunk_key")), "chunk_key"))
    own = own.groupBy("symbol").agg(F.max(F.col("weight") * sx.role_weight(F.col("role"))).alias("weight"))
    best = held(ranked(own, [F.desc(F.round("weight", 9)), "symbol"], SEED_SYMBOLS))
    near = edges.where(any_in("src_symbol", best, "symbol") | any_in("dst_symbol", best, "symbol"))
    related = related_chunks(chunks, near, F.broadcast(best.select("symbol")), min(RELATED, limit))
    related = related.join(F.broadcast(best.select(F.col("symbol").alias("seed"), F.col("rank").alias("seed_rank"))), "seed")
    first = Window.partitionBy("chunk_key").orderBy("seed_rank", "nr")
    related = related.withColumn("again", F.row_number().over(first)).where("again = 1").drop("again")
    return ranked(related, ["seed_rank", "nr"], limit)
