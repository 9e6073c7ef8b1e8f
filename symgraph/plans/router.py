"""Modes of search, and the queries that users ask: search, definition, references, context."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as fx
from ..operators import ranking, retrieval
from ..operators.build import StoredIndex
from ..sources import files

MODES = ("auto", "hybrid", "symbol", "semantic", "graph")
DEFAULT_LIMIT = 10


@dataclass(frozen=True)
class Plan:
    """Which signals a search has. Those it hasn't never enter the DataFrame's plan."""

    mode: str
    exact: bool = False
    symbols: bool = False
    semantic: bool = False
    graph: bool = False
    chunks: bool = False
    gate: bool = False


def plan_of(mode: str | None, query: str) -> Plan:
    mode = (mode or "auto").lower()
    if mode not in MODES:
        raise ValueError(f"invalid mode {mode!r}")
    if mode == "symbol":
        return Plan(mode, exact=True, symbols=True)
    if mode == "semantic":
        return Plan(mode, semantic=True)
    if mode == "graph":
        return Plan(mode, exact=True, symbols=True, semantic=True, graph=True)
    auto = mode == "auto"
    return Plan("hybrid", exact=not auto or fx.is_identifier(query), symbols=True, semantic=True, graph=True, chunks=True, gate=auto)


@dataclass
class Signals:
    exact: DataFrame | None = None
    symbols: DataFrame | None = None
    chunks: DataFrame | None = None
    semantic: DataFrame | None = None


class Router:
    """Queries on a stored index of one project root. vector_of gives a query's vector, or None for none.

    A search runs step by step. Each step's result is bounded by its limit and held by the driver, and the next one
    looks up what it names: as constants, which reach the scans of the store's tables.
    """

    def __init__(self, index: StoredIndex, vector_of=None):
        self.index = index
        self.vector_of = vector_of or (lambda query: None)

    def signals(self, query: str, limit: int, plan: Plan) -> Signals:
        out = Signals()
        if plan.exact:
            out.exact = retrieval.held(ranking.resolved_definition(retrieval.find_definitions(self.index.symbols, query, 8), query))
        if plan.symbols:
            out.symbols = retrieval.held(retrieval.search_symbols(self.index.symbols, query, limit))
        if plan.chunks:
            out.chunks = retrieval.held(retrieval.search_chunks(self.index.chunks, query, limit))
        vector = self.vector_of(query) if plan.semantic else None
        if vector is not None:
            found = retrieval.search_vectors(self.index.plain_chunks, self.index.vectors, vector, ranking.pool_size(limit))
            out.semantic = retrieval.held(ranking.above_floor(found))
        return out

    def boosts(self, signals: Signals) -> DataFrame:
        return retrieval.held(ranking.signal_boosts(self.index.plain_chunks, signals.exact, signals.symbols, signals.chunks, signals.semantic))

    def search(self, query: str, limit: int = DEFAULT_LIMIT, mode: str | None = None) -> DataFrame:
        """Ranked hits: the hit's columns, score, probability and rank."""
        plan = plan_of(mode, query)
        signals = self.signals(query, limit, plan)
        boosts = self.boosts(signals)
        if plan.graph:
            seeds = ranking.seed_symbols(boosts, self.index.links)
            boosts = boosts.unionByName(retrieval.held(ranking.graph_boosts(self.index.plain_chunks, self.index.edges, seeds, limit)))
        hits = ranking.final_ranking(boosts, limit)
        if plan.gate and signals.semantic is not None:
            lexical = [s for s in (signals.exact, signals.symbols, signals.chunks) if s is not None]
            hits = ranking.gated(hits, lexical, signals.semantic, len(fx.query_terms(query)))
        return hits

    def definition(self, query: str) -> DataFrame:
        """The definition that is meant with its first chunk, and whether that was ambiguous."""
        found = retrieval.held(ranking.resolved_definition(retrieval.find_definitions(self.index.symbols, query, 8), query))
        own = self.index.plain_chunks.where(retrieval.any_in("primary_symbol", found, "scip_symbol"))
        chunk = retrieval.definition_chunks(own).select(F.col("primary_symbol").alias("scip_symbol"), "chunk_key", "start_line", "end_line")
        return found.join(chunk, "scip_symbol", "left").select("display_name", "scip_symbol", "abs_path", "def_line", "ambiguous", "chunk_key", "start_line", "end_line")

    def candidates(self, query: str) -> DataFrame:
        """All that a definition may mean, the best first, where there are several."""
        found = retrieval.held(ranking.candidates(retrieval.find_definitions(self.index.symbols, query, 8), query))
        return found if found.count() > 1 else found.limit(0)

    def relations(self, query: str, limit: int = DEFAULT_LIMIT, with_low_value: bool = False) -> DataFrame:
        """Chunks related to the definition that is meant, without those of tests and generated code."""
        found = retrieval.held(ranking.resolved_definition(retrieval.find_definitions(self.index.symbols, query, 8), query))
        seeds = found.select(F.col("scip_symbol").alias("symbol"))
        near = self.index.edges.where(retrieval.any_in("src_symbol", seeds, "symbol") | retrieval.any_in("dst_symbol", seeds, "symbol"))
        chunks = self.index.plain_chunks
        chunks = chunks if with_low_value else chunks.where(~files.low_value(F.col("abs_path")))
        return retrieval.related_chunks(chunks, near, F.broadcast(seeds), limit)

    def references(self, query: str, limit: int | None = 10) -> DataFrame:
        """References of all definitions of just that name, else of the one that is meant."""
        found = retrieval.held(retrieval.find_definitions(self.index.symbols, query, 8))
        exact = found.where((F.col("display_name") == query) | (F.col("scip_symbol") == query))
        best = ranking.resolved_definition(found, query)
        seeds = retrieval.held(exact.select(F.col("scip_symbol").alias("symbol")).union(best.select("scip_symbol")).distinct())
        near = self.index.edges.where(retrieval.any_in("src_symbol", seeds, "symbol") | retrieval.any_in("dst_symbol", seeds, "symbol"))
        return retrieval.list_references(self.index.occurrences, near, F.broadcast(seeds), limit)

    def context(self, query: str, limit: int = DEFAULT_LIMIT, mode: str | None = None) -> dict[str, DataFrame]:
        """The seed, its definition and references, its neighbours in the file and what is related to it. A query
        without hits is an error."""
        seed = retrieval.held(ranking.context_seed(self.search(query, max(limit, 1), mode), query, fx.is_identifier(query)))
        if seed.isEmpty():
            raise LookupError(f"nothing is found for {query!r}")
        return {
            "seed": seed,
            "definition": self.definition(query),
            "references": self.references(query, limit),
            "neighbours": retrieval.neighbours(self.index.plain_chunks, seed.select("abs_path", "chunk_key", "start_line"), min(4, limit)),
            "related": ranking.seed_chunk_related(self.index.plain_chunks, self.index.edges, self.index.links, seed, limit),
        }
