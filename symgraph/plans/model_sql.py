"""The corpus model as DuckDB SQL, for the oracles: the same relations as sources.corpus and operators.derive."""

from __future__ import annotations

EDGES = "' ' || chr(9) || chr(13) || chr(10) || '.,:;!?()[]{}<>\"''`'"
KINDS = "['function', 'method', 'class', 'interface', 'type', 'variable', 'module']"
UP, LOW = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"


def fold(text: str) -> str:
    return f"translate({text}, {UP}, {LOW})"


def contains(text: str, query: str) -> str:
    return f"contains({fold(text)}, '{query.lower()}')"


def prefix(text: str, query: str) -> str:
    return f"starts_with({fold(text)}, '{query.lower()}')"


def model(source: str | None = None) -> str:
    """WITH and the common tables, without a SELECT."""
    where = f"WHERE source = '{source}'" if source else ""
    return f"""
WITH files AS (
  SELECT doc_id, '/corpus/' || source AS root_path, lang || '-text' AS adapter_id, 'd' || doc_id || '.txt' AS relative_path,
         '/corpus/' || source || '/d' || doc_id || '.txt' AS abs_path, lang AS language, text, string_split(text, chr(10)) AS ls
  FROM documents {where}
), lines AS (
  SELECT doc_id, root_path, CAST(unnest(range(len(ls))) AS INTEGER) AS line, unnest(ls) AS line_text FROM files
), w0 AS (
  SELECT doc_id, root_path, line, string_split(line_text, ' ') AS ws FROM lines
), w1 AS (
  SELECT doc_id, root_path, line, CAST(unnest(range(len(ws))) AS INTEGER) AS col, unnest(ws) AS word FROM w0
), words AS (
  SELECT * FROM (SELECT doc_id, root_path, line, col, lower(trim(word, {EDGES})) AS symbol FROM w1) WHERE strlen(symbol) >= 3
), definitions AS (
  SELECT root_path, symbol, doc_id, line, col FROM (
    SELECT *, row_number() OVER (PARTITION BY root_path, symbol ORDER BY doc_id, line, col) AS rn FROM words) WHERE rn = 1
), symbols AS (
  SELECT root_path, 'txt ' || symbol AS scip_symbol, symbol AS display_name, ({KINDS})[length(symbol) % 7 + 1] AS kind,
         root_path || '/d' || doc_id || '.txt' AS abs_path, doc_id, line AS def_line, col AS def_col,
         symbol || '()' AS signature, '' AS doc_summary
  FROM definitions
), o0 AS (
  SELECT w.*, d.symbol IS NOT NULL AS is_definition
  FROM words w LEFT JOIN definitions d ON w.root_path = d.root_path AND w.symbol = d.symbol AND w.doc_id = d.doc_id AND w.line = d.line AND w.col = d.col
), occurrences AS (
  SELECT *, NOT is_definition AND line = 0 AS is_import, NOT is_definition AND line > 0 AND col % 3 = 0 AS is_write,
         NOT is_definition AND line > 0 AND col % 3 = 1 AS is_read, CASE WHEN col % 2 = 0 THEN 'identifier' ELSE '' END AS syntax_kind
  FROM o0
), c0 AS (
  SELECT doc_id, root_path, abs_path, ls, 'module' AS kind, 0 AS start_line, CAST(len(ls) - 1 AS INTEGER) AS end_line FROM files
  UNION ALL
  SELECT doc_id, root_path, abs_path, ls, 'block', CAST(b * 5 AS INTEGER), CAST(least(b * 5 + 4, len(ls) - 1) AS INTEGER)
  FROM (SELECT *, unnest(range((len(ls) - 1) // 5 + 1)) AS b FROM files)
  UNION ALL
  SELECT doc_id, root_path, abs_path, ls, 'line', CAST(b AS INTEGER), CAST(b AS INTEGER) FROM (SELECT *, unnest(range(len(ls))) AS b FROM files)
), chunks AS (
  SELECT doc_id, root_path, abs_path, kind, start_line, end_line, 'd' || doc_id || '.txt:' || start_line || ':' || end_line || ':' || kind AS chunk_key,
         lower(trim(split_part(ls[start_line + 1], ' ', 1), {EDGES})) AS name,
         array_to_string(ls[start_line + 1:end_line + 1], chr(10)) AS text, ls[start_line + 1] AS header_text
  FROM c0
), prim AS (
  SELECT chunk_key, symbol AS primary_symbol FROM (
    SELECT c.chunk_key, d.symbol, row_number() OVER (PARTITION BY c.chunk_key
             ORDER BY CASE WHEN c.name <> '' AND d.symbol = c.name THEN 0 ELSE 1 END, d.line, d.col) AS rn
    FROM chunks c JOIN definitions d ON d.doc_id = c.doc_id AND d.line BETWEEN c.start_line AND c.end_line) WHERE rn = 1
), pchunks AS (
  SELECT c.*, p.primary_symbol,
         CASE WHEN coalesce(p.primary_symbol, c.name) <> '' THEN coalesce(p.primary_symbol, c.name) || ' is a ' || c.kind || ' in ' || c.abs_path || '.'
              ELSE 'A ' || c.kind || ' in ' || c.abs_path || '.' END || chr(10) || chr(10) || c.text AS retrieval_text
  FROM chunks c LEFT JOIN prim p ON p.chunk_key = c.chunk_key
), occ_roles AS (
  SELECT doc_id, line, col, symbol, 'defines' AS role, 1.0 AS weight FROM occurrences WHERE is_definition
  UNION ALL SELECT doc_id, line, col, symbol, 'imports', 0.65 FROM occurrences WHERE is_import
  UNION ALL SELECT doc_id, line, col, symbol, 'writes', 0.75 FROM occurrences WHERE is_write
  UNION ALL SELECT doc_id, line, col, symbol, 'reads', 0.6 FROM occurrences WHERE is_read
  UNION ALL SELECT doc_id, line, col, symbol, 'uses', 0.55 FROM occurrences
            WHERE NOT (is_definition OR is_import OR is_write OR is_read) OR syntax_kind LIKE 'identifier%'
), links AS (
  SELECT DISTINCT c.chunk_key, r.symbol, r.role, CAST(r.weight AS DOUBLE) AS weight
  FROM (SELECT DISTINCT doc_id, line, symbol, role, weight FROM occ_roles) r
  JOIN chunks c ON c.doc_id = r.doc_id AND r.line BETWEEN c.start_line AND c.end_line
), around AS (
  SELECT doc_id, line, primary_symbol AS enclosing FROM (
    SELECT l.doc_id, l.line, c.primary_symbol, row_number() OVER (PARTITION BY l.doc_id, l.line ORDER BY c.end_line - c.start_line, c.start_line, c.chunk_key) AS rn
    FROM (SELECT DISTINCT doc_id, line FROM occurrences) l
    JOIN pchunks c ON c.doc_id = l.doc_id AND l.line BETWEEN c.start_line AND c.end_line AND c.kind <> 'line' AND c.primary_symbol IS NOT NULL) WHERE rn = 1
), inner_occ AS (
  SELECT o.*, a.enclosing FROM occurrences o JOIN around a ON a.doc_id = o.doc_id AND a.line = o.line WHERE a.enclosing <> o.symbol
), occurrence_edges AS (
  SELECT c.primary_symbol AS src_symbol, o.symbol AS dst_symbol, 'imports' AS kind
  FROM occurrences o JOIN pchunks c ON c.doc_id = o.doc_id AND c.kind = 'module' AND c.primary_symbol IS NOT NULL WHERE o.is_import
  UNION SELECT enclosing, symbol, 'defines' FROM inner_occ WHERE is_definition AND NOT is_import
  UNION SELECT enclosing, symbol, 'writes' FROM inner_occ WHERE is_write
  UNION SELECT enclosing, symbol, 'reads' FROM inner_occ WHERE is_read
  UNION SELECT enclosing, symbol, 'uses' FROM inner_occ WHERE NOT (is_definition OR is_import OR is_read OR is_write)
), edges AS (
  SELECT src_symbol, dst_symbol, kind FROM occurrence_edges
  UNION ALL SELECT a.display_name, b.display_name, 'reference' FROM symbols a JOIN symbols b ON a.root_path = b.root_path AND a.display_name = b.display_name || 's'
  UNION ALL SELECT DISTINCT m.primary_symbol, b.primary_symbol, 'contains' FROM pchunks m JOIN pchunks b ON m.doc_id = b.doc_id
            WHERE m.kind = 'module' AND b.kind = 'block' AND m.primary_symbol <> b.primary_symbol
)"""


def term_scores(terms: list[str]) -> str:
    one = lambda t: f" + CASE WHEN {contains('retrieval_text', t)} THEN 1.25 ELSE 0.0 END + CASE WHEN {contains('header_text', t)} THEN 0.75 ELSE 0.0 END"
    return "".join(one(t) for t in terms)


def lexical_chunks(query: str, terms: list[str], limit: int) -> str:
    where = " OR ".join([contains("retrieval_text", query), prefix("name", query), contains("header_text", query), contains("text", query)] + [contains("retrieval_text", t) for t in terms])
    return f"""lexical_chunks AS (
  SELECT *, row_number() OVER (ORDER BY score DESC, start_line, abs_path, chunk_key) - 1 AS rank FROM (
    SELECT *, CAST(CASE WHEN {contains('retrieval_text', query)} THEN 8.0 ELSE 0.0 END + CASE WHEN {prefix('name', query)} THEN 4.0 ELSE 0.0 END
      + CASE WHEN {contains('header_text', query)} THEN 3.0 ELSE 0.0 END + CASE WHEN {contains('text', query)} THEN 2.0 ELSE 0.0 END{term_scores(terms)} AS DOUBLE) AS score
    FROM pchunks WHERE {where})
  QUALIFY rank < {limit}
)"""


def lexical_symbols(query: str, limit: int, name: str = "lexical_symbols", table: str = "symbols") -> str:
    return f"""{name} AS (
  SELECT *, row_number() OVER (ORDER BY score DESC, length(display_name), display_name, root_path) - 1 AS rank FROM (
    SELECT *, CAST(CASE WHEN display_name = '{query}' THEN 1.0 WHEN scip_symbol = '{query}' THEN 0.98 WHEN {prefix('display_name', query)} THEN 0.86
      WHEN {prefix('scip_symbol', query)} THEN 0.82 WHEN {contains('doc_summary', query)} THEN 0.55 WHEN {contains('signature', query)} THEN 0.45 ELSE 0.30 END AS DOUBLE) AS score
    FROM {table} WHERE {contains('display_name', query)} OR {contains('scip_symbol', query)} OR {contains('doc_summary', query)} OR {contains('signature', query)})
  QUALIFY rank < {limit}
)"""


def found_definitions(query: str, limit: int, name: str = "found", table: str = "symbols") -> str:
    return f"""{name} AS (
  SELECT *, row_number() OVER (ORDER BY rule, in_tests, length(display_name), abs_path, def_line, display_name) - 1 AS rank FROM (
    SELECT *, CASE WHEN display_name = '{query}' THEN 0 WHEN scip_symbol = '{query}' THEN 1 WHEN {prefix('display_name', query)} THEN 2 ELSE 3 END AS rule,
      CASE WHEN abs_path LIKE '%/tests/%' THEN 1 ELSE 0 END AS in_tests
    FROM {table} WHERE {contains('display_name', query)} OR {contains('scip_symbol', query)})
  QUALIFY rank < {limit}
)"""


def resolved(query: str, found: str = "found") -> str:
    return f"""resolved AS (
  SELECT * FROM (
    SELECT *, count(*) OVER () > 1 AS ambiguous,
      CASE WHEN abs_path <> '' THEN 10.0 ELSE 0.0 END
      + CASE kind WHEN 'function' THEN 5.0 WHEN 'method' THEN 5.0 WHEN 'class' THEN 4.0 WHEN 'interface' THEN 3.5 WHEN 'type' THEN 3.0 WHEN 'variable' THEN 2.0 WHEN 'module' THEN 1.0 ELSE 0.0 END
      + CASE WHEN doc_summary <> '' THEN 1.0 ELSE 0.0 END + 1.0 AS specificity
    FROM (SELECT *, display_name = '{query}' OR scip_symbol = '{query}' AS exact, sum(CASE WHEN display_name = '{query}' OR scip_symbol = '{query}' THEN 1 ELSE 0 END) OVER () AS n_exact FROM {found})
    WHERE n_exact = 0 OR exact)
  ORDER BY specificity DESC, rank LIMIT 1
)"""


DEFINITION_CHUNKS = """definition_chunks AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY root_path, primary_symbol ORDER BY start_line, chunk_key) AS rn FROM pchunks WHERE primary_symbol IS NOT NULL) WHERE rn = 1
)"""


def semantic(vec_id: int, pool: int) -> str:
    return f"""near AS (
  SELECT e.vec_id, list_distance(CAST(e.embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = {vec_id})) AS distance
  FROM embeddings e WHERE e.vec_id IN (SELECT doc_id FROM files) ORDER BY distance, vec_id LIMIT {pool}
), near_hits AS (
  SELECT c.*, n.distance, row_number() OVER (ORDER BY n.distance, c.start_line, c.chunk_key) - 1 AS rank,
         CASE WHEN n.distance <= 0 THEN 1.0 ELSE 1.0 / (1.0 + n.distance) END AS similarity
  FROM near n JOIN pchunks c ON c.doc_id = n.vec_id AND c.kind = 'module'
), semantic AS (
  SELECT * FROM (SELECT *, max(similarity) OVER () AS best FROM near_hits) WHERE similarity >= greatest(0.20, 0.70 * best) OR rank = 0
)"""


HIT = "chunk_key, abs_path, kind, name, start_line, end_line, primary_symbol"


def boosts(exact: bool, symbols: bool, chunks: bool, near: bool) -> str:
    hit = "c.chunk_key, c.abs_path, c.kind, c.name, c.start_line, c.end_line, c.primary_symbol"
    parts = []
    if exact:
        parts.append(f"SELECT {hit}, 120.0::DOUBLE AS boost FROM resolved r JOIN definition_chunks c ON c.primary_symbol = r.display_name")
    if symbols:
        parts.append(f"SELECT {hit}, 70 * r.score / (r.rank + 1)::DOUBLE AS boost FROM lexical_symbols r JOIN definition_chunks c ON c.primary_symbol = r.display_name")
    if chunks:
        parts.append(f"SELECT {hit}, 28 / (c.rank + 1)::DOUBLE AS boost FROM lexical_chunks c")
    if near:
        parts.append(f"SELECT {hit}, 55 * c.similarity / (c.rank + 1)::DOUBLE AS boost FROM semantic c")
    return "boosts AS (\n  " + "\n  UNION ALL ".join(parts) + "\n)"


ROLE_WEIGHT = "CASE role WHEN 'defines' THEN 1.0 WHEN 'writes' THEN 0.8 WHEN 'reads' THEN 0.7 WHEN 'imports' THEN 0.65 WHEN 'uses' THEN 0.6 ELSE 0.5 END"
EDGE_WEIGHT = """(CASE relation_kind WHEN 'calls' THEN 1.0 WHEN 'reference' THEN 0.95 WHEN 'implementation' THEN 0.9 WHEN 'type_definition' THEN 0.8
  WHEN 'writes' THEN 0.7 WHEN 'reads' THEN 0.65 WHEN 'uses' THEN 0.6 WHEN 'imports' THEN 0.55 WHEN 'contains' THEN 0.4 ELSE 0.5 END * CASE WHEN direction = 'outgoing' THEN 0.9 ELSE 1.0 END)::DOUBLE"""

SEEDS = f"""fused AS (
  SELECT {HIT}, sum(boost) AS score FROM boosts GROUP BY ALL
), top_candidates AS (
  SELECT * FROM fused ORDER BY score DESC, chunk_key LIMIT 6
), seeds AS (
  SELECT symbol, max(weight) AS weight FROM (
    SELECT primary_symbol AS symbol, boost AS weight FROM boosts WHERE boost > 0 AND primary_symbol IS NOT NULL
    UNION ALL SELECT l.symbol, l.weight * (t.score / 120.0) * ({ROLE_WEIGHT})::DOUBLE FROM links l JOIN top_candidates t ON t.chunk_key = l.chunk_key)
  WHERE weight > 0 GROUP BY symbol ORDER BY round(max(weight), 9) DESC, symbol LIMIT 3
)"""


def related(seeds: str, limit: int, name: str = "related") -> str:
    """seeds: a relation with a column symbol."""
    return f"""{name} AS (
  SELECT DISTINCT ON (seed, relation_kind, direction, chunk_key) * FROM (
    SELECT *, row_number() OVER (PARTITION BY seed ORDER BY relation_kind, direction, abs_path, start_line, chunk_key) AS nr FROM (
      SELECT s.symbol AS seed, e.kind AS relation_kind, 'outgoing' AS direction, {HIT_C}
      FROM edges e JOIN {seeds} s ON e.src_symbol = s.symbol JOIN pchunks c ON c.primary_symbol = e.dst_symbol
      UNION ALL
      SELECT s.symbol, e.kind, 'incoming', {HIT_C}
      FROM edges e JOIN {seeds} s ON e.dst_symbol = s.symbol JOIN pchunks c ON c.primary_symbol = e.src_symbol)
    QUALIFY nr <= {limit})
)"""


HIT_C = "c.chunk_key, c.abs_path, c.kind, c.name, c.start_line, c.end_line, c.primary_symbol"
GRAPH_BOOSTS = f"""all_boosts AS (
  SELECT {HIT}, boost FROM boosts
  UNION ALL SELECT {HIT_C}, 18 * (s.weight / 120.0) * {EDGE_WEIGHT} FROM related c JOIN seeds s ON s.symbol = c.seed
)"""

RERANK = """(CASE WHEN kind = 'module' THEN 0.3 WHEN kind IN ('import_statement', 'import_from_statement') THEN 0.45
  WHEN kind IN ('function_definition', 'method_definition', 'class_definition', 'class_declaration', 'interface_declaration') THEN 1.15 ELSE 1.0 END
  * CASE WHEN greatest(end_line - start_line + 1, 1) > 40 THEN 40.0 / greatest(end_line - start_line + 1, 1)::DOUBLE ELSE 1.0 END)::DOUBLE"""


def final(source: str, limit: int) -> str:
    return f"""scored AS (
  SELECT {HIT}, round(sum(boost) * {RERANK}, 9) AS score FROM {source} GROUP BY {HIT}
), weighed AS (
  SELECT *, exp((score - max(score) OVER ()) / 4.0) AS w FROM scored
), hits AS (
  SELECT *, w / sum(w) OVER () AS probability, row_number() OVER (ORDER BY score DESC, abs_path, start_line, chunk_key) - 1 AS rank FROM weighed QUALIFY rank < {limit}
)"""


def hybrid(source: str, query: str, terms: list[str], vec_id: int, limit: int, exact: bool = True, symbols: bool = True, chunks: bool = True, near: bool = True, graph: bool = True) -> str:
    """The whole chain up to the relation hits."""
    parts = [model(source), DEFINITION_CHUNKS]
    if exact:
        parts += [found_definitions(query, 8), resolved(query)]
    if symbols:
        parts.append(lexical_symbols(query, limit))
    if chunks:
        parts.append(lexical_chunks(query, terms, limit))
    if near:
        parts.append(semantic(vec_id, min(max(6 * limit, 60), 200)))
    parts.append(boosts(exact, symbols, chunks, near))
    if graph:
        parts += [SEEDS, related("seeds", min(6, limit)), GRAPH_BOOSTS]
    parts.append(final("all_boosts" if graph else "boosts", limit))
    return ",\n".join(parts)
