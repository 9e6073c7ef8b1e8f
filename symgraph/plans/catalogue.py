"""All registered queries and their oracles."""

from __future__ import annotations

from . import queries_model, queries_search, queries_tables

MODULES = (queries_model, queries_search, queries_tables)
QUERIES = {name: f for module in MODULES for name, f in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
