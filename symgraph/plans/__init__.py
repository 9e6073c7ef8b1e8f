"""Query planning: modes, and the catalogue of registered queries with their oracles."""
