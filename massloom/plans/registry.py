"""The library's own queries by name, with the SQL each is checked against."""

from __future__ import annotations

from massloom.plans import envelope_queries, matches, protein_queries, report_queries, search_queries, spectrum_queries

_MODULES = (matches, protein_queries, spectrum_queries, report_queries, envelope_queries, search_queries)
QUERIES = {k: v for m in _MODULES for k, v in m.REGISTRY.queries.items()}
ORACLE_SQL = {k: v for m in _MODULES for k, v in m.REGISTRY.sql.items()}
