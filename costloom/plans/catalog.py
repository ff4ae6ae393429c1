"""Registry of the engine's queries: name -> (spark, sf_dir) -> DataFrame, and the SQL they equal."""

from __future__ import annotations

from costloom.plans import cost_queries, ops_queries, text_queries

_MODULES = (cost_queries, text_queries, ops_queries)
QUERIES: dict = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
