"""Every query of the engine with its SQL."""

from __future__ import annotations

from .plans import corpus, evaluation, memory, operations, retrieval

_PARTS = (retrieval, memory, evaluation, corpus, operations)
QUERIES = {k: v for p in _PARTS for k, v in p.QUERIES.items()}
ORACLE_SQL = {k: v for p in _PARTS for k, v in p.ORACLE_SQL.items()}
