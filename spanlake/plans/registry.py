"""All registered queries over the given tables, and the SQL that each has to agree with."""

from __future__ import annotations

from spanlake.plans import code as code_queries
from spanlake.plans import spans as span_queries

assert code_queries  # its queries register on import

#: Two queries with the most rows come first, so that nothing long runs ahead of them.
_FIRST = ("j02_orphan_or_root", "j03_service_edges")
QUERIES = {k: span_queries.QUERIES[k] for k in (*_FIRST, *(k for k in span_queries.QUERIES if k not in _FIRST))}
ORACLE_SQL = span_queries.ORACLE_SQL
