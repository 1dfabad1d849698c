"""All named queries of the citation and claim workloads with their DuckDB SQL."""

from __future__ import annotations

from glosswerk.plans import citation_queries, claim_queries, consistency_queries, reference_queries, source_queries

_PARTS = (citation_queries, claim_queries, reference_queries, consistency_queries, source_queries)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
