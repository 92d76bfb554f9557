"""Registered queries of the library and their SQL counterparts."""

from __future__ import annotations

from . import bars_queries, review_queries, segment_queries, selection_queries

MODULES = (bars_queries, segment_queries, review_queries, selection_queries)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in MODULES for k, v in m.ORACLE_SQL.items()}


def flagship(spark, sf_dir):
    """Direction transitions of causal segments: bars, average true range, pivots, features, transitions."""
    return QUERIES["direction_transitions"](spark, sf_dir)
