"""All named queries of the library."""

from sluice.plans import analytics_queries, change_queries, context_queries, proposal_queries, record_queries, request_queries, rule_queries, search_queries, span_queries, stored_queries, stream_queries, text_queries, written_queries  # noqa: F401
from sluice.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
