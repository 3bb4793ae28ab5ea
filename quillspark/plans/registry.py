"""All queries of the reference's operators, by name, with their SQL."""

from . import analytics_queries, change_queries, distill_queries, graph_queries, link_queries, pack_queries, retrieval_queries, upkeep_queries

_MODULES = (retrieval_queries, graph_queries, link_queries, analytics_queries, pack_queries, upkeep_queries, change_queries, distill_queries)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}
