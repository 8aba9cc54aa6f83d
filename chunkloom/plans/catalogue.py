"""All core queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chunkloom.plans import agent_queries, answer_queries, graph_queries, index_queries, retrieval_queries, skew_queries

FLAGSHIP = "bm25_topk"
MODULES = (retrieval_queries, graph_queries, answer_queries, index_queries, agent_queries, skew_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
