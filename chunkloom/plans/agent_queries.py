"""Queries of plans and answers for the questions of the evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.plans import agent
from chunkloom.session import table


def _questions(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "per_question").select("question_id", "repo_id", "question").filter("question is not null")
    return q.groupBy("question_id", "repo_id").agg(F.min("question").alias("query")).select(F.col("question_id").alias("query_id"), "repo_id", "query", F.lit("full").alias("mode"))


def agent_routes(spark: SparkSession, d: str) -> DataFrame:
    s = agent.specialised(F.col("query"))
    return _questions(spark, d).select("query_id", s["tool"].alias("tool"), F.to_json(s["args"]).alias("args"))


def agent_answers(spark: SparkSession, d: str) -> DataFrame:
    return agent.answered(_questions(spark, d), *[table(spark, d, t) for t in ("chunks", "symbols", "edges")])


QUERIES = {f.__name__: f for f in (agent_routes, agent_answers)}
SQL: dict[str, str] = {}
