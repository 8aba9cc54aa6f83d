"""Queries that index the source files anew, and streams run as batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.operators import python_ast
from chunkloom.operators.repositories import STAGES
from chunkloom.plans import indexer
from chunkloom.session import table
from chunkloom.sources import files as S
from chunkloom.streaming import jobs


def _files(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "source_files").filter("file_path like '%.py' and source is not null")
    return f.select("repo_id", "file_path", "source").dropDuplicates(["repo_id", "file_path"])


def ast_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = indexer.chunk_table(_files(spark, d))
    return c.select("repo_id", "file_path", "chunk_type", "parent_symbol", "symbol_name", "signature", "start_line", "end_line", F.array_join("imports", "\n").alias("imports"))


def ast_warnings(spark: SparkSession, d: str) -> DataFrame:
    return python_ast.warnings_of(_files(spark, d))


def ast_symbols(spark: SparkSession, d: str) -> DataFrame:
    f = _files(spark, d)
    return indexer.symbol_table(python_ast.facts(f), indexer.chunk_table(f))


def ast_edges(spark: SparkSession, d: str) -> DataFrame:
    b = indexer.build(_files(spark, d))
    names = b["symbols"].select("id", "qualified_name")
    e = b["edges"].join(names.select(F.col("id").alias("source_id"), F.col("qualified_name").alias("source")), "source_id").join(names.select(F.col("id").alias("target_id"), F.col("qualified_name").alias("target")), "target_id")
    return e.select("repo_id", "source", "target", "edge_type", "source_line")


def _job_events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    stage = F.element_at(F.array(*[F.lit(s) for s in STAGES]), (F.pmod(F.col("event_id"), F.lit(len(STAGES))) + 1).cast("int"))
    return e.select(F.col("user_id").cast("string").alias("repo_id"), stage.alias("status"))


def job_stages(spark: SparkSession, d: str) -> DataFrame:
    return jobs.job_states(_job_events(spark, d))


def ttl_dedup(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type")
    return jobs.first_per_slot(e, ["user_id", "event_type"], "ts", 3600, "event_id").select("event_id")


def sse_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Every event as a block of a text stream per user, read back."""
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("query_id"), F.col("event_id").cast("int").alias("seq"), F.col("event_type").alias("event"), F.col("props").alias("payload"))
    t = S.encoded_events(e).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "").alias("text"))
    return S.decoded_events(t)


FUNCTIONS = (ast_chunks, ast_warnings, ast_symbols, ast_edges, job_stages, ttl_dedup, sse_round_trip)
QUERIES = {f.__name__: f for f in FUNCTIONS}

STAGE = "case event_id % 6 " + " ".join(f"when {i} then '{s}'" for i, s in enumerate(STAGES)) + " end"
SQL = {
    "job_stages": f"select cast(user_id as varchar) as repo_id, arg_max({STAGE}, event_id % 6) as status from events group by 1",
    "ttl_dedup": "select event_id from (select event_id, row_number() over (partition by user_id, event_type, floor(epoch_us(ts) / 3600000000) order by ts, event_id) as n from events) where n = 1",
    "sse_round_trip": "select cast(user_id as varchar) as query_id, row_number() over (partition by user_id order by event_id) - 1 as seq, event_type as event, props as payload from events",
}
