"""Schemas of the tables, and validation of rows at the boundary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

REPOS = "id string, url string, commit_sha string, status string, progress int, error string, index_revision int, created_at timestamp_ntz, updated_at timestamp_ntz"
CHUNKS = "id string, repo_id string, file_path string, chunk_type string, parent_symbol string, symbol_name string, signature string, start_line int, end_line int, imports array<string>, content string, embedding array<float>"
SYMBOLS = "id string, repo_id string, qualified_name string, kind string, file_path string, line int, chunk_id string"
EDGES = "id string, repo_id string, source_id string, target_id string, edge_type string, source_line int"
INDEX_RUNS = "id string, repo_id string, status string, started_at timestamp, completed_at timestamp, corpus_commit_sha string, embedding_dim int, chunks_written int, symbols_written int, edges_written int, skipped_files array<string>, failure_reason string, chunks_with_nonzero_embedding int"
QUESTIONS = "id string, repo_id string, question string, taxonomy string, gt_chunk_ids array<string>, gt_targets array<struct<file_path:string,symbol_name:string,start_line:int,end_line:int>>, gt_files array<string>, source string"
EVENTS = "query_id string, seq int, event string, payload string"

#: What the enumerated columns may hold.
STATUSES = ("queued", "cloning", "parsing", "embedding", "graphing", "ready", "failed")
CHUNK_TYPES = ("module_doc", "function", "class", "method")
SYMBOL_KINDS = ("module", "class", "function", "method")
EDGE_TYPES = ("calls", "imports", "inherits", "references")
EVENT_KINDS = ("thought", "tool_call", "tool_result", "answer_delta", "citation", "final_answer", "error")
MOST_URL, MOST_QUERY, MOST_TURNS = 2048, 4000, 100


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def require(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """df, which raises while it runs if any row breaks the condition; null counts as broken."""
    first = df.columns[0]
    return df.withColumn(first, F.when(F.coalesce(condition, F.lit(False)), F.col(first)).otherwise(F.raise_error(F.lit(message)).cast(df.schema[first].dataType)))


def valid_chunks(df: DataFrame, dim: int | None = None) -> DataFrame:
    """Chunks of a known type with lines in order and, where dim is given, embeddings of that length."""
    ok = F.col("chunk_type").isin(*CHUNK_TYPES) & (F.col("start_line") <= F.col("end_line"))
    if dim:
        ok = ok & (F.col("embedding").isNull() | (F.size("embedding") == dim))
    return require(df, ok, "a chunk has an unknown type, lines out of order or a vector of another length")


def valid_queries(df: DataFrame) -> DataFrame:
    return require(df, F.length("query").between(1, MOST_QUERY), f"a query must have 1 to {MOST_QUERY} characters")
