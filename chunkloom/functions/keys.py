"""Cache keys. Arguments are written as JSON with sorted names before they are hashed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def embedding_key(model: str, text: Column) -> Column:
    return F.concat(F.lit(f"embed:{model}:"), F.sha2(text, 256))


def sorted_json(args: Column) -> Column:
    """A map of strings as JSON with its names in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(args))))


def tool_key(tool: Column, repo_id: Column, revision: Column, args: Column) -> Column:
    return F.concat(F.lit("tool:"), tool, F.lit(":"), repo_id, F.lit(":r"), revision.cast("string"), F.lit(":"), F.substring(F.sha2(sorted_json(args), 256), 1, 16))


def query_key(repo_id: Column, revision: Column, query: Column, history: Column) -> Column:
    """The key holds the revision too, so an answer of an older index is never given again."""
    text = F.concat_ws("\x1f", F.trim(query), F.coalesce(F.to_json(history), F.lit("[]")))
    return F.concat(F.lit("query:"), repo_id, F.lit(":r"), revision.cast("string"), F.lit(":"), F.substring(F.sha2(text, 256), 1, 32))
