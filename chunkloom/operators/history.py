"""Conversations and evidence: bounded history, the symbol a follow-up means, merged and numbered evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chunkloom.functions.intents import best_symbol

TURNS, CHARS, TURN_CHARS = 6, 2000, 4000
EVIDENCE_SHOWN = 10


def bounded(turns: DataFrame, most_turns: int = TURNS, most_chars: int = CHARS, turn_chars: int = TURN_CHARS) -> DataFrame:
    """(conv_id, turn, role, content): the last turns that fit the budget, the newest served first and clipped to what is left.

    turns: (conv_id, turn, role, content). Blank contents take nothing and are left out; nulls count as blank.
    """
    recent = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    t = turns.withColumn("n", F.row_number().over(recent)).filter(F.col("n") <= most_turns)
    t = t.withColumn("content", F.substring(F.coalesce("content", F.lit("")), 1, turn_chars))
    used = F.coalesce(F.sum(F.length("content")).over(recent.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    t = t.withColumn("left", F.greatest(F.lit(0), most_chars - used))
    return t.select("conv_id", "turn", "role", F.substr(F.col("content"), F.lit(1), F.col("left").cast("int")).alias("content")).filter("content <> ''")


def recent_symbol(turns: DataFrame) -> DataFrame:
    """(conv_id, symbol): the name that the newest turn with one mentions, turns of the user first."""
    named = turns.withColumn("symbol", best_symbol(F.coalesce("content", F.lit("")))).filter("symbol is not null")
    w = Window.partitionBy("conv_id").orderBy(F.when(F.col("role") == "user", 0).otherwise(1), F.desc("turn"))
    return named.withColumn("n", F.row_number().over(w)).filter("n = 1").select("conv_id", "symbol")


def merged_evidence(observations: DataFrame) -> DataFrame:
    """(query_id, evidence_id, token, chunk_id, symbol, content, origins): evidence of all tools, each token once.

    observations: (query_id, ordinal, origin, token, chunk_id, symbol, content, score). The first chunk, symbol and
    content that are given win; origins keep the order in which they came. Rows with a score go before those without,
    by score; equal ones keep their order. Ids are C1, C2, …; beyond EVIDENCE_SHOWN the content is left out.
    """
    some = lambda c: F.when(F.col(c) != "", F.col(c))
    first = lambda c: F.min_by(some(c), F.when(some(c).isNotNull(), F.col("ordinal")))
    origins = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "origin"))), lambda x: x["origin"]))
    m = observations.groupBy("query_id", "token").agg(F.min("ordinal").alias("at"), first("chunk_id").alias("chunk_id"), first("symbol").alias("symbol"), first("content").alias("content"), origins.alias("origins"), F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), F.asc("at"))
    m = m.withColumn("n", F.row_number().over(w))
    return m.select("query_id", F.concat(F.lit("C"), F.col("n")).alias("evidence_id"), "token", "chunk_id", "symbol", F.when(F.col("n") <= EVIDENCE_SHOWN, F.coalesce("content", F.lit(""))).otherwise(F.lit("")).alias("content"), "origins")


def seeds(ranked: DataFrame, most: int = 3) -> DataFrame:
    """(query_id, file_path, symbol_name, start_line, place): the first distinct chunks of ranked (query_id, rank, …) rows."""
    d = ranked.groupBy("query_id", "file_path", "symbol_name", "start_line").agg(F.min("rank").alias("best"))
    w = Window.partitionBy("query_id").orderBy("best", "file_path", "symbol_name", "start_line")
    return d.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most).drop("best")


def graph_evidence(evidence: DataFrame, retrieved: DataFrame, tools: tuple[str, ...]) -> DataFrame:
    """(query_id, chunk_id): evidence that graph tools found and retrieval had not."""
    from_graph = evidence.filter(F.arrays_overlap("origins", F.array(*[F.lit(t) for t in tools])) & F.col("chunk_id").isNotNull())
    return from_graph.select("query_id", "chunk_id").distinct().join(retrieved.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")


def hydrated(evidence: DataFrame, chunks: DataFrame) -> DataFrame:
    """Evidence whose content is missing gets that of its chunk."""
    c = chunks.select(F.col("id").alias("chunk_id"), F.col("content").alias("found")).filter("chunk_id is not null").groupBy("chunk_id").agg(F.min("found").alias("found"))
    return evidence.join(c, "chunk_id", "left").withColumn("content", F.coalesce(F.when(F.col("content") != "", F.col("content")), "found", F.lit(""))).drop("found")
