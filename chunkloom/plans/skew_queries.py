"""Queries over the per-key operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chunkloom.operators.skew import Agg, degrees, heavy_owners, salted_aggregate
from chunkloom.session import table

OWNER_SHARE = 0.04


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return heavy_owners({t: table(spark, d, t) for t in ("chunks", "symbols", "edges")}, "repo_id", OWNER_SHARE)


def p1_chunk_profile(spark: SparkSession, d: str) -> DataFrame:
    aggs = [Agg("n_rows", "count"), Agg("n_chunks", "count_distinct", "id"), Agg("n_files", "count_distinct", "file_path"), Agg("n_names", "count_distinct", "symbol_name"), Agg("last_line", "max", "end_line")]
    return salted_aggregate(table(spark, d, "chunks"), "repo_id", aggs)


def p1_symbol_profile(spark: SparkSession, d: str) -> DataFrame:
    return salted_aggregate(table(spark, d, "symbols"), "repo_id", [Agg("n_rows", "count"), Agg("n_symbols", "count_distinct", "id"), Agg("n_names", "count_distinct", "qualified_name")])


def p1_degrees(spark: SparkSession, d: str) -> DataFrame:
    return degrees(table(spark, d, "edges"))


QUERIES = {f.__name__: f for f in (p1_found, p1_chunk_profile, p1_symbol_profile, p1_degrees)}

SQL = {
    "p1_found": " union all ".join(f"select '{t}' as table_name, repo_id from {t} where repo_id is not null group by repo_id having count(*) >= {OWNER_SHARE} * (select count(*) from {t})" for t in ("chunks", "symbols", "edges")),
    "p1_chunk_profile": "select repo_id, count(*) as n_rows, count(distinct id) as n_chunks, count(distinct file_path) as n_files, count(distinct symbol_name) as n_names, max(end_line) as last_line from chunks group by repo_id",
    "p1_symbol_profile": "select repo_id, count(*) as n_rows, count(distinct id) as n_symbols, count(distinct qualified_name) as n_names from symbols group by repo_id",
    "p1_degrees": """
        with e as (select distinct repo_id, source_id, target_id, edge_type, source_line from edges),
        x as (select repo_id, source_id as symbol_id, 0 as i, 1 as o from e union all select repo_id, target_id, 1, 0 from e)
        select repo_id, symbol_id, cast(sum(i) as bigint) as in_degree, cast(sum(o) as bigint) as out_degree
        from x where symbol_id is not null group by repo_id, symbol_id""",
}
