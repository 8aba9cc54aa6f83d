"""Queries of the subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.llm.answers import defects
from chunkloom.llm.docpairs import doc_pairs
from chunkloom.llm.handwritten import not_handwritten
from chunkloom.llm.leakage import leaks
from chunkloom.llm.mixing import mixed, shares, shortages
from chunkloom.llm.neighbours import similar, similar_pairs
from chunkloom.llm.secrets import redacted, secret_lines
from chunkloom.llm.sourcecheck import broken_files, broken_rates
from chunkloom.llm.subjects import composition, document_subjects
from chunkloom.session import table


def p2_pairs(spark: SparkSession, d: str) -> DataFrame:
    return doc_pairs(table(spark, d, "chunks"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return doc_pairs(table(spark, d, "chunks")).select("chunk_id").distinct()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return similar_pairs(table(spark, d, "chunks"))


def p3_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return similar(table(spark, d, "chunks")).withColumn("similarity", F.round("similarity", 5))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return defects(table(spark, d, "per_question")).filter("row_id is not null").select("row_id", "defect").distinct()


def p4_triggered(spark: SparkSession, d: str) -> DataFrame:
    return defects(table(spark, d, "per_question"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return broken_files(table(spark, d, "source_files")).select("repo_id", "file_path")


def p5_files(spark: SparkSession, d: str) -> DataFrame:
    return broken_files(table(spark, d, "source_files"))


def p5_rates(spark: SparkSession, d: str) -> DataFrame:
    return broken_rates(table(spark, d, "source_files"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return secret_lines(table(spark, d, "chunks"))


def p6_redacted(spark: SparkSession, d: str) -> DataFrame:
    return redacted(table(spark, d, "chunks")).distinct()


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return not_handwritten(table(spark, d, "chunks")).select("repo_id", "file_path")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return shortages(table(spark, d, "documents"), table(spark, d, "mix_targets")).filter("short").select("source")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return shares(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixed(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return document_subjects(*[table(spark, d, t) for t in ("documents", "subject_labels", "subjects")])


def p10_composition(spark: SparkSession, d: str) -> DataFrame:
    return composition(*[table(spark, d, t) for t in ("documents", "subject_labels", "subjects")])


QUERIES = {f.__name__: f for f in (p2_found, p2_pairs, p3_found, p3_neighbours, p4_found, p4_triggered, p5_found, p5_files, p5_rates, p6_found, p6_redacted, p7_found, p8_found, p9_found, p9_shares, p9_mix, p10_found, p10_composition)}

#: Any usual tokenizer gives the same p9_found, so words and marks are counted there.
SQL = {
    "p9_found": """
        with d as (select replace(lower(trim(source)), '-', '_') as source, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[0-9]|[^\\sA-Za-z0-9]')) as n from documents where trim(source) <> '')
        select t.source from mix_targets t left join (select source, sum(n) as n from d group by source) s on s.source = t.source
        where t.max_repeats * coalesce(s.n, 0) < t.target_share * (select sum(n) from d)""",
}
