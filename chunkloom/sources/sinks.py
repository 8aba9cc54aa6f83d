"""Where results go: revisions of an index, append-only runs, caches, job states, artifacts and queues.

A revision of a repository is written as partitions of its own and becomes visible by one row of the manifest, so readers
see the chunks, symbols and edges of one revision or of the one before, never a mixture.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

TABLES = ("chunks", "symbols", "edges")
MANIFEST = "manifest"
JOB_DAYS = 7


def file_system(spark: SparkSession, path: str):
    """(file system, path) of any address that Spark can read, local or not."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = file_system(spark, path)
    return fs.exists(at)


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """(repo_id, revision): the newest published revision of each repository."""
    path = f"{root}/{MANIFEST}"
    schema = "repo_id string, revision int, rows map<string,bigint>, published_at timestamp"
    m = spark.read.schema(schema).json(path) if exists(spark, path) else spark.createDataFrame([], schema)
    return m.groupBy("repo_id").agg(F.max("revision").alias("revision"))


def publish(spark: SparkSession, root: str, repo_id: str, tables: dict[str, DataFrame], expected: dict[str, int] | None = None) -> int:
    """Write a repository's tables as its next revision and publish it; the revision.

    Where `expected` names row counts, others raise and nothing is published. A run that fails half-way leaves files that
    no reader sees, and may simply be repeated.
    """
    now = manifest(spark, root).filter(F.col("repo_id") == repo_id).first()
    revision = (now.revision if now else 0) + 1
    written = {}
    for name, df in tables.items():
        path = f"{root}/{name}/repo_id={repo_id}/revision={revision}"
        counted = Observation()
        df.drop("repo_id").observe(counted, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(path)
        written[name] = counted.get["rows"]
        if expected and name in expected and expected[name] != written[name]:
            raise ValueError(f"{name}: {written[name]} rows written, {expected[name]} expected")
    row = spark.createDataFrame([(repo_id, revision, written)], "repo_id string, revision int, rows map<string,bigint>")
    row.withColumn("published_at", F.current_timestamp()).coalesce(1).write.mode("append").json(f"{root}/{MANIFEST}")
    return revision


def published(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A table in the published revision of every repository; partitions of others are pruned."""
    t = spark.read.option("basePath", f"{root}/{table}").parquet(f"{root}/{table}").withColumn("repo_id", F.col("repo_id").cast("string"))
    return t.join(manifest(spark, root), ["repo_id", "revision"], "left_semi").drop("revision")


def evict(spark: SparkSession, root: str) -> list[str]:
    """Remove the revisions before the published one of every repository; the folders removed.

    Later revisions stay, since a run may be writing them. Only names of folders come to the driver.
    """
    now = {r.repo_id: r.revision for r in manifest(spark, root).toLocalIterator()}
    removed = []
    for table in TABLES:
        fs, at = file_system(spark, f"{root}/{table}")
        for folder in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(at, "repo_id=*/revision=*")) or []:
            path = folder.getPath()
            repo, revision = path.getParent().getName().partition("=")[2], int(path.getName().partition("=")[2])
            if revision < now.get(repo, 0):
                fs.delete(path, True)
                removed.append(path.toString())
    return sorted(removed)


def append_run(run: DataFrame, root: str) -> None:
    """Add rows to the provenance of index runs; there is no other way to write it."""
    run.write.mode("append").parquet(f"{root}/index_runs")


def write_cache(vectors: DataFrame, path: str) -> None:
    """Append (key, vector) rows to an embedding cache; readers take one row per key, see read_cache."""
    vectors.select("key", "vector").write.mode("append").parquet(path)


def read_cache(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """(key, vector) of a cache, each key once; vectors of another length or of zeros are misses."""
    c = spark.read.schema("key string, vector array<float>").parquet(path)
    return c.filter((F.size("vector") == dim) & F.exists("vector", lambda x: x != 0)).groupBy("key").agg(F.max("vector").alias("vector"))


def current_states(states: DataFrame, now: str | None = None) -> DataFrame:
    """The last state of each job that has not expired; finished jobs expire JOB_DAYS after they were written.

    states: (repo_id, status, progress, complete, written_at).
    """
    w = Window.partitionBy("repo_id").orderBy(F.desc("written_at"), F.desc("progress"))
    last = states.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")
    at = F.lit(now).cast("timestamp") if now else F.current_timestamp()
    return last.filter(~F.col("complete") | (F.col("written_at") + F.expr(f"interval {JOB_DAYS} days") > at))


def enqueue(jobs: DataFrame, path: str) -> None:
    """Append (repo_id, url) jobs to a queue directory as JSON."""
    jobs.select("repo_id", "url").write.mode("append").json(path)


def write_json(path: str, value: object) -> None:
    """A small report on the driver: UTF-8, two blanks, letters as they are."""
    Path(path).write_text(json.dumps(value, ensure_ascii=False, indent=2) + "\n", encoding="utf-8")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def replace_block(document: str, name: str, text: str) -> str:
    """A document with the text between its marks for name replaced; raises where the marks are missing."""
    begin, end = f"<!-- begin:{name} -->", f"<!-- end:{name} -->"
    if begin not in document or end not in document:
        raise ValueError(f"no marks for {name}")
    head, rest = document.split(begin, 1)
    return f"{head}{begin}\n{text.strip()}\n{end}{rest.split(end, 1)[1]}"


def is_stale(document: str, name: str, text: str) -> bool:
    return replace_block(document, name, text) != document
