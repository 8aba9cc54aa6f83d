"""Repositories and jobs: lists, reuse, live state, counts, quotas, evictions and row updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkloom.functions.paths import base_url

#: The states of a job in order, and the progress each stands for.
STAGES = ("queued", "cloning", "parsing", "embedding", "graphing", "ready")
PROGRESS = {"queued": 0, "cloning": 5, "parsing": 25, "embedding": 60, "graphing": 80, "ready": 100, "failed": 100}
PAGE = 50


def stage_rank(status: Column) -> Column:
    """The place of a state, from 0; failed is beyond all, unknown states are before all."""
    return F.coalesce(*[F.when(status == s, F.lit(i)) for i, s in enumerate(STAGES)], F.when(status == "failed", F.lit(len(STAGES))), F.lit(-1))


def page(repos: DataFrame, size: int = PAGE) -> DataFrame:
    """(id, url, status, created_at, more): the newest repositories of a page, and whether there are others."""
    top = repos.select("id", "url", "status", "created_at").orderBy(F.desc("created_at"), "id").limit(size + 1)
    w = Window.orderBy(F.desc("created_at"), "id")
    top = top.withColumns({"n": F.row_number().over(w), "all": F.count("*").over(Window.partitionBy(F.lit(1)))})
    return top.filter(F.col("n") <= size).select("id", "url", "status", "created_at", (F.col("all") > size).alias("more"))


def reusable(repos: DataFrame) -> DataFrame:
    """(address, id, status): for each address, in whatever spelling, the repository to use again: ready ones first, then the newest; failed ones never."""
    r = repos.filter("status <> 'failed' and url is not null").withColumn("address", base_url(F.col("url")))
    w = Window.partitionBy("address").orderBy(F.desc(stage_rank(F.col("status"))), F.desc("created_at"), "id")
    return r.withColumn("n", F.row_number().over(w)).filter("n = 1").select("address", "id", "status")


def with_live_state(repos: DataFrame, states: DataFrame) -> DataFrame:
    """(id, status, progress): each repository's row under what a running job last wrote, where that makes sense.

    states: (id, payload) of JSON objects with status and progress. Payloads that are no object, unknown states and a
    progress outside 0 to 100 are passed over.
    """
    live = states.select("id", F.from_json("payload", "status string, progress string", {"mode": "PERMISSIVE"}).alias("s")).select("id", F.col("s.status").alias("live"), F.expr("try_cast(s.progress as int)").alias("p"))
    live = live.groupBy("id").agg(F.max("live").alias("live"), F.max("p").alias("p"))
    known = F.when(stage_rank(F.col("live")) >= 0, F.col("live"))
    return repos.join(live, "id", "left").select("id", F.coalesce(known, "status").alias("status"), F.coalesce(F.when(F.col("p").between(0, 100), F.col("p")), "progress").alias("progress"))


def counts(chunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """(repo_id, chunks, symbols): distinct ids of each repository that has any."""
    c = chunks.groupBy("repo_id").agg(F.count_distinct("id").alias("chunks"))
    s = symbols.groupBy("repo_id").agg(F.count_distinct("id").alias("symbols"))
    return c.join(s, "repo_id", "full_outer").select("repo_id", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("symbols", F.lit(0)).alias("symbols"))


def over_quota(requests: DataFrame, limit: int) -> DataFrame:
    """(session, day, n): sessions with more requests on a day of UTC than the limit; a limit of 0 or less is none."""
    n = requests.filter("session is not null").groupBy("session", F.to_date("at").alias("day")).agg(F.count("*").alias("n"))
    return n.filter(F.col("n") > limit) if limit > 0 else n.filter(F.lit(False))


def evicted(directories: DataFrame, keep: int, protect: str | None = None) -> DataFrame:
    """(name): working directories to remove: all but the newest `keep`, of which the protected one is always one."""
    d = directories.filter(F.col("name") != protect) if protect else directories
    w = Window.orderBy(F.desc("modified"), "name")
    return d.withColumn("n", F.row_number().over(w)).filter(F.col("n") > max(0, keep - bool(protect))).select("name")


def merged(rows: DataFrame, updates: DataFrame, key: str = "id") -> DataFrame:
    """rows with those of updates in place of the ones of the same key; updates of unknown keys raise."""
    known = updates.join(rows.select(F.col(key), F.lit(True).alias("__known")), key, "left")
    checked = known.withColumn(key, F.when(F.col("__known"), F.col(key)).otherwise(F.raise_error(F.lit("no row of this key")))).drop("__known")
    return rows.join(updates.select(key), key, "left_anti").unionByName(checked.select(*rows.columns))


def missing_embeddings(chunks: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """(key, content): distinct contents whose embedding the cache (key, vector) does not hold; vectors of zeros count as not held."""
    from chunkloom.functions.keys import embedding_key

    wanted = chunks.filter("content is not null").select(embedding_key(model, F.col("content")).alias("key"), "content").groupBy("key").agg(F.min("content").alias("content"))
    held = cache.filter(F.exists("vector", lambda x: x != 0)).select("key")
    return wanted.join(held, "key", "left_anti")
