"""Sparse, dense and hybrid retrieval, batched over queries.

Queries are rows (query_id, repo_id, text or vector); a single question is a batch of one. Statistics are those of the
query's repository, over all of its chunks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkloom.functions import paths, text, vectors
from chunkloom.operators import blocks, sieves
from chunkloom.session import cut, spread

K1, B = 1.2, 0.75
#: Both lists are cut to so many before they are merged; so many go to a reranker.
POOL, RERANK_POOL = 50, 16
RRF_K, DENSE_WEIGHT, SPARSE_WEIGHT = 60, 2.0, 1.0
#: Scores are rounded before they are compared, so that the order of a sum does not decide ties.
DIGITS = 9


def one_per_id(chunks: DataFrame, *columns: str) -> DataFrame:
    """The columns of each chunk once, however often it was delivered. Rows without an id are left out."""
    kept = list(dict.fromkeys(("id", *columns)))
    return chunks.select(*kept).filter("id is not null").groupBy("id").agg(*[F.min(c).alias(c) for c in kept if c != "id"])


def postings(documents: DataFrame) -> DataFrame:
    """(repo_id, doc_id, length, term, tf) of documents (repo_id, doc_id, text); documents without a token give no row."""
    d = documents.select("repo_id", "doc_id", text.tokenize(F.coalesce("text", F.lit(""))).alias("tokens"))
    d = d.select("repo_id", "doc_id", F.size("tokens").alias("length"), F.explode("tokens").alias("term"))
    return d.groupBy("repo_id", "doc_id", "length", "term").agg(F.count("*").alias("tf"))


def corpus_stats(documents: DataFrame) -> DataFrame:
    """(repo_id, n, mean_length) over all documents, empty ones included."""
    d = documents.select("repo_id", F.size(text.tokenize(F.coalesce("text", F.lit("")))).alias("length"))
    return d.groupBy("repo_id").agg(F.count("*").alias("n"), (F.sum("length") / F.count("*")).alias("mean_length"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25(queries: DataFrame, documents: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, repo_id, doc_id, score) of every document of the query's repository with a positive score.

    queries: (query_id, repo_id, text); documents: (repo_id, doc_id, text). Texts are tokenised once: what is kept of them
    are the terms that are asked for and one row a document for the statistics, cut off in the shared folder. A query
    term counts once; a term no document has is skipped. Null texts are empty. Raises on k1 <= 0 or b outside 0 to 1.
    """
    if k1 <= 0:
        raise ValueError("k1 must be greater than zero")
    if not 0 <= b <= 1:
        raise ValueError("b must be between zero and one")
    asked = queries.select("query_id", "repo_id", F.explode(text.query_terms(F.coalesce("text", F.lit("")))).alias("term"))
    repos = queries.select("repo_id").distinct().select("repo_id", F.lit("").alias("term"))  # no token is empty
    wanted = asked.select("repo_id", "term").distinct().unionByName(repos)
    tokens = text.tokenize(F.coalesce("text", F.lit("")))
    d = documents.select("repo_id", "doc_id", tokens.alias("tokens")).select("repo_id", "doc_id", F.size("tokens").alias("length"), F.explode(F.array_append("tokens", F.lit(""))).alias("term"))
    kept = cut(d.join(wanted, ["repo_id", "term"], "left_semi").groupBy("repo_id", "doc_id", "length", "term").agg(F.count("*").alias("tf")))
    stats = kept.filter("term = ''").groupBy("repo_id").agg(F.sum("tf").alias("n"), (F.sum(F.col("length") * F.col("tf")) / F.sum("tf")).alias("mean_length"))
    tf = kept.filter("term <> ''")
    df = tf.groupBy("repo_id", "term").agg(F.count("*").alias("df"))
    weights = df.join(stats, "repo_id").select("repo_id", "term", "mean_length", idf(F.col("n"), F.col("df")).alias("idf"))
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean_length")))
    weighed = tf.join(weights, ["repo_id", "term"]).select("repo_id", "term", "doc_id", part.alias("part"))
    scores = weighed.join(asked, ["repo_id", "term"]).groupBy("query_id", "repo_id", "doc_id").agg(F.round(F.sum("part"), DIGITS).alias("score"))
    return scores.filter("score > 0")


def ranked(scores: DataFrame, order: list[Column], limit: int | None = None, by: str = "query_id", name: str = "rank") -> DataFrame:
    """Rows with their place in the order, per query; the limit is applied on the map side already."""
    out = scores.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return out if limit is None else out.filter(F.col(name) <= limit)


def chunk_documents(chunks: DataFrame) -> DataFrame:
    """The documents that are searched: (repo_id, doc_id, text) of each chunk once."""
    c = one_per_id(chunks, "repo_id", "symbol_name", "file_path", "signature", "content")
    return c.select("repo_id", F.col("id").alias("doc_id"), text.document_text(*[F.col(x) for x in ("symbol_name", "file_path", "signature", "content")]).alias("text"))


def texts_in_place(chunks: DataFrame) -> DataFrame:
    """(id, repo_id, file_path, start_line, text): the text of each chunk once, as of one_per_id().

    Only chunks whose id may have come more than once are shuffled, by a sieve of such ids.
    """
    columns = ("repo_id", "symbol_name", "file_path", "signature", "content", "start_line")
    c = spread(chunks.select("id", *columns).filter("id is not null"), "id")
    c = sieves.marked(c, sieves.repeated(chunks, "id"), "again", "id")
    c = c.filter("not again").select("id", *columns).unionByName(one_per_id(c.filter("again"), *columns).select("id", *columns))
    return c.filter("repo_id is not null").select("id", "repo_id", "file_path", "start_line", text.document_text(*[F.col(x) for x in ("symbol_name", "file_path", "signature", "content")]).alias("text"))


def counts_of(chunks: DataFrame) -> DataFrame:
    return chunks.filter("repo_id is not null").groupBy("repo_id").agg(F.count("*").alias("n"))


def sparse_candidates(queries: DataFrame, chunks: DataFrame, limit: int = POOL) -> DataFrame:
    """sparse_search() without places: the best chunks of each block, and so at least the best of all."""
    asked = cut(queries.filter("repo_id is not null").select("query_id", "repo_id", F.explode(text.query_terms(F.coalesce("text", F.lit("")))).alias("term")))
    counts = counts_of(chunks)
    d = cut(blocks.packed(blocks.counted(texts_in_place(chunks), asked), counts))
    stats = d.groupBy("repo_id").agg(F.sum("n").alias("n"), (F.sum("length") / F.sum("n")).alias("mean_length"))
    each = d.select("repo_id", F.explode(F.arrays_zip("terms", "dfs")).alias("x"))
    df = each.groupBy("repo_id", F.col("x.terms").alias("term")).agg(F.sum("x.dfs").alias("df"))
    weighed = asked.join(df, ["repo_id", "term"]).join(stats, "repo_id").select("query_id", "repo_id", "term", "mean_length", idf(F.col("n"), F.col("df")).alias("idf"))
    kinds = [("query_id", queries.schema["query_id"].dataType), *[(c, chunks.schema[c].dataType) for c in blocks.COLUMNS]]
    return blocks.meet(d.filter("size(terms) > 0").select("repo_id", "part", "terms", "body"), weighed, counts, kinds, "sparse_score", blocks.best_by_terms(limit, K1, B))


def sparse_search(queries: DataFrame, chunks: DataFrame, limit: int = POOL) -> DataFrame:
    """(query_id, id, repo_id, file_path, start_line, sparse_score, rank): the best chunks by BM25; ties by file, line and id.

    Scores are those of bm25(). A text is counted where it lies, unless its id came more than once; what goes on are the
    counts of terms that may be asked for in its repository, packed into blocks which meet the queries of the repository.
    """
    rows = sparse_candidates(queries, chunks, limit)
    return ranked(rows, [F.desc("sparse_score"), F.asc("file_path"), F.asc("start_line"), F.asc("id")], limit)


def dense_candidates(queries: DataFrame, chunks: DataFrame, dim: int, limit: int = POOL) -> DataFrame:
    """dense_search() without places: the nearest chunks of each block, and so at least the nearest of all."""
    c = chunks.filter(vectors.is_valid(F.col("embedding"), dim) & F.col("id").isNotNull() & F.col("repo_id").isNotNull()).select("id", "repo_id", "file_path", "start_line", "embedding")
    q = queries.filter(vectors.is_valid(F.col("vector"), dim)).select("query_id", "repo_id", vectors.unit(F.col("vector")).alias("vector"))
    counts = counts_of(chunks).withColumn("n", F.col("n") * -(-dim // blocks.WIDTH))
    kinds = [("query_id", queries.schema["query_id"].dataType), *[(x, chunks.schema[x].dataType) for x in blocks.COLUMNS]]
    return blocks.meet(blocks.in_blocks(c, counts), q, counts, kinds, "dense_score", blocks.best_by_cosine(limit))


def dense_search(queries: DataFrame, chunks: DataFrame, dim: int, limit: int = POOL) -> DataFrame:
    """(query_id, id, repo_id, file_path, start_line, dense_score, rank): the chunks nearest by cosine, exactly; ties by id.

    An id counts once, with the nearest of its vectors and the last of its places where it came with several. Each
    vector is shuffled once, to the block of its repository in which it meets all queries, of which the best go on.
    queries: (query_id, repo_id, vector). Vectors that are null, of another length or all zero take no part; a query
    with such a vector finds nothing.
    """
    return ranked(dense_candidates(queries, chunks, dim, limit), [F.desc("dense_score"), F.asc("id")], limit)


LISTED = ("query_id", "id", "repo_id", "file_path", "start_line")


def fuse(sparse: DataFrame, dense: DataFrame, dense_weight: float = DENSE_WEIGHT, sparse_weight: float = SPARSE_WEIGHT) -> DataFrame:
    """Weighted reciprocal rank fusion of two ranked lists: every chunk of either, with place `rank`.

    A chunk that a list lacks has score 0 there and gains nothing from it. Ties: dense, then sparse score, then file
    and line, all descending.
    """
    rows = _both(sparse.withColumnRenamed("sparse_score", "score"), dense.withColumnRenamed("dense_score", "score"))
    return _fused(rows, dense_weight, sparse_weight)


def fuse_candidates(sparse: DataFrame, dense: DataFrame, limit: int = POOL, dense_weight: float = DENSE_WEIGHT, sparse_weight: float = SPARSE_WEIGHT) -> DataFrame:
    """fuse() of the ranked lists of two searches, from their candidates: both kinds are shuffled once, to their query."""
    rows = _both(sparse.withColumnRenamed("sparse_score", "score"), dense.withColumnRenamed("dense_score", "score"))
    place = [F.when(F.col("sparse"), F.col(c)) for c in ("file_path", "start_line")]  # dense ties fall to the id alone
    w = Window.partitionBy("query_id", "sparse").orderBy(F.desc("score"), *[c.asc() for c in place], F.asc("id"))
    return _fused(rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit), dense_weight, sparse_weight)


def _both(sparse: DataFrame, dense: DataFrame) -> DataFrame:
    rows = sparse.withColumn("sparse", F.lit(True)).unionByName(dense.withColumn("sparse", F.lit(False)))
    return rows.repartition("query_id")


def _fused(rows: DataFrame, dense_weight: float, sparse_weight: float) -> DataFrame:
    """rows: (…LISTED, sparse, score, rank), partitioned by query_id, as is all that follows."""
    of = lambda c, sparse: F.max(F.when(F.col("sparse") == sparse, F.col(c)))
    both = rows.groupBy("query_id", "id").agg(
        *[F.coalesce(of(c, True), of(c, False)).alias(c) for c in LISTED[2:]],
        F.coalesce(of("score", True), F.lit(0.0)).alias("sparse_score"),
        F.coalesce(of("score", False), F.lit(0.0)).alias("dense_score"),
        F.min(F.when(F.col("sparse"), F.col("rank"))).alias("s_rank"),
        F.min(F.when(~F.col("sparse"), F.col("rank"))).alias("d_rank"),
    )
    gain = F.coalesce(dense_weight / (RRF_K + F.col("d_rank")), F.lit(0.0)) + F.coalesce(sparse_weight / (RRF_K + F.col("s_rank")), F.lit(0.0))
    out = both.withColumn("fused_score", F.round(gain, 12)).drop("s_rank", "d_rank")
    return ranked(out, [F.desc(c) for c in ("fused_score", "dense_score", "sparse_score", "file_path", "start_line")] + [F.asc("id")])


def identity_score() -> Column:
    """The score where no reranker runs: the first of fused, dense and sparse that is not 0."""
    return F.coalesce(F.nullif(F.col("fused_score"), F.lit(0.0)), F.nullif(F.col("dense_score"), F.lit(0.0)), F.col("sparse_score"))


def rerank(candidates: DataFrame, model: Callable[[DataFrame], DataFrame] | None = None, pool: int = RERANK_POOL) -> DataFrame:
    """Candidates in their final order, with rerank_score and `rank`.

    Without a model all stay, in the order they had. A model gets the best `pool` of each query and returns them with a
    column rerank_score; ties then fall to the fused, sparse and dense scores, file and line, all descending.
    """
    if model is None:
        return candidates.withColumn("rerank_score", identity_score())
    keys = [F.desc(c) for c in ("fused_score", "sparse_score", "dense_score", "file_path", "start_line")] + [F.asc("id")]
    best = ranked(candidates.drop("rank"), keys, pool).drop("rank")
    return ranked(model(best), [F.desc("rerank_score"), *keys])


def take(candidates: DataFrame, k: int, keep_tests: Column | None = None) -> DataFrame:
    """The first k of each query after tests are left out; the filter works on finished places, so fewer may remain."""
    kept = candidates.filter(~paths.is_test_path(F.col("file_path")) | (F.lit(False) if keep_tests is None else keep_tests))
    return ranked(kept.withColumnRenamed("rank", "place"), [F.asc("place")], k).drop("place")
