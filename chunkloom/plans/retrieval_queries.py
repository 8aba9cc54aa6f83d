"""Retrieval queries over the tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.functions import keys, paths, text, vectors
from chunkloom.operators import retrieval as R
from chunkloom.session import spread, table

QUESTION = "how does the worker validate a token span before the queue is flushed"
DIM = 64


def _questions(spark: SparkSession, d: str) -> DataFrame:
    """Each question of the evaluation once: (query_id, repo_id, text)."""
    q = table(spark, d, "per_question").select("question_id", "repo_id", "question").filter("question is not null")
    return q.groupBy("question_id", "repo_id").agg(F.min("question").alias("text")).select(F.col("question_id").alias("query_id"), "repo_id", "text")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    """A query vector for each question: that of the first usable chunk of its repository."""
    c = table(spark, d, "chunks").filter(vectors.is_valid(F.col("embedding"), DIM))
    first = c.groupBy("repo_id").agg(F.min_by("embedding", "id").alias("vector"))
    return _questions(spark, d).join(first, "repo_id").select("query_id", "repo_id", "vector")


def tokenize_terms(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents").select(F.lit("all").alias("repo_id"), F.col("doc_id"), "text"), "doc_id")
    return R.postings(docs).select("doc_id", "term", "tf")


def bm25_corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return R.corpus_stats(R.chunk_documents(table(spark, d, "chunks"))).select("repo_id", "n", F.round("mean_length", 6).alias("mean_length"))


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents").select(F.lit("all").alias("repo_id"), "doc_id", "text"), "doc_id")
    q = spark.createDataFrame([(1, "all", QUESTION)], "query_id int, repo_id string, text string")
    best = R.bm25(q, docs).orderBy(F.desc("score"), "doc_id").limit(50)
    return best.select("doc_id", F.round("score", 6).alias("score"))


def bm25_batch(spark: SparkSession, d: str) -> DataFrame:
    s = R.sparse_search(_questions(spark, d), table(spark, d, "chunks"))
    return s.select("query_id", "id", "rank", F.round("sparse_score", 6).alias("score"))


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    probe = e.groupBy().agg(F.min_by("embedding", "vec_id").alias("vector"))
    q = probe.select(F.lit(1).alias("query_id"), F.lit("all").alias("repo_id"), "vector")
    rows = e.select(F.col("vec_id").cast("string").alias("id"), F.lit("all").alias("repo_id"), F.lit("").alias("file_path"), F.lit(0).alias("start_line"), "embedding")
    return R.dense_search(q, rows, DIM).select("id", "rank", F.round("dense_score", 6).alias("score"))


def dense_batch(spark: SparkSession, d: str) -> DataFrame:
    return R.dense_search(_vectors(spark, d), table(spark, d, "chunks"), DIM).select("query_id", "id", "rank", F.round("dense_score", 6).alias("score"))


def _hybrid(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks")
    return R.fuse_candidates(R.sparse_candidates(_questions(spark, d), c), R.dense_candidates(_vectors(spark, d), c, DIM))


def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    return _hybrid(spark, d).select("query_id", "id", "rank", F.round("fused_score", 9).alias("fused"))


def identity_rerank_testfilter(spark: SparkSession, d: str) -> DataFrame:
    q = _questions(spark, d).select("query_id", paths.is_about_tests(F.col("text")).alias("about_tests"))
    rows = R.rerank(_hybrid(spark, d)).join(q, "query_id")
    return R.take(rows, 5, F.col("about_tests")).select("query_id", "id", "rank", F.round("rerank_score", 9).alias("score"))


def keyword_queries(spark: SparkSession, d: str) -> DataFrame:
    return _questions(spark, d).select("query_id", F.array_join(text.keywords(F.col("text")), " ").alias("keywords"))


def cache_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("text is not null").select("doc_id", keys.embedding_key("stub", F.col("text")).alias("key"))


def url_spellings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "repos").select("id", paths.base_url(F.col("url")).alias("address")).distinct()


def test_paths(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "source_files").select("file_path").distinct()
    return f.select("file_path", paths.is_test_path(F.col("file_path")).alias("is_test"), paths.module_name(F.col("file_path")).alias("module"))


FUNCTIONS = (tokenize_terms, bm25_corpus_stats, bm25_topk, bm25_batch, dense_topk, dense_batch, hybrid_rrf, identity_rerank_testfilter, keyword_queries, cache_keys, url_spellings, test_paths)
QUERIES = {f.__name__: f for f in FUNCTIONS}


def sql_tokens(column: str) -> str:
    """The tokenizer as an expression of DuckDB, whose patterns have no look-ahead."""
    fold = lambda x: f"replace(lower({x}), 'ß', 'ss')"
    parts = r"regexp_extract_all(regexp_replace(regexp_replace(s, '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+')"
    segments = f"flatten(list_transform(string_split(r, '_'), lambda s: case when len({parts}) = 0 then [s] else {parts} end))"
    per_word = f"list_distinct(list_transform(list_concat([replace(r, '_', '')], {segments}), lambda x: {fold('x')}))"
    return rf"flatten(list_transform(regexp_extract_all(coalesce({column}, ''), '[\p{{L}}\p{{N}}]+(?:_[\p{{L}}\p{{N}}]+)*'), lambda r: {per_word}))"


ONE_CHUNK = "select id, min(repo_id) as repo_id, min(file_path) as file_path, min(start_line) as start_line, min(symbol_name) as symbol_name, min(signature) as signature, min(content) as content from chunks where id is not null group by id"
CHUNK_TEXT = "coalesce(symbol_name, '') || chr(10) || coalesce(file_path, '') || chr(10) || coalesce(signature, '') || chr(10) || coalesce(content, '')"
CHUNK_DOCS = f"c as ({ONE_CHUNK}), docs as (select repo_id, id as doc_id, {CHUNK_TEXT} as text from c)"
DOCUMENT_DOCS = "docs as (select 'all' as repo_id, doc_id, text from documents)"
ASKED = "asked as (select question_id as query_id, repo_id, min(question) as text from per_question where question is not null group by 1, 2)"
SQL_BM25 = f"""
    tk as (select repo_id, doc_id, {sql_tokens("text")} as tokens from docs),
    st as (select repo_id, count(*) as n, sum(len(tokens)) / count(*) as mean_length from tk group by 1),
    tf as (select repo_id, doc_id, length, term, count(*) as tf from (select repo_id, doc_id, len(tokens) as length, unnest(tokens) as term from tk) group by all),
    df as (select repo_id, term, count(*) as df from tf group by all),
    qt as (select distinct query_id, repo_id, unnest({sql_tokens("text")}) as term from asked),
    scores as (select query_id, tf.repo_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean_length))), 9) as score
        from qt join tf using (repo_id, term) join df using (repo_id, term) join st using (repo_id) group by 1, 2, 3)"""
SQL_SPARSE = f"""{ASKED}, {CHUNK_DOCS}, {SQL_BM25},
    sparse as (select * from (select s.query_id, c.id, c.repo_id, c.file_path, c.start_line, s.score, row_number() over (partition by s.query_id order by s.score desc, c.file_path, c.start_line, c.id) as rank
        from scores s join c on c.id = s.doc_id where s.score > 0) where rank <= 50)"""
VALID = "embedding is not null and len(embedding) = 64 and len(list_filter(embedding, lambda x: x <> 0)) > 0"
COSINE = "round(list_cosine_similarity(cast(embedding as double[]), cast(vector as double[])), 9)"
SQL_DENSE = f"""usable as (select * from chunks where {VALID}),
    vq as (select a.query_id, a.repo_id, v.vector from asked a join (select repo_id, arg_min(embedding, id) as vector from usable group by 1) v using (repo_id)),
    dense as (select * from (select query_id, id, repo_id, file_path, start_line, score, row_number() over (partition by query_id order by score desc, id) as rank
        from (select q.query_id, u.id, max(u.repo_id) as repo_id, max(u.file_path) as file_path, max(u.start_line) as start_line, max({COSINE}) as score from usable u join vq q using (repo_id) group by 1, 2)) where rank <= 50)"""
SQL_FUSED = """fused as (select *, row_number() over (partition by query_id order by fused desc, dense desc, sparse desc, file_path desc, start_line desc, id) as rank from (
    select query_id, id, coalesce(s.file_path, d.file_path) as file_path, coalesce(s.start_line, d.start_line) as start_line, coalesce(s.score, 0) as sparse, coalesce(d.score, 0) as dense,
        round(coalesce(2.0::double / (60 + d.rank), 0) + coalesce(1.0::double / (60 + s.rank), 0), 12) as fused
    from sparse s full join dense d using (query_id, id)))"""
IS_TEST = "(len(list_filter(string_split(lower(file_path), '/')[:-2], lambda p: p in ('test', 'tests', 'testing'))) > 0 or regexp_matches(string_split(lower(file_path), '/')[-1], '^conftest\\.py$|^test_|_test\\.py$'))"
SQL = {
    "tokenize_terms": f"select doc_id, term, count(*) as tf from (select doc_id, unnest({sql_tokens('text')}) as term from documents) group by 1, 2",
    "bm25_corpus_stats": f"with {CHUNK_DOCS}, tk as (select repo_id, {sql_tokens('text')} as tokens from docs) select repo_id, count(*) as n, round(sum(len(tokens)) / count(*), 6) as mean_length from tk group by 1",
    "bm25_topk": f"with asked as (select 1 as query_id, 'all' as repo_id, '{QUESTION}' as text), {DOCUMENT_DOCS}, {SQL_BM25} select doc_id, round(score, 6) as score from scores where score > 0 order by scores.score desc, doc_id limit 50",
    "bm25_batch": f"with {SQL_SPARSE} select query_id, id, rank, round(score, 6) as score from sparse",
    "dense_topk": f"""with e as (select cast(vec_id as varchar) as id, embedding, (select arg_min(embedding, vec_id) from embeddings) as vector from embeddings)
        select id, rank, round(score, 6) as score from (select *, row_number() over (order by score desc, id) as rank from (select id, {COSINE} as score from e)) where rank <= 50""",
    "dense_batch": f"with {ASKED}, {SQL_DENSE} select query_id, id, rank, round(score, 6) as score from dense",
    "hybrid_rrf": f"with {SQL_SPARSE}, {SQL_DENSE}, {SQL_FUSED} select query_id, id, rank, round(fused, 9) as fused from fused",
    "identity_rerank_testfilter": f"""with {SQL_SPARSE}, {SQL_DENSE}, {SQL_FUSED},
        kept as (select f.query_id, f.id, f.rank as place, coalesce(nullif(fused, 0), nullif(dense, 0), sparse) as score from fused f join asked a using (query_id)
            where not {IS_TEST} or regexp_matches(lower(a.text), 'test|spec|fixture|conftest|测试|用例'))
        select query_id, id, rank, round(score, 9) as score from (select *, row_number() over (partition by query_id order by place) as rank from kept) where rank <= 5""",
    "cache_keys": "select doc_id, 'embed:stub:' || sha256(text) as key from documents where text is not null",
    "url_spellings": r"""select distinct id, lower(regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)', 1)) || regexp_replace(regexp_replace(substr(trim(url), length(regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)', 1)) + 1), '/+$', ''), '\.git$', '') as address from repos""",
    "test_paths": rf"""select distinct file_path, {IS_TEST} as is_test, regexp_replace(replace(regexp_replace(file_path, '\.[^./]*$', ''), '/', '.'), '\.__init__$', '') as module from source_files""",
}
