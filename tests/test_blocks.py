"""Retrieval in blocks gives what all pairs give, and writes no pairs to disk."""

import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from chunkloom import schemas
from chunkloom.functions import text, vectors
from chunkloom.operators import blocks, retrieval

WORDS = "flush_queue HTTPServer2 where does queueFlusher2x naïve_Straße Ünï validate token 队列 ΣΟΦΟΣ x1y2 __init__ Queue 3d".split()


def written(spark, df):
    """The rows of df, and the bytes that its shuffles wrote."""
    sc = spark.sparkContext

    def total():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = total()
    return df.collect(), total() - before


def chunks(spark, n, repos=2, dim=4):
    r = random.Random(5)
    rows = []
    for i in range(n):
        words = " ".join(r.choice(WORDS) for _ in range(r.randint(0, 12)))
        vector = [float(r.randint(-2, 2)) for _ in range(dim)]
        row = (f"c{i:04}", f"r{i % repos}", r.choice(["a.py", "tests/b.py", None]), "function", None, r.choice(["f", "Queue.flush", None]), "def f()", r.choice([1, 5, None]), 9, [], words, r.choice([vector, vector, vector, None, [0.0] * dim]))
        rows.append(row)
        if i % 7 == 0:  # delivered again, in part with another vector or text
            rows.append((*row[:10], r.choice([words, "naïve token"]), [float(r.randint(-2, 2)) for _ in range(dim)]))
    return spark.createDataFrame(rows, schemas.CHUNKS)


def questions(spark, n, repos=2):
    r = random.Random(6)
    rows = [(f"q{i:03}", f"r{i % repos}", " ".join(r.choice(WORDS) for _ in range(4)) if i % 9 else "") for i in range(n)]
    return spark.createDataFrame([*rows, ("nowhere", None, "queue"), ("other", "r9", "queue")], "query_id string, repo_id string, text string")


def test_words_are_cut_as_by_the_tokenizer(spark):
    words = ["HTTPServer2", "a_b_c", "fooBARBaz9x", "X", "9", "ABc1DEf_GH2i", "abcABC", "A1B2_3c"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", text.tokenize(F.col("w")).alias("t")).collect()
    assert {r.w: r.t for r in got} == {w: blocks.word_tokens(w) for w in words}


@pytest.mark.parametrize("size", [8, 16_384])
def test_sparse_search_is_bm25(spark, monkeypatch, size):
    monkeypatch.setattr(blocks, "BLOCK", size)
    c, q = chunks(spark, 150).cache(), questions(spark, 40).cache()
    scores = retrieval.bm25(q, retrieval.chunk_documents(c)).withColumnsRenamed({"doc_id": "id", "score": "sparse_score"}).drop("repo_id")
    rows = scores.join(retrieval.one_per_id(c, "repo_id", "file_path", "start_line"), "id")
    want = retrieval.ranked(rows, [F.desc("sparse_score"), F.asc("file_path"), F.asc("start_line"), F.asc("id")], 10)
    columns = ("query_id", "id", "repo_id", "file_path", "start_line", "sparse_score", "rank")
    got = retrieval.sparse_search(q, c, 10).select(*columns).collect()
    assert {(*r,) for r in got} == {(*r,) for r in want.select(*columns).collect()} and len(got) > 300


def test_sparse_search_writes_no_pairs(spark):
    c = spark.createDataFrame([(f"c{i:04}", "r", f"{i}.py", "function", None, "f", "", i, i, [], f"where does the queue {i}", None) for i in range(1500)], schemas.CHUNKS)
    q = spark.createDataFrame([(f"q{i:03}", "r", f"where does the queue {i}") for i in range(400)], "query_id string, repo_id string, text string")
    got, size = written(spark, retrieval.sparse_search(q, c, 3))
    assert len(got) == 1200 and size < 300_000  # of 600,000 pairs


@pytest.mark.parametrize("size", [8, 16_384])
def test_dense_search_is_cosine_of_all_pairs(spark, monkeypatch, size):
    monkeypatch.setattr(blocks, "BLOCK", size)
    c = chunks(spark, 150).cache()
    moved = c.filter("start_line = 1").withColumns({"start_line": F.lit(7), "file_path": F.lit("0.py")})
    c = c.unionByName(moved)
    r = random.Random(8)
    q = spark.createDataFrame([(f"q{i}", f"r{i % 2}", [float(r.randint(-2, 2)) for _ in range(4 if i % 5 else 3)]) for i in range(30)] + [("null", None, [1.0] * 4)], "query_id string, repo_id string, vector array<double>").cache()
    valid = c.filter(vectors.is_valid(F.col("embedding"), 4)).groupBy("id", "repo_id").agg(F.max("file_path").alias("file_path"), F.max("start_line").alias("start_line"), F.collect_list("embedding").alias("all"))
    usable = q.filter(vectors.is_valid(F.col("vector"), 4))
    score = F.round(F.array_max(F.transform("all", lambda v: vectors.cosine(v, F.col("vector")))), 9)
    want = retrieval.ranked(valid.join(usable, "repo_id").withColumn("dense_score", score), [F.desc("dense_score"), F.asc("id")], 10)
    columns = ("query_id", "id", "repo_id", "file_path", "start_line", "dense_score", "rank")
    got = retrieval.dense_search(q, c, 4, 10).select(*columns).collect()
    assert {(*x,) for x in got} == {(*x,) for x in want.select(*columns).collect()} and len(got) > 200


def test_hybrid_search_writes_no_pairs(spark):
    r = random.Random(9)
    c = spark.createDataFrame([(f"c{i:04}", "r", f"{i}.py", "function", None, "f", "", i, i, [], f"where does the queue {i}", [r.gauss(0, 1) for _ in range(8)]) for i in range(1500)], schemas.CHUNKS)
    q = spark.createDataFrame([(f"q{i:03}", "r", f"where does the queue {i}", [r.gauss(0, 1) for _ in range(8)]) for i in range(400)], "query_id string, repo_id string, text string, vector array<double>")
    got, size = written(spark, retrieval.fuse(retrieval.sparse_search(q, c, 3), retrieval.dense_search(q, c, 8, 3)))
    assert len(got) >= 1200 and size < 1_000_000  # of 600,000 pairs of each kind


def test_sparse_search_leaves_texts_where_they_lie(spark):
    r = random.Random(10)
    rows = [(f"c{i:04}", "r", f"{i}.py", "function", None, "f", "", i, i, [], f"queue {i} " + "".join(r.choice("abcdefghij ") for _ in range(1000)), None) for i in range(1500)]
    c = spark.createDataFrame(rows + rows[:9], schemas.CHUNKS)
    q = spark.createDataFrame([(f"q{i:03}", "r", f"queue {i}") for i in range(5)], "query_id string, repo_id string, text string")
    search = SimpleNamespace(collect=lambda: retrieval.sparse_search(q, c, 3).collect())
    got, size = written(spark, search)  # with the jobs that run before its rows are asked for
    assert len(got) == 15 and size < 300_000  # of texts of 1.5 MB


@pytest.mark.parametrize("size", [8, 16_384])
def test_fused_candidates_are_fused_lists(spark, monkeypatch, size):
    monkeypatch.setattr(blocks, "BLOCK", size)
    c, q = chunks(spark, 150).cache(), questions(spark, 40).cache()
    r = random.Random(11)
    v = spark.createDataFrame([(f"q{i:03}", f"r{i % 2}", [float(r.randint(-1, 1)) for _ in range(4)]) for i in range(30)], "query_id string, repo_id string, vector array<double>").cache()
    got = retrieval.fuse_candidates(retrieval.sparse_candidates(q, c, 10), retrieval.dense_candidates(v, c, 4, 10), 10)
    want = retrieval.fuse(retrieval.sparse_search(q, c, 10), retrieval.dense_search(v, c, 4, 10))
    columns = ("query_id", "id", "repo_id", "file_path", "start_line", "sparse_score", "dense_score", "fused_score", "rank")
    rows = got.select(*columns).collect()
    assert {(*x,) for x in rows} == {(*x,) for x in want.select(*columns).collect()} and len(rows) > 400
