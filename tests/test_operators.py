import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from chunkloom import schemas
from chunkloom.operators import embedding, evaluation, graph, grounding, history, lookup, repositories, retrieval, skew
from chunkloom.operators.skew import Agg


def docs(spark, *texts):
    return spark.createDataFrame([("r", str(i), t) for i, t in enumerate(texts)], "repo_id string, doc_id string, text string")


def query(spark, text):
    return spark.createDataFrame([("q", "r", text)], "query_id string, repo_id string, text string")


def scores(spark, q, *texts, **kw):
    got = {r.doc_id: r.score for r in retrieval.bm25(query(spark, q), docs(spark, *texts), **kw).collect()}
    return [got.get(str(i), 0.0) for i in range(len(texts))]


def test_bm25(spark):
    a, b = scores(spark, "needle", "needle", "other", b=0)
    assert abs(a - math.log(2)) < 1e-8 and b == 0
    s = scores(spark, "term", "term", "term term", "term term term", b=0)
    assert s[0] < s[1] < s[2] and s[1] - s[0] > s[2] - s[1]
    assert scores(spark, "needle needle", "needle", "x") == scores(spark, "needle", "needle", "x")
    short, long = scores(spark, "needle", "needle", "needle filler filler filler filler")
    assert short > long
    assert scores(spark, "needle", None, "") == [0.0, 0.0]
    for kw in ({"k1": 0}, {"b": -0.1}, {"b": 1.1}):
        with pytest.raises(ValueError):
            retrieval.bm25(query(spark, "x"), docs(spark, "x"), **kw)


def ranked(spark, name, rows):
    return spark.createDataFrame([("q", i, "r", p, n, s, k) for k, (i, p, n, s) in enumerate(rows, 1)], f"query_id string, id string, repo_id string, file_path string, start_line int, {name} double, rank int")


def test_fusion_order_and_missing_scores(spark):
    sparse = ranked(spark, "sparse_score", [("A", "a.py", 1, 120.0), ("B", "b.py", 1, 40.0)])
    dense = ranked(spark, "dense_score", [("C", "c.py", 1, 0.91), ("A", "a.py", 1, 0.42)])
    rows = retrieval.fuse(sparse, dense).orderBy("rank").collect()
    assert [r.id for r in rows] == ["A", "C", "B"] and rows[1].sparse_score == 0.0 and rows[2].dense_score == 0.0
    equal = retrieval.fuse(ranked(spark, "sparse_score", [("S", "a.py", 1, 1.0)]), ranked(spark, "dense_score", [("D", "a.py", 1, 0.5)]), 1.0, 1.0).orderBy("rank").collect()
    assert [r.id for r in equal] == ["D", "S"]


def test_rerank_and_late_filter(spark):
    rows = retrieval.fuse(ranked(spark, "sparse_score", [(f"{i:02}", "tests/x.py" if i == 1 else f"m{i}.py", i, 50.0 - i) for i in range(20)]), ranked(spark, "dense_score", []))
    assert retrieval.rerank(rows).count() == 20
    flipped = retrieval.rerank(rows, lambda df: df.withColumn("rerank_score", F.col("start_line").cast("double")))
    assert flipped.count() == 16 and flipped.filter("rank = 1").first().start_line == 15
    assert [r.id for r in retrieval.take(retrieval.rerank(rows), 2).orderBy("rank").collect()] == ["00", "02"]


SYMBOLS = [("m", "pkg.mod", "module", "pkg/mod.py", 1), ("f", "pkg.mod.run", "function", "pkg/mod.py", 3), ("g", "pkg.other.run", "function", "pkg/other.py", 9), ("h", "run", "function", "run.py", 1), ("x", "pkg.end", "function", "e.py", 1), ("y", "pkg.mid", "function", "d.py", 1)]


def tables(spark, edges):
    s = spark.createDataFrame([(i, "r", q, k, p, n, None) for i, q, k, p, n in SYMBOLS + SYMBOLS[:2]], schemas.SYMBOLS)
    e = spark.createDataFrame([(str(j), "r", a, b, t, n) for j, (a, b, t, n) in enumerate(edges)], schemas.EDGES)
    return s, e


def asked(spark, symbol):
    return spark.createDataFrame([("q", "r", symbol)], "query_id string, repo_id string, symbol string")


def test_exact_else_suffix(spark):
    s, _ = tables(spark, [])
    assert {r.id for r in graph.resolve(asked(spark, "run"), s).collect()} == {"h"}
    assert {r.id for r in graph.resolve(asked(spark, "mod.run"), s).collect()} == {"f"}
    assert graph.resolve(asked(spark, None), s).count() == 0
    assert {r.id for r in graph.resolve(asked(spark, "mod"), s, True).collect()} == {"m"}


def test_references_and_imports_of_modules(spark):
    s, e = tables(spark, [("f", "m", "imports", 1), ("f", "h", "imports", 2), ("g", "h", "calls", 4), ("g", "h", "calls", 4), ("gone", "h", "calls", 1)])
    assert {r.edge_type for r in graph.references(asked(spark, "pkg.mod"), s, e).collect()} == {"imports"}
    assert [(r.symbol_id, r.edge_type) for r in graph.references(asked(spark, "run"), s, e).collect()] == [("g", "calls")]
    assert graph.call_neighbours(asked(spark, "run"), s, e, "both").count() == 1
    with pytest.raises(ValueError):
        graph.call_neighbours(asked(spark, "run"), s, e, "up")


def test_call_path(spark):
    s, e = tables(spark, [("f", "g", "calls", 1), ("f", "y", "calls", 1), ("g", "x", "calls", 1), ("y", "x", "calls", 1), ("x", "f", "calls", 1), ("f", "f", "calls", 2)])
    q = spark.createDataFrame([("a", "r", "pkg.mod.run", "pkg.end"), ("b", "r", "pkg.end", "pkg.end"), ("c", "r", "pkg.end", "h.none"), ("d", "r", "h", "pkg.end")], "query_id string, repo_id string, start string, end string")
    got = {r.query_id: r for r in graph.call_paths(q, s, e).collect()}
    assert got["a"].depth == 2 and got["a"].path == ["pkg.mod.run", "pkg.other.run", "pkg.end"]
    assert got["b"].depth == 0 and got["b"].path == ["pkg.end"]
    assert not got["c"].found and got["c"].path == [] and not got["d"].found
    with pytest.raises(ValueError):
        graph.call_paths(q, s, e, 7)


def chunk(i, a, z, path="a.py", name="f", content="x"):
    return (i, "r", path, "function", None, name, "def f()", a, z, [], content, None)


def test_lookups(spark):
    c = spark.createDataFrame([chunk("big", 1, 300), chunk("small", 100, 110), chunk("late", 105, 200), chunk("late", 105, 200)], schemas.CHUNKS)
    p = spark.createDataFrame([("p", "r", "a.py", 106), ("q", "r", "a.py", 250), ("n", "r", "a.py", 301)], "point_id string, repo_id string, file_path string, line int")
    assert {r.point_id: r.id for r in lookup.containing(p, c).collect()} == {"p": "late", "q": "big"}
    assert {r.point_id: r.id for r in lookup.containing(p, c, "smallest").collect()} == {"p": "small", "q": "big"}
    o = lookup.ordered_chunks(spark.createDataFrame([("q", ["late", "none", "big", "late"])], "query_id string, ids array<string>"), c)
    assert [(r.position, r.id) for r in o.orderBy("position").collect()] == [(0, "late"), (2, "big"), (3, "late")]
    t = spark.createDataFrame([("one", "r", "a.py", None, 105, 106), ("many", "r", "a.py", "f", 107, 108), ("none", "r", "b.py", None, 1, 1)], "target_id string, repo_id string, file_path string, symbol_name string, start_line int, end_line int")
    assert {r.target_id: (r.id, r.matches) for r in lookup.resolve_targets(t, c).collect()} == {"one": ("late", 3), "many": (None, 3), "none": (None, 0)}


def test_source_calls(spark):
    text = "    def m(self, d):\n        self.run(1)\n        d.keys()\n        print(len(d))\n        other.go()\n"
    c = spark.createDataFrame([chunk("c", 10, 14, content=text), chunk("bad", 1, 2, content="def (")], schemas.CHUNKS)
    s = spark.createDataFrame([("m", "r", "a.C.m", "method", "a.py", 10, "c"), ("t", "r", "a.C.run", "method", "a.py", 30, None)], schemas.SYMBOLS)
    e = spark.createDataFrame([("1", "r", "m", "t", "calls", 11)], schemas.EDGES)
    rows = lookup.resolved_calls(c, s, e).orderBy("position").collect()
    assert [(r.expression, r.line, r.target) for r in rows] == [("self.run", 11, "a.C.run"), ("other.go", 14, None)]
    assert [tuple(r) for r in lookup.call_summary(lookup.resolved_calls(c, s, e)).collect()] == [("c", 2, 1, 1)]
    q = spark.createDataFrame([("q", "r", "C.m"), ("n", "r", "nothing")], "query_id string, repo_id string, symbol string")
    assert [(r.query_id, r.expression, r.target) for r in lookup.callees_in_source(q, c, s, e).orderBy("position").collect()] == [("q", "self.run", "a.C.run"), ("q", "other.go", None)]


def test_files(spark):
    f = spark.createDataFrame([("r", "a/b.py", "one\ntwo\nthree"), ("r", "a/.h/c.py", None), ("r", "z.py", "two\ntwo")], "repo_id string, file_path string, source string")
    assert [(r.file_path, r.line_no) for r in lookup.grep(f, "two", 1).orderBy("file_path").collect()] == [("a/b.py", 2), ("z.py", 1)]
    assert lookup.read_lines(f, 2, 9).filter("file_path = 'a/b.py'").first().text == "two\nthree"
    assert [(r.name, r.is_dir) for r in lookup.list_directory(f).orderBy("position").collect()] == [("a", True), ("z.py", False)]
    with pytest.raises(ValueError):
        lookup.read_lines(f, 3, 2)


def test_metrics(spark):
    rows = [(["a", "b", "c"], ["a", "b"]), (["x", "a", "z"], ["a", "q"]), (["x"], []), (["x", "y", "z"], ["z"])]
    df = spark.createDataFrame(rows, "g array<string>, t array<string>")
    got = df.select(evaluation.recall(F.col("g"), F.col("t"), 3).alias("r"), evaluation.mrr(F.col("g"), F.col("t")).alias("m"), evaluation.ndcg(F.col("g"), F.col("t"), 3).alias("n")).collect()
    assert [r.r for r in got] == [1.0, 0.5, 1.0, 1.0] and [round(r.m, 6) for r in got] == [1.0, 0.5, 0.0, 0.333333] and got[0].n == 1.0 and got[2].n == 0.0


def test_groundedness(spark):
    c = spark.createDataFrame([chunk("c", 1, 20, "src/a.py")], schemas.CHUNKS)
    s = spark.createDataFrame([("s", "r", "pkg.mod.Name", "class", "src/a.py", 3, "c")], schemas.SYMBOLS)
    a = spark.createDataFrame([("1", "r", "`src/a.py:5` `src/a.py:99` and `mod.Name`"), ("2", "r", "nothing"), ("3", "r", None)], "answer_id string, repo_id string, answer string")
    v = grounding.verify(a, c, s).orderBy("answer_id", "position").collect()
    assert [(r.verified, r.chunk_id) for r in v] == [(True, "c"), (False, None), (True, "c")]
    got = {r.answer_id: r for r in grounding.enforce(a, c, s).collect()}
    assert round(got["1"].score, 4) == 0.6667 and got["1"].answer.startswith("`src/a.py:5` [unverified reference removed] and `mod.Name`") and "1 unverified reference removed" in got["1"].answer
    assert got["2"].score == 0.0 and "cites no indexed code" in got["2"].answer
    lax = {r.answer_id: r for r in grounding.enforce(a, c, s, 0.5).collect()}
    assert lax["1"].answer == "`src/a.py:5` [unverified reference removed] and `mod.Name`" and lax["1"].removed == 1
    twice = spark.createDataFrame([("1", "r", "`src/a.py:5` src/a.py:5 `src/a.py:99`")], "answer_id string, repo_id string, answer string")
    m = grounding.merged(grounding.verify(twice, c, s))
    assert [(r.line, r.tokens, r.verified) for r in m.orderBy("line").collect()] == [(5, ["src/a.py:5"], True), (99, ["src/a.py:99"], False)]
    tokens = spark.createDataFrame([("1", "src/a.py:5"), ("1", "b.py:1")], "answer_id string, token string")
    assert [r.token for r in grounding.unmatched(tokens, grounding.verify(twice, c, s)).collect()] == ["b.py:1"]


def test_embedding_with_cache(spark):
    model = lambda texts: [(i, [float(len(t)), 1.0]) for i, t in reversed(list(enumerate(texts)))]
    t = spark.createDataFrame([("1", "a"), ("2", "bb"), ("3", "bb"), ("4", None), ("5", "")], "id string, text string")
    none = spark.createDataFrame([], "key string, vector array<float>")
    got, new = embedding.embed(t, none, model, "m", 2)
    assert {r.id: r.vector for r in got.collect()} == {"1": [1.0, 1.0], "2": [2.0, 1.0], "3": [2.0, 1.0], "5": [0.0, 1.0]} and new.count() == 3
    assert embedding.embed(t, new, model, "m", 2)[1].count() == 0
    for wrong in ([(0, [1.0, 2.0])], [(0, [1.0, 2.0]), (0, [1.0, 2.0])], [(0, [1.0, 2.0]), (2, [1.0, 2.0])], [(0, [1.0, 2.0]), (1, [1.0])]):
        with pytest.raises(ValueError):
            embedding.in_order(wrong, 2, 2)
    assert embedding.in_order([(1, [1.0]), (0, [2.0])], 2, 1) == [[2.0], [1.0]]


def test_groundedness_by_evidence_ids(spark):
    c = spark.createDataFrame([chunk("c", 1, 20, "src/a.py")], schemas.CHUNKS)
    s = spark.createDataFrame([("s", "r", "pkg.mod.Name", "class", "src/a.py", 3, "c")], schemas.SYMBOLS)
    a = spark.createDataFrame([("1", "r", "x [C1][C2] src/a.py:99 [C9] `self.x` [C3] [C1]"), ("2", "r", "only `mod.Name`"), ("3", "r", "[C1]"), ("4", "r", None)], "answer_id string, repo_id string, answer string")
    e = spark.createDataFrame([("1", "C1", "src/a.py:5"), ("1", "C2", "pkg.mod.Name"), ("1", "C3", "src/a.py:77"), ("3", "C1", "src/a.py:5"), ("2", "C1", "src/a.py:5")], "answer_id string, evidence_id string, token string")
    v = grounding.verify(a, c, s, e).orderBy("answer_id", "position").collect()
    assert [(r.answer_id, r.kind, r.token, r.verified, r.chunk_id) for r in v] == [
        ("1", "id", "C1", True, "c"), ("1", "id", "C2", True, "c"), ("1", "file", "src/a.py:99", False, None), ("1", "id", "C9", False, None), ("1", "id", "C3", False, None), ("1", "id", "C1", True, "c"), ("3", "id", "C1", True, "c"),
    ]
    got = {r.answer_id: r for r in grounding.enforce(a, c, s, evidence=e).collect()}
    gone = "[unverified reference removed]"
    assert got["1"].answer.startswith(f"x `src/a.py:5` `pkg.mod.Name` {gone} {gone} `self.x` {gone} `src/a.py:5`\n") and got["1"].removed == 3 and got["1"].score == 0.5
    assert "cites no indexed code" in got["2"].answer and got["3"].answer == "`src/a.py:5`" and got["3"].score == 1.0
    assert {r.answer_id: (r.citations, r.verified) for r in grounding.scores(a, c, s, e).collect()} == {"1": (6, 3), "2": (0, 0), "3": (1, 1), "4": (0, 0)}


def test_history(spark):
    t = spark.createDataFrame([("c", i, "user" if i % 2 == 0 else "assistant", x) for i, x in enumerate(["old", "", "a" * 30, "uses `Thing.run`", "Foo"])] + [("c", 9, "user", None)], "conv_id string, turn int, role string, content string")
    got = history.bounded(t, 5, 20).orderBy("turn").collect()
    assert [(r.turn, len(r.content)) for r in got] == [(2, 1), (3, 16), (4, 3)] and sum(len(r.content) for r in got) == 20
    assert history.recent_symbol(t).first().symbol == "Foo"


def test_evidence(spark):
    o = [("q", 1, "search", "a.py:1", "", "", "", None), ("q", 2, "refs", "a.py:1", "c1", "A", "text", None), ("q", 3, "refs", "b.py:2", "c2", "", "", 0.5)]
    m = history.merged_evidence(spark.createDataFrame(o, "query_id string, ordinal int, origin string, token string, chunk_id string, symbol string, content string, score double")).orderBy("evidence_id").collect()
    assert [(r.evidence_id, r.token, r.chunk_id, r.origins) for r in m] == [("C1", "b.py:2", "c2", ["refs"]), ("C2", "a.py:1", "c1", ["search", "refs"])]


def test_repositories(spark):
    now = datetime(2024, 1, 1)
    r = [("a", "https://h.example/x.git", None, "ready", 100, None, 1, now, now), ("b", "HTTPS://h.example/x/", None, "queued", 0, None, 0, now + timedelta(1), now), ("c", "https://h.example/x", None, "failed", 100, "e", 0, now + timedelta(2), now)]
    df = spark.createDataFrame(r, schemas.REPOS)
    assert [(x.address, x.id) for x in repositories.reusable(df).collect()] == [("https://h.example/x", "a")]
    assert [x.more for x in repositories.page(df, 2).collect()] == [True, True]
    live = repositories.with_live_state(df, spark.createDataFrame([("b", '{"status": "parsing", "progress": 140}'), ("a", "broken")], "id string, payload string"))
    assert {x.id: (x.status, x.progress) for x in live.collect()} == {"a": ("ready", 100), "b": ("parsing", 0), "c": ("failed", 100)}
    d = spark.createDataFrame([(n, now + timedelta(i)) for i, n in enumerate("wxyz")], "name string, modified timestamp")
    assert {x.name for x in repositories.evicted(d, 2, "w").collect()} == {"x", "y"}


def test_skew_against_plain_groups(spark):
    rows = [("hot", i % 7, i) for i in range(900)] + [(f"k{i}", i % 3, i) for i in range(50)] + [(None, None, 1)] * 3
    df = spark.createDataFrame(rows, "k string, v int, __salt int")
    got = {r.k: tuple(r)[1:] for r in skew.salted_aggregate(df, "k", [Agg("n", "count"), Agg("d", "count_distinct", "v"), Agg("s", "sum", "v"), Agg("m", "max", "v")], share=0.1, salts=4).collect()}
    want = {r.k: tuple(r)[1:] for r in df.groupBy("k").agg(F.count("*"), F.count_distinct("v"), F.sum("v"), F.max("v")).collect()}
    assert got == want
    assert skew.salted_aggregate(df.limit(0), "k", [Agg("n", "count"), Agg("d", "count_distinct", "v")]).count() == 0
    assert [tuple(r) for r in skew.heavy_owners({"t": df}, "k", 0.04).collect()] == [("t", "hot")]
    with pytest.raises(ValueError):
        skew.salted_aggregate(df, "k", [Agg("x", "median", "v")])
