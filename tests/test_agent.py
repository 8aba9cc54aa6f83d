from types import SimpleNamespace

from pyspark.sql import functions as F
from test_blocks import written

from chunkloom import schemas
from chunkloom.plans import agent

SEEDS = [("q", 1, "a.py", "Impl", 3, 9), ("q", 2, "a.py", "__module_doc__", 1, 1), ("q", 3, "b.py", "helper", 5, 7)]


def steps(spark, query, mode="full"):
    q = spark.createDataFrame([("q", "r", query, mode)], "query_id string, repo_id string, query string, mode string")
    s = spark.createDataFrame(SEEDS, "query_id string, place int, file_path string, symbol_name string, start_line int, end_line int")
    return [(r.tool, dict(r.args)) for r in agent.plans(q, s).orderBy("step").collect()]


def names(spark, query, mode="full"):
    return [t for t, _ in steps(spark, query, mode)]


def test_plans(spark):
    assert names(spark, "where is `x.y` defined") == ["search_code", "find_definition"]
    assert steps(spark, "who calls Impl.go")[1] == ("get_call_neighbors", {"symbol": "Impl.go", "direction": "callers"})
    assert steps(spark, "what imports `pkg.beta` - who imports it")[1] == ("get_dependents", {"module": "pkg.beta"})
    assert names(spark, "the name of it") == ["search_code"]
    assert names(spark, "show its callers") == ["search_code", "read_file", "get_call_neighbors"]
    several = names(spark, "how does it get from `Impl` to `helper`")
    assert several == ["search_code", "find_call_path", "read_file", "read_file", "read_file", "find_references", "find_references", "get_file_outline", "get_file_outline"]
    assert names(spark, "how does it get from `Impl` to `helper`", "agent_no_graph") == ["search_code", "read_file", "read_file", "read_file", "get_file_outline", "get_file_outline"]
    assert steps(spark, "how is it wired", "dense_only") == [("search_code", {"query": "how is it wired", "k": "5", "mode": "dense"})]


def test_answers(spark):
    c = spark.createDataFrame([(i, "r", p, "function", None, n, f"def {n}()", a, a + 3, [], f"def {n}(): pass", None) for i, p, n, a in [("1", "a.py", "needle", 3), ("2", "b.py", "other", 5), ("3", "tests/t.py", "needle_test", 1)]], schemas.CHUNKS)
    s = spark.createDataFrame([("s1", "r", "a.needle", "function", "a.py", 3, "1"), ("s2", "r", "b.other", "function", "b.py", 5, "2")], schemas.SYMBOLS)
    e = spark.createDataFrame([("e", "r", "s2", "s1", "calls", 6)], schemas.EDGES)
    q = spark.createDataFrame([("q", "r", "who calls `needle`", "full"), ("z", "r", "`needle` 是什么", "full"), ("n", "r", "zzz", "full")], "query_id string, repo_id string, query string, mode string")
    got = {r.query_id: r.answer for r in agent.answered(q, c, s, e).collect()}
    assert "Resolved static call relationships for `needle`:\n- `b.other` at `b.py:5`" in got["q"] and "needle_test" not in got["q"]
    assert got["z"].startswith("与 ") and got["n"] == "No results found for `zzz`."


def test_tools_shuffle_only_what_steps_may_meet(spark):
    c = spark.createDataFrame([("1", "r", "a.py", "function", None, "needle", "def needle()", 3, 6, [], "def needle(): pass", None)], schemas.CHUNKS)
    s = [(f"s{i}", "r", f"a{i}.b{i % 99}.f{i * 7919 % 10007}", "function", f"a{i}.py", i, None) for i in range(4000)]
    s += [("n", "r", "a.needle", "function", "a.py", 3, "1"), ("n", "r", "b.needle", "function", "a.py", 3, "1"), ("x", "r", "z.caller", "function", "z.py", 8, None)]
    e = [(f"e{i}", "r", f"s{i}", f"s{i * 31 % 4000}", "calls", i) for i in range(4000)] + [("e", "r", "x", "n", "calls", 6)]
    q = spark.createDataFrame([("q", "r", "who calls `a.needle`", "full")], "query_id string, repo_id string, query string, mode string")
    answered = SimpleNamespace(collect=lambda: agent.answered(q, c, spark.createDataFrame(s, schemas.SYMBOLS), spark.createDataFrame(e, schemas.EDGES)).collect())
    got, size = written(spark, answered)  # with the jobs that run before the answers are asked for
    assert "- `z.caller` at `z.py:8`" in got[0].answer and size < 300_000


def test_follow_up(spark):
    q = spark.createDataFrame([("c", "r", "show its callers"), ("d", "r", "who calls `x`")], "query_id string, repo_id string, query string")
    t = spark.createDataFrame([(k, 0, "user", "tell me about `Session.send`") for k in "cd"], "conv_id string, turn int, role string, content string")
    assert {r.query_id: r.query for r in agent.bind_history(q, t).select("query_id", F.col("query")).collect()} == {"c": "`Session.send` show its callers", "d": "who calls `x`"}
