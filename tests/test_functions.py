import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chunkloom.functions import citations, intents, keys, paths, text, vectors


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'array<string>'}" for k, v in values.items()))
    return df.select(column.alias("x")).first().x


def plain_tokens(value):
    out = []
    for raw in re.findall(r"[^\W_]+(?:_[^\W_]+)*", value):
        found = [raw.replace("_", "").casefold()]
        for segment in raw.split("_"):
            found += [p.casefold() for p in re.findall(r"[A-Z]+(?=[A-Z][a-z]|[0-9]|\Z)|[A-Z]?[a-z]+|[0-9]+|[A-Z]+", segment) or [segment]]
        out += dict.fromkeys(found)
    return out


def test_tokenizer_fixture(spark):
    got = one(spark, text.tokenize(F.col("t")), t="HTTPBasicAuth _basic_auth_str src/requests/auth.py")
    assert got == ["httpbasicauth", "http", "basic", "auth", "basicauthstr", "basic", "auth", "str", "src", "requests", "auth", "py"]
    assert one(spark, text.tokenize(F.col("t")), t=None) is None
    assert one(spark, text.tokenize(F.col("t")), t=" _ ") == []


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="abcABXY019_ .-éß中", max_size=14), min_size=20, max_size=40))
def test_tokenizer_against_plain_python(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    for r in df.select("t", text.tokenize(F.col("t")).alias("x")).collect():
        assert r.x == plain_tokens(r.t)


def test_clip_and_cap(spark):
    assert one(spark, text.cap(F.col("t"), 20), t="x" * 60) == "xxxx\n... [truncated]"
    assert one(spark, text.clip(F.col("t"), 5), t="abcdefgh") == "abcde\n... [truncated]"
    assert one(spark, text.clip(F.col("t"), 50), t="abc") == "abc"


def test_paths(spark):
    yes = ["tests/a.py", "a/Test/b.py", "conftest.py", "x/test_b.py", "x/b_test.py", "testing/z.py"]
    no = ["protest.py", "latest.py", "contest/a.py", "src/testimony.py", "a/tests.py"]
    df = spark.createDataFrame([(p,) for p in yes + no], "p string")
    assert {r.p for r in df.filter(paths.is_test_path(F.col("p"))).collect()} == set(yes)
    assert one(spark, paths.module_name(F.col("p")), p="pkg/sub/__init__.py") == "pkg.sub"
    assert one(spark, paths.module_name(F.col("p")), p="__init__.py") == "__init__"
    assert one(spark, paths.normalise(F.col("p")), p="a\\b/./c/../d.py") == "a/b/d.py"
    assert one(spark, paths.normalise(F.col("p")), p="../x") is None
    assert one(spark, paths.normalise(F.col("p")), p="/etc/x") is None
    assert one(spark, paths.repo_slug(F.col("p")), p="git@host.example:owner/name.git") == "owner/name"
    assert one(spark, paths.base_url(F.col("p")), p=" HTTPS://Host.Example/A/b.git/ ") == "https://host.example/A/b"
    assert set(one(spark, paths.url_variants(F.col("p")), p="https://h.example/a.git")) == {"https://h.example/a.git", "https://h.example/a", "https://h.example/a/"}
    assert one(spark, paths.is_acceptable_url(F.col("p")).cast("string"), p="https://127.0.0.1/x") == "false"
    assert one(spark, paths.is_acceptable_url(F.col("p")).cast("string"), p="https://u:p@h.example/x") == "false"
    assert one(spark, paths.is_acceptable_url(F.col("p")).cast("string"), p="https://h.example/x") == "true"


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0, 0.0]), ([1.0], [1.0, 0.0])], "a array<double>, b array<double>")
    got = [r.x for r in df.select(vectors.cosine(F.col("a"), F.col("b")).alias("x")).collect()]
    assert abs(got[0] - 0.5**0.5) < 1e-12 and got[1:] == [None, None, None]


def test_citations(spark):
    answer = "See `a/b.py:12`, c.py:3 and `pkg.mod.Name`; also `single`."
    got = one(spark, F.to_json(citations.extract(F.col("t"))), t=answer)
    assert [x in got for x in ("a/b.py:12", "c.py:3", "pkg.mod.Name")] == [True] * 3 and "single" not in got
    assert one(spark, citations.evidence_ids(F.col("t")), t="[C2] [C1] [C2]") == ["C2", "C1", "C2"]
    bad = F.filter(citations.extract(F.col("t")), lambda c: c["token"] != "src/pkg/file.py:1")
    assert one(spark, citations.redact(F.col("t"), bad, F.lit(False)), t="file.py:1 and src/pkg/file.py:1 and `x.y`") == "[unverified reference removed] and src/pkg/file.py:1 and [unverified reference removed]"
    assert one(spark, citations.render_ids(F.col("t"), F.create_map(F.lit("C1"), F.lit("a.py:1"), F.lit("C2"), F.lit("b.py:2"))), t="x [C1][C2]") == "x `a.py:1` `b.py:2`"


def test_intents(spark):
    assert one(spark, intents.call_direction(F.col("t")), t="Who calls send?") == "callers"
    assert one(spark, intents.call_direction(F.col("t")), t="What does send call?") == "callees"
    assert one(spark, intents.call_subject(F.col("t")), t="who calls Session.send") == "Session.send"
    assert one(spark, intents.subject(F.col("t")), t="what is `x.y` and a.b") == "x.y"
    assert one(spark, intents.best_symbol(F.col("t")), t="self.x and `foo` and Bar.Baz in a.py") == "Bar.Baz"
    got = one(spark, F.to_json(intents.flow_endpoints(F.col("t"), F.array(F.lit("s1"), F.lit("s2")))), t="how does it get from `a` to `b`")
    assert got == '{"start":"a","end":"b"}'


def test_subjects_of_questions(spark):
    calls = {
        "who calls Session.send": "Session.send", "Find callers of send": "send", "callers a.b": "a.b", "caller of x please": "x", "what calls send": "send", "which functions call send?": "send", "which method calls send": "send",
        "What does send call?": "send", "which helpers do load_all call": "load_all", "callees of a.b.c": "a.b.c", "callee x": "x", "谁调用 send": "send", "哪些函数在调用send": "send", "send 被哪些函数调用": "send", "send调用了哪些": "send", "send 调用谁": "send",
        "who owns send": None, "calls": None, "": None, "call 3": None,
    }
    df = spark.createDataFrame(list(calls.items()), "q string, want string").select("q", "want", intents.call_subject(F.col("q")).alias("got"))
    assert [(r.q, r.got) for r in df.filter("not (got <=> want)").collect()] == []
    refs = {"who references Foo.bar": "Foo.bar", "references to x": "x", "references of x": "x", "谁引用 Foo": "Foo", "引用了Foo": "Foo", "no reference": None}
    df = spark.createDataFrame(list(refs.items()), "q string, want string").select("q", "want", intents.reference_subject(F.col("q")).alias("got"))
    assert [(r.q, r.got) for r in df.filter("not (got <=> want)").collect()] == []
    ways = {"which functions call send": "callers", "what does send call": "callees", "调用关系": "both", "what does x do": None, "": None}
    df = spark.createDataFrame(list(ways.items()), "q string, want string").select("q", "want", intents.call_direction(F.col("q")).alias("got"))
    assert [(r.q, r.got) for r in df.filter("not (got <=> want)").collect()] == []
    names = one(spark, F.array_join(F.regexp_extract_all(F.col("t"), F.lit(text.IDENTIFIER), 0), ","), t="see a.b.C and load_all2 or HttpClient, not Word or word")
    assert names == "a.b.C,load_all2,HttpClient"


def test_keys(spark):
    assert one(spark, keys.embedding_key("m", F.col("t")), t="") == "embed:m:e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    a = one(spark, keys.tool_key(F.lit("grep"), F.lit("r"), F.lit(3), F.create_map(F.lit("b"), F.lit("1"), F.lit("a"), F.lit("2"))), t="")
    b = one(spark, keys.tool_key(F.lit("grep"), F.lit("r"), F.lit(3), F.create_map(F.lit("a"), F.lit("2"), F.lit("b"), F.lit("1"))), t="")
    assert a == b and a.startswith("tool:grep:r:r3:") and len(a.rsplit(":", 1)[1]) == 16
