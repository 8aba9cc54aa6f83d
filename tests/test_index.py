import json

import pytest
from pyspark.sql import functions as F

from chunkloom.operators import python_ast
from chunkloom.plans import indexer
from chunkloom.sources import files, sinks
from chunkloom.streaming import jobs

PKG = {
    "pkg/__init__.py": "",
    "pkg/beta.py": "class Base:\n    def shared(self):\n        return 1\n\n\nclass Mixin(Base):\n    pass\n\n\ndef helper():\n    return 2\n",
    "pkg/alpha.py": '"""Doc."""\nimport os\nfrom pkg.beta import helper, Mixin\nfrom . import beta\n\n\nclass Impl(Mixin):\n    async def go(\n        self, x=1,\n    ) -> int:\n        import json\n        self.shared()\n        helper()\n        beta.helper()\n        return Impl\n\n    def own(self):\n        m = Mixin()\n        m.shared()\n        m = helper()\n        z = Impl()\n        z.own()\n        z.shared()\n\n\ndef make():\n    def inner():\n        pass\n    return Impl\n',
    "bad.py": "def (",
}


@pytest.fixture(scope="module")
def built(spark):
    df = spark.createDataFrame([("r", p, s) for p, s in PKG.items()], "repo_id string, file_path string, source string")
    return {k: v.collect() for k, v in indexer.build(df).items()} | {"warnings": python_ast.warnings_of(df).collect()}


def test_chunks(built):
    got = {(c.symbol_name, c.chunk_type, c.parent_symbol): c for c in built["chunks"] if c.file_path == "pkg/alpha.py"}
    assert set(got) == {("__module_doc__", "module_doc", None), ("Impl", "class", None), ("go", "method", "Impl"), ("own", "method", "Impl"), ("make", "function", None)}
    go = got[("go", "method", "Impl")]
    assert go.signature == "async def go(self, x=1) -> int" and go.imports == ["import os", "from pkg.beta import helper", "from pkg.beta import Mixin", "from . import beta", "import json"]
    assert got[("Impl", "class", None)].signature == "class Impl(Mixin)" and [w.file_path for w in built["warnings"]] == ["bad.py"]


def edges(built, kind):
    name = {s.id: s.qualified_name for s in built["symbols"]}
    return {(name[e.source_id], name[e.target_id]) for e in built["edges"] if e.edge_type == kind}


def test_edges(built):
    assert {s.qualified_name for s in built["symbols"]} >= {"pkg", "pkg.alpha", "pkg.alpha.Impl.go", "pkg.beta.helper"}
    assert edges(built, "imports") == {("pkg.alpha", "pkg.beta")}
    assert edges(built, "inherits") == {("pkg.alpha.Impl", "pkg.beta.Mixin"), ("pkg.beta.Mixin", "pkg.beta.Base")}
    assert edges(built, "calls") == {
        ("pkg.alpha.Impl.go", "pkg.beta.Base.shared"),
        ("pkg.alpha.Impl.go", "pkg.beta.helper"),
        ("pkg.alpha.Impl.own", "pkg.beta.Mixin"),
        ("pkg.alpha.Impl.own", "pkg.beta.helper"),
        ("pkg.alpha.Impl.own", "pkg.beta.Base.shared"),
    }
    assert edges(built, "references") == {("pkg.alpha.Impl.go", "pkg.alpha.Impl"), ("pkg.alpha.make", "pkg.alpha.Impl")}
    assert all(s.chunk_id for s in built["symbols"] if s.kind != "module")


def test_source_tree_and_revisions(spark, tmp_path):
    root = tmp_path / "tree"
    for name, text in {"a.py": "x = 1\n", "d/b.py": "y", ".venv/c.py": "z", "big.py": "#" * 60, "note.txt": "t"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    (root / "bin.py").write_bytes(b"\xff\xfe\x00")
    ok, warned = files.source_tree(spark, str(root), "r", 50)
    assert {r.file_path for r in ok.collect()} == {"a.py", "d/b.py"} and {r.file_path for r in warned.collect()} == {"big.py", "bin.py"}
    store = str(tmp_path / "store")
    c = spark.createDataFrame([("r", "1"), ("r", "2")], "repo_id string, id string")
    assert sinks.publish(spark, store, "r", {"chunks": c}) == 1
    assert sinks.publish(spark, store, "r", {"chunks": c.limit(1)}, {"chunks": 1}) == 2
    with pytest.raises(ValueError):
        sinks.publish(spark, store, "r", {"chunks": c}, {"chunks": 5})
    assert sinks.published(spark, store, "chunks").count() == 1


def test_events_round_trip(spark):
    e = spark.createDataFrame([("q", 0, "thought", '{"a": 1}'), ("q", 1, "final_answer", "two\nlines")], "query_id string, seq int, event string, payload string")
    t = files.encoded_events(e).groupBy("query_id").agg(F.concat(F.lit(": hello\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "")).alias("text"))
    assert sorted(map(tuple, files.decoded_events(t).collect())) == sorted(map(tuple, e.collect()))
    assert jobs.ordered_events(e).first().outcome == "done"


def test_documents_and_blocks(tmp_path):
    doc = "a\n<!-- begin:x -->\nold\n<!-- end:x -->\nb"
    assert sinks.replace_block(doc, "x", "new") == "a\n<!-- begin:x -->\nnew\n<!-- end:x -->\nb" and sinks.is_stale(doc, "x", "new") and not sinks.is_stale(doc, "x", "old")
    sinks.write_json(str(tmp_path / "r.json"), {"é": [1]})
    assert json.loads((tmp_path / "r.json").read_text(encoding="utf-8")) == {"é": [1]}


def test_streams(spark, tmp_path):
    queue, seen = tmp_path / "queue", []
    queue.mkdir()
    (queue / "1.json").write_text('{"repo_id": "r", "url": "u"}\nnonsense\n{"repo_id": "r", "url": "u"}\n')
    q = jobs.consume(spark, str(queue), lambda df, n: seen.extend(r.repo_id for r in df.collect()), str(tmp_path / "dead"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert seen == ["r"] and [r.value for r in spark.read.text(str(tmp_path / "dead")).collect()] == ["nonsense"]
    src = tmp_path / "events"
    src.mkdir()
    (src / "1.json").write_text("\n".join(json.dumps({"repo_id": "r", "status": s}) for s in ("queued", "parsing", "cloning", "ready", "graphing")))
    s = spark.readStream.schema("repo_id string, status string").json(str(src))
    q = jobs.monotonic(s).writeStream.format("memory").queryName("states").outputMode("append").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert [r.status for r in spark.sql("select status from states order by progress").collect()] == ["queued", "parsing", "ready"]
