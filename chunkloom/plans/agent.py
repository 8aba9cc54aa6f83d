"""From questions to answers, for all questions at once: route, plan, run the tools, render.

What follows the first search depends only on the question, its mode and the best hits. So a plan is a column, not a
loop: every question gets its list of steps, and each tool then runs once, as one query over all steps that ask for it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkloom.functions import intents
from chunkloom.functions.paths import is_about_tests
from chunkloom.functions.text import is_chinese
from chunkloom.operators import graph, history, lookup, retrieval, sieves
from chunkloom.session import cut

MOST_STEPS, SEARCH_K, SEEDS = 14, 5, 3
#: Places of a step in an answer, other than of the search.
SHOWN = 5
#: The tools that read the graph or the symbols of other files.
GRAPH_TOOLS = ("find_call_path", "find_definition", "find_references", "get_call_neighbors", "get_dependencies", "get_dependents")
TOOLS = ("search_code", "find_definition", "find_references", "get_call_neighbors", "find_call_path", "get_dependencies", "get_dependents", "get_file_outline", "read_file", "grep", "list_directory")
#: Headings of answers, by tool, in English and Chinese.
HEADINGS = {
    "find_definition": ("Definition matches:", "定义匹配："),
    "find_references": ("Reference matches:", "引用匹配："),
    "get_dependencies": ("Dependency matches:", "依赖项匹配："),
    "get_dependents": ("Dependent matches:", "被依赖项匹配："),
    "get_file_outline": ("File outline:", "文件结构："),
    "grep": ("Exact matches:", "精确匹配："),
}
ARGS = "map<string,string>"


def step(tool: str, **args: Column) -> Column:
    pairs = [x for k, v in args.items() for x in (F.lit(k), v.cast("string"))]
    return F.struct(F.lit(tool).alias("tool"), (F.create_map(*pairs) if pairs else F.create_map().cast(ARGS)).alias("args"))


def specialised(query: Column) -> Column:
    """The one tool that answers a question of a known kind, null where search has to."""
    q = F.lower(query)
    subject, path, direction = intents.subject(query), intents.path(query), intents.call_direction(query)
    callee = F.coalesce(subject, intents.call_subject(query))
    has = lambda p: F.regexp_like(q, F.lit(p))
    whole = F.trim(query)
    return (
        F.when(has("outline|symbols in|functions in|classes in") & path.isNotNull(), step("get_file_outline", path=path))
        .when(intents.is_dependents_query(query), step("get_dependents", module=F.coalesce(subject, whole)))
        .when(has("dependency|dependencies|imports"), step("get_dependencies", module=F.coalesce(subject, whole)))
        .when(direction.isNotNull() & callee.isNotNull(), step("get_call_neighbors", symbol=callee, direction=direction))
        .when(direction.isNotNull(), F.lit(None))
        .when(intents.is_reference_query(query), step("find_references", symbol=F.coalesce(subject, intents.reference_subject(query), whole)))
        .when(has("definition|where defined| defined"), step("find_definition", symbol=F.coalesce(subject, whole)))
    )


def plans(questions: DataFrame, seeds: DataFrame) -> DataFrame:
    """(query_id, repo_id, step, tool, args): the steps of each question in order, at most MOST_STEPS.

    questions: (query_id, repo_id, query, mode); seeds: (query_id, place, file_path, symbol_name, start_line, end_line),
    the best distinct hits of the first search. Every plan begins with that search. A question about calls walks the
    call edges of its subject, else reads the best hit and walks its edges. One of another known kind has its tool and
    ends. Others that need several looks try a path between two ends, read the hits, follow references to them and
    outline their files. Modes without the graph leave graph tools out and keep the rest.
    """
    grouped = seeds.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "file_path", "symbol_name", "start_line", "end_line"))).alias("seeds"))
    q = questions.join(grouped, "query_id", "left").withColumn("seeds", F.coalesce("seeds", F.array().cast("array<struct<place:int,file_path:string,symbol_name:string,start_line:int,end_line:int>>")))
    mode = intents.retrieval_of(F.col("mode"))
    search = step("search_code", query=F.trim("query"), k=F.lit(SEARCH_K), mode=mode["retrieval"])
    special, direction = specialised(F.col("query")), intents.call_direction(F.col("query"))
    named = F.coalesce(intents.subject(F.col("query")), intents.call_subject(F.col("query")))
    read = lambda s: step("read_file", path=s["file_path"], first=s["start_line"], last=s["end_line"])
    top = F.slice("seeds", 1, 1)
    calls = F.when(named.isNotNull(), F.array(step("get_call_neighbors", symbol=named, direction=direction))).otherwise(F.concat(F.transform(top, read), F.transform(top, lambda s: step("get_call_neighbors", symbol=s["symbol_name"], direction=direction))))
    ends = intents.flow_endpoints(F.col("query"), F.transform("seeds", lambda s: s["symbol_name"]))
    flow = F.when(ends.isNotNull(), F.array(step("find_call_path", start=ends["start"], end=ends["end"], max_depth=F.lit(graph.DEPTH)))).otherwise(F.array().cast(f"array<struct<tool:string,args:{ARGS}>>"))
    follow = F.transform(F.array_distinct(F.transform(F.filter("seeds", lambda s: s["symbol_name"] != "__module_doc__"), lambda s: s["symbol_name"])), lambda n: step("find_references", symbol=n))
    outlines = F.transform(F.array_distinct(F.transform("seeds", lambda s: s["file_path"])), lambda p: step("get_file_outline", path=p))
    several = F.when(intents.needs_multihop(F.col("query")), F.concat(flow, F.transform("seeds", read), follow, outlines)).otherwise(F.array().cast(f"array<struct<tool:string,args:{ARGS}>>"))
    full = mode["expansion"] == "full"
    allowed = special.isNotNull() & (full | ~special["tool"].isin(*GRAPH_TOOLS))
    rest = F.when(mode["expansion"] == "none", F.array().cast(f"array<struct<tool:string,args:{ARGS}>>")).when(direction.isNotNull() & full, calls).when(allowed, F.array(special)).otherwise(several)
    rest = F.filter(rest, lambda s: full | ~s["tool"].isin(*GRAPH_TOOLS))
    steps = F.slice(F.concat(F.array(search), rest), 1, MOST_STEPS)
    out = q.select("query_id", "repo_id", F.posexplode(steps).alias("step", "s"))
    return out.select("query_id", "repo_id", (F.col("step") + 1).alias("step"), "s.tool", "s.args")


def first_search(questions: DataFrame, chunks: DataFrame, query_vectors: DataFrame | None = None, dim: int = 0, k: int = SEARCH_K) -> DataFrame:
    """(query_id, id, file_path, start_line, rank): the k best chunks of each question, by its mode.

    Dense search falls back to sparse for questions without a vector. Tests are left out unless a question is about them.
    """
    mode = intents.retrieval_of(F.col("mode"))["retrieval"]
    asked = questions.select("query_id", "repo_id", F.col("query").alias("text"), "mode")
    sparse = retrieval.sparse_search(asked, chunks)
    empty = sparse.limit(0).withColumnRenamed("sparse_score", "dense_score")
    dense = retrieval.dense_search(query_vectors, chunks, dim) if query_vectors is not None else empty
    found = dense.select("query_id").distinct().withColumn("has_dense", F.lit(True))
    kinds = asked.select("query_id", mode.alias("retrieval"), is_about_tests(F.col("text")).alias("about_tests")).join(found, "query_id", "left").withColumn("has_dense", F.coalesce("has_dense", F.lit(False)))
    s = sparse.join(kinds.filter("retrieval <> 'dense' or not has_dense").select("query_id"), "query_id", "left_semi")
    d = dense.join(kinds.filter("retrieval <> 'sparse'").select("query_id"), "query_id", "left_semi")
    best = retrieval.rerank(retrieval.fuse(s, d)).join(kinds.select("query_id", "about_tests"), "query_id")
    return retrieval.take(best, k, F.col("about_tests")).select("query_id", "id", "file_path", "start_line", "rank")


def _asked(steps: DataFrame, tool: str, arg: str, column: str) -> DataFrame:
    """The steps of a tool as its queries; the key of a query is its question and step."""
    key = F.concat_ws("\x1f", "query_id", F.col("step").cast("string")).alias("query_id")
    return steps.filter(F.col("tool") == tool).select(key, "repo_id", F.col("args")[arg].alias(column), "args")


def named_ids(asked: DataFrame, symbols: DataFrame) -> DataFrame:
    """A sieve of the symbols that answer to a name that is asked for in their repository. asked: (repo_id, symbol)."""
    wanted = cut(sieves.sieve(asked.select("repo_id", "symbol")))
    dotted = F.split("qualified_name", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(dotted)), lambda i: F.array_join(F.slice(dotted, i, F.size(dotted)), "."))
    named = sieves.kept(symbols.filter("qualified_name is not null").select("id", "repo_id", F.explode(suffixes).alias("symbol")), wanted, "repo_id", "symbol")
    return cut(sieves.sieve(named.select("id")))


def among(symbols: DataFrame, **held: tuple[DataFrame, tuple[str, ...]]) -> DataFrame:
    """The symbols that one of the sieves may hold by its columns."""
    for name, (s, columns) in held.items():
        symbols = sieves.marked(symbols, s, name, *columns)
    return symbols.filter(reduce(lambda x, y: x | y, [F.col(n) for n in held])).drop(*held)


def near(asked: DataFrame, symbols: DataFrame, edges: DataFrame, again: DataFrame, types: tuple[str, ...], incoming: bool) -> tuple[DataFrame, DataFrame]:
    """(symbols, edges) that are all that graph.neighbours() can meet from the names asked for.

    Whatever has an id that came more than once stays, as its columns may be those of several rows.
    """
    start, end = ("target_id", "source_id") if incoming else ("source_id", "target_id")
    named = named_ids(asked, symbols)
    ids = among(symbols.select("id"), named=(named, ("id",)), again=(again, ("id",)))
    e = sieves.kept(edges.filter(F.col("edge_type").isin(*types)), cut(sieves.sieve(ids)), start)
    ends = cut(sieves.sieve(e.select(end)))
    return among(symbols, named=(named, ("id",)), ends=(ends, ("id",)), again=(again, ("id",))), e


def walked(paths: DataFrame, symbols: DataFrame, edges: DataFrame, again: DataFrame) -> DataFrame | None:
    """(query_id, ordinal, symbol, file_path, line, chunk_id): the nodes of the paths that are found; None where no path has both ends."""
    ends = paths.select("query_id", "repo_id", F.explode(F.array("start", "end")).alias("symbol")).distinct()
    named = named_ids(ends, symbols)
    known = graph.resolve(ends, among(symbols, named=(named, ("id",)), again=(again, ("id",)))).select("repo_id", "symbol").distinct()
    side = lambda c: known.withColumnRenamed("symbol", c)
    both = cut(paths.join(side("start"), ["repo_id", "start"], "left_semi").join(side("end"), ["repo_id", "end"], "left_semi"))
    if both.isEmpty():
        return None
    e = sieves.kept(edges.filter("edge_type = 'calls'"), cut(sieves.sieve(both.select("repo_id"))), "repo_id")
    called = cut(sieves.sieve(e.select("target_id")))
    s = among(symbols, named=(named, ("id",)), called=(called, ("id",)), again=(again, ("id",)))
    nodes = cut(graph.call_paths(both.select("query_id", "repo_id", "start", "end"), s, e).select("query_id", "repo_id", F.posexplode("path").alias("ordinal", "qualified_name")))
    alike = among(symbols, alike=(cut(sieves.sieve(nodes.select("repo_id", "qualified_name"))), ("repo_id", "qualified_name")), again=(again, ("id",)))
    once = graph.symbols_once(alike).groupBy("repo_id", "qualified_name").agg(*[F.min(c).alias(c) for c in ("file_path", "line", "chunk_id")])
    return nodes.join(once, ["repo_id", "qualified_name"]).select("query_id", (F.col("ordinal") + 1).alias("ordinal"), F.col("qualified_name").alias("symbol"), "file_path", "line", "chunk_id")


def observations(steps: DataFrame, hits: DataFrame, chunks: DataFrame, symbols: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """(query_id, step, tool, ordinal, symbol, file_path, line, chunk_id): what every step found, each tool run once for all.

    Steps that read a file give its place; their text is left to lookup.read_lines. most: of each step that looks into
    symbols or edges, only so many places are wanted. Tools no step asks for are not run, and each sees only the symbols
    and edges that it may meet.
    """
    used = {r.tool for r in steps.select("tool").distinct().collect()}  # at most the number of tools
    named = retrieval.one_per_id(chunks, "symbol_name")
    found = hits.join(named, "id").select("query_id", F.lit(1).alias("step"), F.lit("search_code").alias("tool"), F.col("rank").alias("ordinal"), F.col("symbol_name").alias("symbol"), "file_path", F.col("start_line").alias("line"), F.col("id").alias("chunk_id"))
    symbols = symbols.select("id", "repo_id", "qualified_name", "kind", "file_path", "line", "chunk_id").filter("id is not null")
    again = cut(sieves.repeated(symbols, "id"))

    def located(rows: DataFrame, tool: str, order: list[str]) -> DataFrame:
        part = F.split("query_id", "\x1f")
        places = rows.select("query_id", F.col("qualified_name").alias("symbol"), "file_path", "line", "chunk_id")
        w = Window.partitionBy("query_id").orderBy(*[F.asc(c) for c in order])  # all columns of a place, so equal places have one number
        ordered = places.withColumn("ordinal", F.dense_rank().over(w))
        ordered = (ordered if most is None else ordered.filter(F.col("ordinal") <= most)).distinct()
        return ordered.select(part[0].alias("query_id"), part[1].cast("int").alias("step"), F.lit(tool).alias("tool"), "ordinal", "symbol", "file_path", "line", "chunk_id")

    place = ["file_path", "line", "symbol", "chunk_id"]
    parts = [found]
    if "find_definition" in used:
        asked = _asked(steps, "find_definition", "symbol", "symbol")
        parts.append(located(graph.resolve(asked, among(symbols, named=(named_ids(asked, symbols), ("id",)), again=(again, ("id",)))), "find_definition", ["symbol", "file_path", "line", "chunk_id"]))
    for tool, walk, arg, types, incoming in (
        ("find_references", graph.references, "symbol", graph.MODULE_REFERENCE_TYPES, True),
        ("get_dependencies", graph.dependencies, "module", ("imports",), False),
        ("get_dependents", graph.dependents, "module", ("imports",), True),
    ):
        if tool in used:
            asked = _asked(steps, tool, arg, "symbol")
            parts.append(located(walk(asked, *near(asked, symbols, edges, again, types, incoming)), tool, place))
    if "get_call_neighbors" in used:
        asked = _asked(steps, "get_call_neighbors", "symbol", "symbol")
        sides = []
        for side, walk, incoming in (("callers", graph.callers, True), ("callees", graph.callees, False)):
            some = asked.filter(F.col("args")["direction"].isin(side, "both"))
            sides.append(walk(some, *near(some, symbols, edges, again, ("calls",), incoming)))
        parts.append(located(sides[0].unionByName(sides[1]), "get_call_neighbors", place))
    if "get_file_outline" in used:
        files = _asked(steps, "get_file_outline", "path", "file_path")
        inside = among(symbols, inside=(cut(sieves.sieve(files.select("repo_id", "file_path"))), ("repo_id", "file_path")), again=(again, ("id",)))
        parts.append(located(files.join(graph.symbols_once(inside), ["repo_id", "file_path"]), "get_file_outline", place))
    if "find_call_path" in used:
        paths = steps.filter("tool = 'find_call_path'").select(F.concat_ws("\x1f", "query_id", F.col("step").cast("string")).alias("query_id"), "repo_id", F.col("args")["start"].alias("start"), F.col("args")["end"].alias("end"))
        nodes = walked(paths, symbols, edges, again)
        if nodes is not None:
            part = F.split("query_id", "\x1f")
            parts.append(nodes.select(part[0].alias("query_id"), part[1].cast("int").alias("step"), F.lit("find_call_path").alias("tool"), "ordinal", "symbol", "file_path", "line", "chunk_id"))
    reads = steps.filter("tool = 'read_file'").select("query_id", "step", "tool", F.lit(1).alias("ordinal"), F.col("args")["path"].alias("symbol"), F.col("args")["path"].alias("file_path"), F.col("args")["first"].cast("int").alias("line"), F.lit(None).cast("string").alias("chunk_id"))
    return reduce(DataFrame.unionByName, [*parts, reads])


def evidence(found: DataFrame) -> DataFrame:
    """Observations as merged and numbered evidence, in the order in which the steps came upon it."""
    o = found.select("query_id", (F.col("step") * 1_000_000 + F.col("ordinal")).cast("int").alias("ordinal"), F.col("tool").alias("origin"), F.concat_ws(":", "file_path", F.col("line").cast("string")).alias("token"), "chunk_id", "symbol", F.lit("").alias("content"), F.lit(None).cast("double").alias("score"))
    return history.merged_evidence(o)


def rendered(questions: DataFrame, steps: DataFrame, found: DataFrame) -> DataFrame:
    """(query_id, answer): a templated answer in the question's language: three hits of the search, five places of each other step."""
    zh = is_chinese(F.col("query"))
    kept = found.filter(F.col("ordinal") <= F.when(F.col("tool") == "search_code", 3).otherwise(SHOWN))
    lines = kept.groupBy("query_id", "step", "tool").agg(F.array_sort(F.collect_list(F.struct("ordinal", "symbol", "file_path", "line"))).alias("places"))
    b = steps.select("query_id", "step", "tool", "args").join(lines.select("query_id", "step", "places"), ["query_id", "step"], "left").join(questions.select("query_id", "query"), "query_id")
    item = lambda p: F.when(zh, F.format_string("- `%s`，位于 `%s:%d`", p["symbol"], p["file_path"], p["line"])).otherwise(F.format_string("- `%s` at `%s:%d`", p["symbol"], p["file_path"], p["line"]))
    head = F.when(F.col("tool") == "search_code", F.when(zh, F.format_string("与 `%s` 最相关的代码结果：", "query")).otherwise(F.format_string("Top code hits for `%s`:", "query")))
    for tool, (en, cn) in HEADINGS.items():
        head = head.when(F.col("tool") == tool, F.when(zh, F.lit(cn)).otherwise(F.lit(en)))
    head = head.when(F.col("tool") == "get_call_neighbors", F.when(zh, F.format_string("`%s` 的静态调用关系：", F.col("args")["symbol"])).otherwise(F.format_string("Resolved static call relationships for `%s`:", F.col("args")["symbol"]))).otherwise(F.col("tool"))
    none = F.when(zh, F.format_string("没有找到与 `%s` 相关的结果。", "query")).otherwise(F.format_string("No results found for `%s`.", "query"))
    block = F.when(F.col("places").isNull(), none).otherwise(F.concat(head, F.lit("\n"), F.array_join(F.transform("places", item), "\n")))
    b = b.withColumn("block", block).filter("places is not null or step = 1")
    return b.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", "block"))), lambda x: x["block"]), "\n\n").alias("answer"))


def answered(questions: DataFrame, chunks: DataFrame, symbols: DataFrame, edges: DataFrame, query_vectors: DataFrame | None = None, dim: int = 0) -> DataFrame:
    """(query_id, answer) for questions (query_id, repo_id, query, mode): search, plan, run, render."""
    hits = cut(first_search(questions, chunks, query_vectors, dim))
    c = sieves.kept(chunks.select("id", "symbol_name", "end_line"), cut(sieves.sieve(hits.select("id"))), "id")
    seeds = history.seeds(hits.join(retrieval.one_per_id(c, "symbol_name", "end_line"), "id").withColumn("rank", F.col("rank")), SEEDS)
    ends = hits.join(retrieval.one_per_id(c, "symbol_name", "end_line"), "id").select("query_id", "file_path", "symbol_name", "start_line", "end_line").distinct()
    steps = cut(plans(questions, seeds.join(ends, ["query_id", "file_path", "symbol_name", "start_line"])))
    return rendered(questions, steps, cut(observations(steps, hits, c, symbols, edges, SHOWN)))


def bind_history(questions: DataFrame, turns: DataFrame) -> DataFrame:
    """questions whose query is about calls and names nothing get the name that the conversation last meant put before it."""
    s = history.recent_symbol(turns).withColumnRenamed("conv_id", "query_id")
    named = F.coalesce(intents.subject(F.col("query")), intents.call_subject(F.col("query")))
    j = questions.join(s, "query_id", "left")
    return j.withColumn("query", F.when(intents.call_direction(F.col("query")).isNotNull() & named.isNull() & F.col("symbol").isNotNull(), F.concat(F.lit("`"), "symbol", F.lit("` "), "query")).otherwise(F.col("query"))).drop("symbol")


#: The tools by name, as functions of DataFrames; a caller may add its own.
REGISTRY: dict[str, Callable[..., DataFrame]] = {
    "search_code": first_search,
    "find_definition": graph.resolve,
    "find_references": graph.references,
    "get_call_neighbors": graph.call_neighbours,
    "find_call_path": graph.call_paths,
    "get_dependencies": graph.dependencies,
    "get_dependents": graph.dependents,
    "get_file_outline": graph.outline,
    "read_file": lookup.read_lines,
    "grep": lookup.grep,
    "list_directory": lookup.list_directory,
}
