"""Symbols and the static code graph: resolution, neighbours, outlines and call paths, batched over queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkloom.session import cut

REFERENCE_TYPES, MODULE_REFERENCE_TYPES = ("calls", "references"), ("calls", "references", "imports")
LEAST_DEPTH, MOST_DEPTH, DEPTH = 1, 6, 4


def symbols_once(symbols: DataFrame) -> DataFrame:
    """Each symbol once, however often it was delivered."""
    return symbols.select("id", "repo_id", "qualified_name", "kind", "file_path", "line", "chunk_id").filter("id is not null").groupBy("id").agg(*[F.min(c).alias(c) for c in ("repo_id", "qualified_name", "kind", "file_path", "line", "chunk_id")])


def edges_once(edges: DataFrame, types: tuple[str, ...] | None = None) -> DataFrame:
    """Distinct (repo_id, source_id, target_id, edge_type, source_line); the types are pushed to the scan."""
    e = edges.select("repo_id", "source_id", "target_id", "edge_type", "source_line")
    return (e.filter(F.col("edge_type").isin(*types)) if types else e).distinct()


def resolve(queries: DataFrame, symbols: DataFrame, modules_only: bool = False) -> DataFrame:
    """(query_id, repo_id, symbol, exact, id, qualified_name, kind, file_path, line, chunk_id): what a name may mean.

    queries: (query_id, repo_id, symbol). Symbols of exactly that name, else those that end in a dot and the name. Both
    are one equality join: every dotted suffix of a symbol is a name it answers to. Null names match nothing.
    """
    s = symbols_once(symbols)
    s = s.filter("kind = 'module'") if modules_only else s
    dotted = F.split("qualified_name", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(dotted)), lambda i: F.struct(F.array_join(F.slice(dotted, i, F.size(dotted)), ".").alias("symbol"), (i == 1).alias("exact")))
    named = s.withColumn("n", F.explode(suffixes)).select("*", "n.symbol", "n.exact").drop("n")
    m = queries.select("query_id", "repo_id", "symbol").distinct().join(named, ["repo_id", "symbol"])
    w = Window.partitionBy("query_id", "repo_id", "symbol")
    m = m.withColumn("any_exact", F.max("exact").over(w)).filter(F.col("exact") | ~F.col("any_exact"))
    return m.select("query_id", "repo_id", "symbol", "exact", "id", "qualified_name", "kind", "file_path", "line", "chunk_id")


def neighbours(matches: DataFrame, symbols: DataFrame, edges: DataFrame, types: tuple[str, ...], incoming: bool) -> DataFrame:
    """(query_id, repo_id, symbol_id, qualified_name, kind, file_path, line, edge_type, source_line, chunk_id).

    The symbols at the other end of edges of the given types that start (or end, if incoming) at a match; ends that are
    no symbol are left out, as is nothing else: one row per edge line. A place of an edge is where its source has it.
    """
    near, far = ("target_id", "source_id") if incoming else ("source_id", "target_id")
    e = edges_once(edges, types).withColumnRenamed("repo_id", "edge_repo")
    m = matches.select("query_id", "repo_id", F.col("id").alias(near)).distinct()
    hit = m.join(e, near).filter("repo_id = edge_repo").drop("edge_repo")
    ends = symbols_once(symbols).select(F.col("id").alias(far), "qualified_name", "kind", "file_path", "line", "chunk_id")
    return hit.join(ends, far).select("query_id", "repo_id", F.col(far).alias("symbol_id"), "qualified_name", "kind", "file_path", "line", "edge_type", "source_line", "chunk_id")


def references(queries: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Who calls or references a symbol, and who imports it where any of its matches is a module."""
    m = resolve(queries, symbols)
    w = Window.partitionBy("query_id", "repo_id")
    m = m.withColumn("module", F.max(F.col("kind") == "module").over(w))
    rows = neighbours(m, symbols, edges, MODULE_REFERENCE_TYPES, True)
    wide = m.select("query_id", "repo_id", "module").distinct()
    return rows.join(wide, ["query_id", "repo_id"]).filter((F.col("edge_type") != "imports") | F.col("module")).drop("module")


def callers(queries: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    return neighbours(resolve(queries, symbols), symbols, edges, ("calls",), True)


def callees(queries: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    return neighbours(resolve(queries, symbols), symbols, edges, ("calls",), False)


def call_neighbours(queries: DataFrame, symbols: DataFrame, edges: DataFrame, direction: str = "both") -> DataFrame:
    """callers, callees or both, with a column direction."""
    if direction not in ("callers", "callees", "both"):
        raise ValueError("direction must be callers, callees or both")
    parts = [f(queries, symbols, edges).withColumn("direction", F.lit(n)) for n, f in (("callers", callers), ("callees", callees)) if direction in (n, "both")]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def dependencies(queries: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """What a module imports."""
    return neighbours(resolve(queries, symbols, True), symbols, edges, ("imports",), False)


def dependents(queries: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Who imports a module."""
    return neighbours(resolve(queries, symbols, True), symbols, edges, ("imports",), True)


def unique_locations(rows: DataFrame, chunk: bool = True) -> DataFrame:
    """Distinct places: (query_id, qualified_name, file_path, line[, chunk_id]); the inspector's do without the chunk."""
    return rows.select("query_id", "qualified_name", "file_path", "line", *["chunk_id"] * chunk).distinct()


def outline(symbols: DataFrame) -> DataFrame:
    """(repo_id, file_path, line, qualified_name, kind, position): the symbols of each file in order of line and name."""
    w = Window.partitionBy("repo_id", "file_path").orderBy("line", "qualified_name", "id")
    return symbols_once(symbols).withColumn("position", F.row_number().over(w)).select("repo_id", "file_path", "line", "qualified_name", "kind", "position")


def place_order(prefix: str = "") -> list[Column]:
    return [F.col(f"{prefix}{c}") for c in ("file_path", "line", "qualified_name")]


def call_paths(queries: DataFrame, symbols: DataFrame, edges: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(query_id, repo_id, found, depth, path): a shortest path of calls from one symbol to another, path an array of names.

    queries: (query_id, repo_id, start, end). Both names are resolved; all matches of start are at depth 0. Each round
    expands the frontier of all queries by one join; a node keeps the parent that first reached it, by the order of
    its own place and then the parent's id. A query leaves the loop once a target is reached, so frontiers stay those
    of open queries. Targets of one depth are told apart by place. Names that resolve to nothing are not found.
    """
    if not LEAST_DEPTH <= depth <= MOST_DEPTH:
        raise ValueError(f"depth must be {LEAST_DEPTH} to {MOST_DEPTH}")
    q = queries.select("query_id", "repo_id", "start", "end").distinct()
    ends = q.select("query_id", "repo_id", F.col("end").alias("symbol"))
    starts = q.select("query_id", "repo_id", F.col("start").alias("symbol"))
    place = symbols_once(symbols).select("id", "file_path", "line", "qualified_name")
    target = resolve(ends, symbols).select("query_id", F.col("id").alias("target"))
    frontier = resolve(starts, symbols).select("query_id", "repo_id", "id", "file_path", "line", "qualified_name").distinct().withColumn("path", F.array(F.struct("id", "qualified_name")))
    calls = cut(edges_once(edges, ("calls",)).select("repo_id", F.col("source_id").alias("id"), F.col("target_id").alias("next")).distinct())
    visited = frontier.select("query_id", "id")
    found = None
    for d in range(depth + 1):
        reached = frontier.join(target, (frontier.query_id == target.query_id) & (frontier.id == target.target)).select(frontier.query_id, frontier.repo_id, "path", "file_path", "line", frontier["id"], frontier.qualified_name)
        w = Window.partitionBy("query_id").orderBy(*place_order(), "id")
        reached = reached.withColumn("n", F.row_number().over(w)).filter("n = 1").select("query_id", "repo_id", F.lit(d).alias("depth"), "path")
        found = reached if found is None else found.unionByName(reached)
        if d == depth:
            break
        alive = frontier.join(reached.select("query_id"), "query_id", "left_anti")
        step = alive.select("query_id", "repo_id", F.col("id").alias("parent"), "path").join(calls.withColumnRenamed("id", "parent"), ["repo_id", "parent"]).select("query_id", "repo_id", "parent", "path", F.col("next").alias("id"))
        step = step.join(visited, ["query_id", "id"], "left_anti").join(place, "id")
        w = Window.partitionBy("query_id", "id").orderBy("parent")
        step = step.withColumn("n", F.row_number().over(w)).filter("n = 1")
        frontier = cut(step.select("query_id", "repo_id", "id", "file_path", "line", "qualified_name", F.array_append("path", F.struct("id", "qualified_name")).alias("path")))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier.select("query_id", "id"))
    out = q.select("query_id", "repo_id").join(found.drop("repo_id"), "query_id", "left")
    return out.select("query_id", "repo_id", F.col("path").isNotNull().alias("found"), "depth", F.coalesce(F.transform("path", lambda p: p["qualified_name"]), F.array().cast("array<string>")).alias("path"))
