"""Queries over symbols, the code graph and chunks, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.functions.paths import terminal
from chunkloom.operators import graph as G
from chunkloom.operators import lookup as L
from chunkloom.session import table

PATTERN = r"raise \w+Error"
FIRST, LAST = 2, 6


def _t(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, d, "symbols"), table(spark, d, "edges"), table(spark, d, "chunks")


def _by_terminal(symbols: DataFrame) -> DataFrame:
    """A query for the last part of every symbol's name in its repository."""
    return symbols.select("repo_id", terminal(F.col("qualified_name")).alias("symbol")).distinct().select(F.lit("t").alias("query_id"), "repo_id", "symbol")


def _by_name(symbols: DataFrame) -> DataFrame:
    """A query for every symbol by its whole name."""
    return symbols.select(F.concat_ws("|", "repo_id", "qualified_name").alias("query_id"), "repo_id", F.col("qualified_name").alias("symbol")).distinct()


def symbol_exact_else_suffix(spark: SparkSession, d: str) -> DataFrame:
    s, _, _ = _t(spark, d)
    return G.resolve(_by_terminal(s), s).select("repo_id", "symbol", "exact", "id")


def symbol_neighbors_in(spark: SparkSession, d: str) -> DataFrame:
    s, e, _ = _t(spark, d)
    return G.callers(_by_name(s), s, e).select("query_id", "symbol_id", "source_line")


def symbol_neighbors_out(spark: SparkSession, d: str) -> DataFrame:
    s, e, _ = _t(spark, d)
    return G.callees(_by_name(s), s, e).select("query_id", "symbol_id", "source_line")


def symbol_references(spark: SparkSession, d: str) -> DataFrame:
    s, e, _ = _t(spark, d)
    return G.references(_by_name(s), s, e).select("query_id", "symbol_id", "edge_type", "source_line")


def module_dependencies(spark: SparkSession, d: str) -> DataFrame:
    s, e, _ = _t(spark, d)
    return G.unique_locations(G.dependencies(_by_name(s), s, e))


def module_dependents(spark: SparkSession, d: str) -> DataFrame:
    s, e, _ = _t(spark, d)
    return G.unique_locations(G.dependents(_by_name(s), s, e), chunk=False)


def file_outline(spark: SparkSession, d: str) -> DataFrame:
    return G.outline(table(spark, d, "symbols"))


def _path_queries(spark: SparkSession, d: str) -> DataFrame:
    """In each repository, the first and the last function by name that call or are called."""
    s, e, _ = _t(spark, d)
    calls = G.edges_once(e, ("calls",))
    once = G.symbols_once(s)
    starts = once.join(calls.select(F.col("source_id").alias("id")).distinct(), "id", "left_semi").groupBy("repo_id").agg(F.min("qualified_name").alias("start"))
    ends = once.join(calls.select(F.col("target_id").alias("id")).distinct(), "id", "left_semi").groupBy("repo_id").agg(F.max("qualified_name").alias("end"))
    return starts.join(ends, "repo_id").select(F.col("repo_id").alias("query_id"), "repo_id", "start", "end")


def call_path_bfs(spark: SparkSession, d: str) -> DataFrame:
    s, e, _ = _t(spark, d)
    return G.call_paths(_path_queries(spark, d), s, e).select("repo_id", "found", "depth")


def call_paths(spark: SparkSession, d: str) -> DataFrame:
    s, e, _ = _t(spark, d)
    return G.call_paths(_path_queries(spark, d), s, e)


def get_chunks_ordered(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "per_question").select(F.col("row_id").alias("query_id"), F.col("retrieved_chunk_ids").alias("ids")).distinct()
    return L.ordered_chunks(q, table(spark, d, "chunks")).select("query_id", "position", "id")


def _call_points(spark: SparkSession, d: str) -> DataFrame:
    """A point for every line on which an edge starts, in its source's file."""
    s, e, _ = _t(spark, d)
    once = G.symbols_once(s).select(F.col("id").alias("source_id"), "file_path")
    p = G.edges_once(e).join(once, "source_id").select("repo_id", "file_path", F.col("source_line").alias("line")).filter("line is not null").distinct()
    return p.withColumn("point_id", F.concat_ws("|", "repo_id", "file_path", F.col("line").cast("string")))


def interval_containment(spark: SparkSession, d: str) -> DataFrame:
    return L.containing(_call_points(spark, d), table(spark, d, "chunks")).select("point_id", "id")


def interval_smallest(spark: SparkSession, d: str) -> DataFrame:
    return L.containing(_call_points(spark, d), table(spark, d, "chunks"), "smallest").select("point_id", "id")


def gt_target_resolution(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks")
    t = c.filter("id is not null").select(F.concat_ws("|", "repo_id", "file_path", "symbol_name", F.col("start_line").cast("string")).alias("target_id"), "repo_id", "file_path", "symbol_name", "start_line", F.col("start_line").alias("end_line")).distinct()
    return L.resolve_targets(t, c)


def source_resolve(spark: SparkSession, d: str) -> DataFrame:
    """The inspector's answer for every symbol, asked with its file and line."""
    s, _, c = _t(spark, d)
    r = G.symbols_once(s).select(F.col("id").alias("query_id"), "repo_id", "file_path", "line", F.col("qualified_name").alias("symbol"))
    return L.inspect_source(r, c, s)


def source_calls(spark: SparkSession, d: str) -> DataFrame:
    s, e, c = _t(spark, d)
    return L.resolved_calls(c, s, e)


def grep_caps(spark: SparkSession, d: str) -> DataFrame:
    return L.grep(table(spark, d, "source_files"), PATTERN)


def read_file_lines(spark: SparkSession, d: str) -> DataFrame:
    return L.read_lines(table(spark, d, "source_files"), FIRST, LAST)


def directory_listing(spark: SparkSession, d: str) -> DataFrame:
    return L.list_directory(table(spark, d, "source_files"), "src")


FUNCTIONS = (
    symbol_exact_else_suffix,
    symbol_neighbors_in,
    symbol_neighbors_out,
    symbol_references,
    module_dependencies,
    module_dependents,
    file_outline,
    call_path_bfs,
    call_paths,
    get_chunks_ordered,
    interval_containment,
    interval_smallest,
    gt_target_resolution,
    source_resolve,
    source_calls,
    grep_caps,
    read_file_lines,
    directory_listing,
)
QUERIES = {f.__name__: f for f in FUNCTIONS}

ONCE = "s as (select id, min(repo_id) as repo_id, min(qualified_name) as qualified_name, min(kind) as kind, min(file_path) as file_path, min(line) as line, min(chunk_id) as chunk_id from symbols where id is not null group by id), e as (select distinct repo_id, source_id, target_id, edge_type, source_line from edges)"
ONE_CHUNK = "c as (select id, min(repo_id) as repo_id, min(file_path) as file_path, min(start_line) as start_line, min(end_line) as end_line, min(symbol_name) as symbol_name from chunks where id is not null group by id)"


def _neighbours(types: str, near: str, far: str, columns: str, extra: str = "") -> str:
    return f"""with {ONCE}, q as (select distinct repo_id, qualified_name as symbol from s), m0 as (select q.repo_id, q.symbol, s.id, s.kind, s.qualified_name = q.symbol as exact from q join s on s.repo_id = q.repo_id and s.qualified_name = q.symbol),
        m as (select distinct repo_id || '|' || symbol as query_id, repo_id, id, kind from m0)
        select distinct on (query_id, symbol_id, e_type, source_line) {columns} from (select m.query_id, t.id as symbol_id, t.qualified_name, t.file_path, t.line, t.chunk_id, e.edge_type as e_type, e.source_line, m.kind as m_kind, max(m.kind = 'module') over (partition by m.query_id) as has_module
            from m join e on e.{near} = m.id and e.repo_id = m.repo_id join s t on t.id = e.{far}) where e_type in ({types}) {extra}"""


SQL = {
    "symbol_exact_else_suffix": f"""with {ONCE}, q as (select distinct repo_id, string_split(qualified_name, '.')[-1] as symbol from s),
        m as (select q.repo_id, q.symbol, s.id, s.qualified_name = q.symbol as exact from q join s on s.repo_id = q.repo_id and (s.qualified_name = q.symbol or ends_with(s.qualified_name, '.' || q.symbol)))
        select repo_id, symbol, exact, id from (select *, max(exact) over (partition by repo_id, symbol) as any_exact from m) where exact or not any_exact""",
    "symbol_neighbors_in": _neighbours("'calls'", "target_id", "source_id", "query_id, symbol_id, source_line"),
    "symbol_neighbors_out": _neighbours("'calls'", "source_id", "target_id", "query_id, symbol_id, source_line"),
    "symbol_references": _neighbours("'calls', 'references', 'imports'", "target_id", "source_id", "query_id, symbol_id, e_type as edge_type, source_line", "and (e_type <> 'imports' or has_module)"),
    "module_dependencies": "select distinct query_id, qualified_name, file_path, line, chunk_id from (" + _neighbours("'imports'", "source_id", "target_id", "query_id, qualified_name, file_path, line, chunk_id", "and m_kind = 'module'") + ")",
    "module_dependents": "select distinct query_id, qualified_name, file_path, line from (" + _neighbours("'imports'", "target_id", "source_id", "query_id, qualified_name, file_path, line", "and m_kind = 'module'") + ")",
    "file_outline": f"with {ONCE} select repo_id, file_path, line, qualified_name, kind, row_number() over (partition by repo_id, file_path order by line, qualified_name, id) as position from s",
    "call_path_bfs": f"""with recursive {ONCE},
        a as (select repo_id, min(qualified_name) as start from s where id in (select source_id from e where edge_type = 'calls') group by 1),
        z as (select repo_id, max(qualified_name) as stop from s where id in (select target_id from e where edge_type = 'calls') group by 1),
        q as (select a.repo_id, start, stop from a join z using (repo_id)),
        f as (select q.repo_id, s.id from q join s on s.repo_id = q.repo_id and s.qualified_name = q.start),
        t as (select q.repo_id, s.id from q join s on s.repo_id = q.repo_id and s.qualified_name = q.stop),
        r(repo_id, id, depth) as (select repo_id, id, 0 from f union select r.repo_id, e.target_id, r.depth + 1 from r join e on e.repo_id = r.repo_id and e.source_id = r.id and e.edge_type = 'calls' join s on s.id = e.target_id where r.depth < 4)
        select q.repo_id, min(r.depth) is not null as found, min(r.depth) as depth from q left join t on t.repo_id = q.repo_id left join r on r.repo_id = q.repo_id and r.id = t.id group by q.repo_id""",
    "get_chunks_ordered": """with w as (select distinct row_id, retrieved_chunk_ids as ids from per_question), p as (select row_id as query_id, unnest(ids) as id, generate_subscripts(ids, 1) - 1 as position from w)
        select query_id, position, id from p where id in (select id from chunks)""",
    "interval_containment": f"""with {ONCE}, {ONE_CHUNK}, p as (select distinct e.repo_id, s.file_path, e.source_line as line from e join s on s.id = e.source_id where e.source_line is not null)
        select p.repo_id || '|' || p.file_path || '|' || p.line as point_id, arg_min(c.id, (-c.start_line, c.end_line, c.id)) as id from p join c on c.repo_id = p.repo_id and c.file_path = p.file_path and c.start_line <= p.line and c.end_line >= p.line group by 1""",
    "interval_smallest": f"""with {ONCE}, {ONE_CHUNK}, p as (select distinct e.repo_id, s.file_path, e.source_line as line from e join s on s.id = e.source_id where e.source_line is not null)
        select p.repo_id || '|' || p.file_path || '|' || p.line as point_id, arg_min(c.id, (c.end_line - c.start_line, c.id)) as id from p join c on c.repo_id = p.repo_id and c.file_path = p.file_path and c.start_line <= p.line and c.end_line >= p.line group by 1""",
    "gt_target_resolution": f"""with {ONE_CHUNK}, t as (select distinct repo_id || '|' || file_path || '|' || symbol_name || '|' || start_line as target_id, repo_id, file_path, symbol_name, start_line from chunks where id is not null),
        m as (select t.target_id, count(c.id) as matches, count(*) filter (where c.start_line = t.start_line) as exact, min(c.id) filter (where c.start_line = t.start_line) as exact_id, min(c.id) as any_id
            from t left join c on c.repo_id = t.repo_id and c.file_path = t.file_path and c.symbol_name = t.symbol_name and c.start_line <= t.start_line and c.end_line >= t.start_line group by 1)
        select target_id, case when exact = 1 then exact_id when matches = 1 then any_id end as id, matches from m""",
    "source_resolve": f"""with {ONCE}, {ONE_CHUNK}, l as (select s.id, arg_min(c.id, (c.end_line - c.start_line, c.id)) as by_line from s join c on c.repo_id = s.repo_id and c.file_path = s.file_path and c.start_line <= s.line and c.end_line >= s.line group by 1),
        n as (select a.id, arg_min((b.chunk_id, b.file_path), (b.qualified_name, b.file_path, b.line, b.id)) as x from s a join s b on b.repo_id = a.repo_id and b.qualified_name = a.qualified_name group by 1)
        select s.id as query_id, case when by_line is not null then 'chunk' when x[1] is not null then 'symbol_chunk' when x[2] is not null then 'file_outline' else 'none' end as level, coalesce(by_line, x[1]) as chunk_id,
            case when by_line is not null then s.file_path else coalesce(x[2], s.file_path) end as file_path from s left join l on l.id = s.id left join n on n.id = s.id""",
    "grep_caps": rf"""with f as (select distinct repo_id, file_path, source from source_files where strlen(source) <= 1000000), l as (select repo_id, file_path, unnest(string_split(source, chr(10))) as line, generate_subscripts(string_split(source, chr(10)), 1) as line_no from f),
        a as (select *, row_number() over (partition by repo_id, file_path order by line_no) as n from l where regexp_matches(line, 'raise \w+Error'))
        select repo_id, file_path, line_no, line from (select *, row_number() over (partition by repo_id order by file_path, line_no) as m from a where n <= 20) where m <= 500""",
    "read_file_lines": "select distinct repo_id, file_path, array_to_string(string_split(source, chr(10))[2:6], chr(10)) as text from source_files where source is not null",
    "directory_listing": """with r as (select repo_id, substr(file_path, 5) as rest from source_files where starts_with(file_path, 'src/')), f as (select distinct repo_id, string_split(rest, '/')[1] as name, contains(rest, '/') as is_dir from r)
        select repo_id, name, is_dir, row_number() over (partition by repo_id order by is_dir desc, name) as position from f where not starts_with(name, '.') and name <> '__pycache__'""",
}
