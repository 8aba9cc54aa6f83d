"""Look-ups of chunks: by id, by line, by target, and the places of calls in source text."""

from __future__ import annotations

import ast
import builtins
import textwrap
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chunkloom.functions import paths
from chunkloom.operators.retrieval import one_per_id

MOST_IDS = 64
#: Lines of a file share a bucket of so many, so that a line meets the chunks around it by an equality join.
LINES = 64

#: Methods of containers that say nothing about a program's calls.
ROUTINE_METHODS = frozenset("add append clear copy discard extend get insert items keys pop remove setdefault sort update values".split())
BUILTINS = frozenset(dir(builtins))


def ordered_chunks(requests: DataFrame, chunks: DataFrame, most: int = MOST_IDS) -> DataFrame:
    """(query_id, position, id, file_path, start_line, end_line, symbol_name): the chunks asked for, in the order asked.

    requests: (query_id, ids). Ids beyond `most` are refused with an error, unknown ones left out; an id asked for twice
    comes twice.
    """
    checked = requests.withColumn("ids", F.when(F.size("ids") <= most, F.col("ids")).otherwise(F.raise_error(F.lit(f"more than {most} ids"))))
    wanted = checked.select("query_id", F.posexplode("ids").alias("position", "id"))
    c = one_per_id(chunks, "file_path", "start_line", "end_line", "symbol_name")
    return wanted.join(c, "id").select("query_id", "position", "id", "file_path", "start_line", "end_line", "symbol_name")


def spans(chunks: DataFrame) -> DataFrame:
    """Each chunk once per bucket of lines that it touches."""
    c = one_per_id(chunks, "repo_id", "file_path", "start_line", "end_line", "symbol_name").filter("start_line <= end_line")
    return c.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start_line") / LINES), F.floor(F.col("end_line") / LINES))))


def containing(points: DataFrame, chunks: DataFrame, order: str = "latest") -> DataFrame:
    """(…points, id, symbol_name, start_line, end_line): for each point the chunk whose lines hold its line, if any.

    points: (point_id, repo_id, file_path, line). Of several chunks, `latest` takes the one that starts last, then ends
    first; `smallest` the shortest. Ties fall to the smaller id. Points in no chunk are left out.
    """
    orders = {"latest": [F.desc("start_line"), F.asc("end_line"), F.asc("id")], "smallest": [F.asc(F.col("end_line") - F.col("start_line")), F.asc("id")]}
    p = points.withColumn("bucket", F.floor(F.col("line") / LINES))
    hit = p.join(spans(chunks), ["repo_id", "file_path", "bucket"]).filter("start_line <= line and end_line >= line").drop("bucket")
    w = Window.partitionBy("point_id").orderBy(*orders[order])
    return hit.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def resolve_targets(targets: DataFrame, chunks: DataFrame) -> DataFrame:
    """(target_id, id, matches): the chunk of each target of an evaluation question; id is null where none or several fit.

    targets: (target_id, repo_id, file_path, symbol_name, start_line, end_line), the last three nullable. A chunk fits
    if its file is equal, its symbol too where one is given, and its lines hold the lines given. One that starts on the
    target's line wins if it is the only such, else one that is the only match.
    """
    c = one_per_id(chunks, "repo_id", "file_path", "symbol_name", "start_line", "end_line")
    c = c.select("id", F.col("repo_id").alias("r"), F.col("file_path").alias("f"), F.col("symbol_name").alias("s"), F.col("start_line").alias("a"), F.col("end_line").alias("z"))
    inside = lambda line: line.isNull() | ((F.col("a") <= line) & (F.col("z") >= line))
    t = targets.alias("t")
    fits = (F.col("r") == F.col("t.repo_id")) & (F.col("f") == F.col("t.file_path")) & (F.col("t.symbol_name").isNull() | (F.col("s") == F.col("t.symbol_name"))) & inside(F.col("t.start_line")) & inside(F.col("t.end_line"))
    m = t.join(c, fits, "left").groupBy("target_id").agg(F.count("id").alias("matches"), F.count_if(F.col("a") == F.col("t.start_line")).alias("exact"), F.min(F.when(F.col("a") == F.col("t.start_line"), F.col("id"))).alias("exact_id"), F.min("id").alias("any_id"))
    return m.select("target_id", F.when(F.col("exact") == 1, F.col("exact_id")).when(F.col("matches") == 1, F.col("any_id")).alias("id"), "matches")


def source_calls(chunks: DataFrame) -> DataFrame:
    """(chunk_id, repo_id, file_path, line, position, expression, terminal, plain): the calls in the text of each chunk.

    In order of line and column. plain marks calls of a bare name. Text that does not parse gives no row.
    """
    c = one_per_id(chunks, "repo_id", "file_path", "start_line", "content").filter("content is not null and start_line is not null")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples():
                try:
                    tree = ast.parse(textwrap.dedent(r.content))
                except (SyntaxError, ValueError, RecursionError):
                    continue
                calls = sorted((n for n in ast.walk(tree) if isinstance(n, ast.Call)), key=lambda n: (n.lineno, n.col_offset))
                for i, n in enumerate(calls):
                    name = n.func.id if isinstance(n.func, ast.Name) else n.func.attr if isinstance(n.func, ast.Attribute) else ""
                    out.append((r.id, r.repo_id, r.file_path, r.start_line + n.lineno - 1, i, ast.unparse(n.func), name, isinstance(n.func, ast.Name)))
            yield pd.DataFrame(out, columns=["chunk_id", "repo_id", "file_path", "line", "position", "expression", "terminal", "plain"])

    return c.select("id", "repo_id", "file_path", "start_line", "content").mapInPandas(run, "chunk_id string, repo_id string, file_path string, line int, position int, expression string, terminal string, plain boolean")


def resolved_calls(chunks: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(chunk_id, line, position, expression, target): calls with the symbol each resolves to, null where to none.

    A call resolves if exactly one edge of its chunk's symbol on its line ends at a symbol of the called name. Calls
    that resolve to none are kept unless they are of a builtin or a container's routine method, or of no name.
    """
    from chunkloom.operators.graph import edges_once, symbols_once

    s = symbols_once(symbols)
    e = edges_once(edges, ("calls",)).join(s.select(F.col("id").alias("source_id"), "chunk_id").filter("chunk_id is not null"), "source_id")
    e = e.join(s.select(F.col("id").alias("target_id"), "qualified_name"), "target_id").select("chunk_id", F.col("source_line").alias("line"), paths.terminal(F.col("qualified_name")).alias("terminal"), F.col("qualified_name").alias("target")).distinct()
    one = e.groupBy("chunk_id", "line", "terminal").agg(F.count("*").alias("n"), F.min("target").alias("target")).filter("n = 1").drop("n")
    calls = source_calls(chunks).join(one, ["chunk_id", "line", "terminal"], "left")
    dull = (F.col("terminal") == "") | F.when(F.col("plain"), F.col("terminal").isin(*sorted(BUILTINS))).otherwise(F.col("terminal").isin(*sorted(ROUTINE_METHODS)))
    return calls.filter(F.col("target").isNotNull() | ~dull).select("chunk_id", "line", "position", "expression", "target")


def call_summary(calls: DataFrame) -> DataFrame:
    """(chunk_id, calls, resolved, unresolved) of resolved_calls(): how many there are, and how many end at a symbol or at none."""
    return calls.groupBy("chunk_id").agg(F.count("*").alias("calls"), F.count("target").alias("resolved"), F.count_if(F.col("target").isNull()).alias("unresolved"))


def callees_in_source(queries: DataFrame, chunks: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, chunk_id, line, position, expression, target): the calls in the text of the symbols that (query_id, repo_id, symbol) name.

    They go with graph.call_neighbours(), which knows only calls that end at a symbol. Only chunks asked for are parsed.
    """
    from chunkloom.operators.graph import resolve

    named = resolve(queries, symbols).filter("chunk_id is not null").select("query_id", "chunk_id").distinct()
    asked = chunks.join(named.select(F.col("chunk_id").alias("id")).distinct(), "id", "left_semi")
    return resolved_calls(asked, symbols, edges).join(named, "chunk_id").select("query_id", "chunk_id", "line", "position", "expression", "target")


def inspect_source(requests: DataFrame, chunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """(query_id, level, chunk_id, file_path): what the source inspector shows for (query_id, repo_id, file_path, line, symbol).

    Levels: chunk (the shortest around file and line), symbol_chunk, file_outline (of the symbol's file), none.
    """
    from chunkloom.operators.graph import resolve

    at = containing(requests.filter("file_path is not null and line is not null").select(F.col("query_id").alias("point_id"), "repo_id", "file_path", "line"), chunks, "smallest").select(F.col("point_id").alias("query_id"), F.col("id").alias("by_line"), F.col("file_path").alias("line_file"))
    w = Window.partitionBy("query_id").orderBy("qualified_name", "file_path", "line", "id")
    named = resolve(requests.filter("symbol is not null"), symbols).withColumn("n", F.row_number().over(w)).filter("n = 1").select("query_id", F.col("chunk_id").alias("by_symbol"), F.col("file_path").alias("symbol_file"))
    r = requests.join(at, "query_id", "left").join(named, "query_id", "left")
    level = F.when(F.col("by_line").isNotNull(), "chunk").when(F.col("by_symbol").isNotNull(), "symbol_chunk").when(F.col("symbol_file").isNotNull(), "file_outline").otherwise("none")
    return r.select("query_id", level.alias("level"), F.coalesce("by_line", "by_symbol").alias("chunk_id"), F.coalesce("line_file", "symbol_file", "file_path").alias("file_path"))


def grep(files: DataFrame, pattern: str, per_file: int = 20, total: int = 500, most_bytes: int = 1_000_000) -> DataFrame:
    """(repo_id, file_path, line_no, line): the first lines of each file that match, so many per file and repository.

    files: (repo_id, file_path, source). Files that are larger than most_bytes are passed over, as are null sources.
    """
    f = files.select("repo_id", "file_path", "source").filter(F.octet_length("source") <= most_bytes).distinct()
    lines = f.select("repo_id", "file_path", F.posexplode(F.split("source", "\n")).alias("at", "line")).filter(F.regexp_like("line", F.lit(pattern)))
    w = Window.partitionBy("repo_id", "file_path").orderBy("at")
    hit = lines.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= per_file)
    w = Window.partitionBy("repo_id").orderBy("file_path", "at")
    hit = hit.withColumn("m", F.row_number().over(w)).filter(F.col("m") <= total)
    return hit.select("repo_id", "file_path", (F.col("at") + 1).alias("line_no"), "line")


def read_lines(files: DataFrame, first: int, last: int) -> DataFrame:
    """(repo_id, file_path, text): lines first to last, counted from 1, of each file; raises on a wrong range."""
    if first < 1 or last < first:
        raise ValueError("lines must be 1 <= first <= last")
    f = files.select("repo_id", "file_path", "source").filter("source is not null").distinct()
    return f.select("repo_id", "file_path", F.array_join(F.slice(F.split("source", "\n"), first, last - first + 1), "\n").alias("text"))


def list_directory(files: DataFrame, directory: str = "") -> DataFrame:
    """(repo_id, name, is_dir, position): what lies directly in a directory, directories first, hidden names left out."""
    under = f"{directory.strip('/')}/" if directory.strip("/") else ""
    rest = F.substring("file_path", len(under) + 1, 2**30)
    f = files.filter(F.startswith("file_path", F.lit(under))).select("repo_id", F.substring_index(rest, "/", 1).alias("name"), F.contains(rest, F.lit("/")).alias("is_dir")).distinct()
    f = f.filter(~F.startswith("name", F.lit(".")) & (F.col("name") != "__pycache__"))
    w = Window.partitionBy("repo_id").orderBy(F.desc("is_dir"), "name")
    return f.withColumn("position", F.row_number().over(w))
