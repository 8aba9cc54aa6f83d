"""Source files that do not parse in the language of their extension.

Every file goes through the lexer and pushdown parser of its language. Those of JSON, TOML, XML and JavaScript decide
the whole grammar. That of Python takes what it can prove to be well formed; the few files that it does not take
are held against the exact grammar afterwards, which may clear them, and keep the defect the lexer saw.
"""

from __future__ import annotations

import ast
import sys
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.llm import datalex, jslex, pylex
from chunkloom.session import spread

LANGUAGES = {"py": "python", "json": "json", "toml": "toml", "xml": "xml", "js": "javascript"}
ACCEPT = {"py": pylex.statements, "json": datalex.json, "toml": datalex.toml, "xml": datalex.xml, "js": jslex.javascript}
#: Calls that a character of source can open at most; the frames lie on the heap, so depth is bounded by memory alone.
CALLS = 16


def parses(source: str) -> bool:
    """The exact check for Python; files that nest too deeply for its own parser count as broken."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            ast.parse(source)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return False
    return True


def defect(extension: str, source: str) -> str | None:
    """The kind of defect of a file, None where it parses.

    Kinds: merge_conflict, unterminated_literal, unbalanced_delimiter, premature_end, invalid_token, indentation,
    grammar. An empty file parses in Python, TOML and JavaScript, not in JSON and XML.
    """
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(20_000 + CALLS * len(source))
    try:
        ACCEPT[extension](source)
    except pylex.Reject as e:
        if extension == "py" and parses(source):
            return None
        return "merge_conflict" if pylex.MARKER.search(source) else str(e)
    finally:
        sys.setrecursionlimit(limit)
    return None


def checked(files: DataFrame) -> DataFrame:
    """(repo_id, file_path, language, defect) of every row whose extension has a grammar here and whose source is given.

    Null keys and sources and other extensions are left out. Repeated rows give repeated rows.
    """
    ext = F.regexp_extract("file_path", r"\.([A-Za-z]+)$", 1)
    rows = files.filter(F.col("source").isNotNull() & F.col("repo_id").isNotNull() & ext.isin(*LANGUAGES)).select("repo_id", "file_path", ext.alias("ext"), "source")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ext, source = b.column(2).to_pylist(), b.column(3).to_pylist()
            found = pa.array([defect(e, s) for e, s in zip(ext, source, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([LANGUAGES[e] for e in ext], pa.string()), found], ["repo_id", "file_path", "language", "defect"])

    return spread(rows, "repo_id", "file_path").mapInArrow(run, "repo_id string, file_path string, language string, defect string")


def broken_files(files: DataFrame) -> DataFrame:
    """(repo_id, file_path, language, defect), one row per file that does not parse; of several defects the first by name."""
    return checked(files).filter("defect is not null").groupBy("repo_id", "file_path").agg(F.min("language").alias("language"), F.min("defect").alias("defect"))


def broken_rates(files: DataFrame) -> DataFrame:
    """(repo_id, language, files, broken, rate); each file counts once, however often it was delivered.

    Files are counted by key first and by repository after that; both steps combine on the map side, so a
    repository that owns a third of the files makes no large group.
    """
    once = checked(files).groupBy("repo_id", "language", "file_path").agg(F.max(F.when(F.col("defect").isNotNull(), 1).otherwise(0)).alias("b"))
    return once.groupBy("repo_id", "language").agg(F.count("*").alias("files"), F.sum("b").alias("broken"), F.round(F.avg("b"), 6).alias("rate"))
