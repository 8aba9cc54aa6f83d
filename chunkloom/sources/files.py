"""Files as tables: source trees, question files, event streams, and where a tree comes from."""

from __future__ import annotations

import shutil
import subprocess
import uuid
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom import schemas
from chunkloom.functions.paths import is_skipped
from chunkloom.sources.sinks import file_system

MOST_BYTES = 1_000_000
CLONE_SECONDS = 180


def clone(url: str, to: str, seconds: int = CLONE_SECONDS) -> str:
    """Clone the newest state of a repository; the commit. Runs git on the driver, prompts off.

    A directory that exists is replaced, once the clone beside it is whole.
    """
    final = Path(to)
    target = final.with_name(f".{final.name}.{uuid.uuid4().hex}")
    env = {"GIT_TERMINAL_PROMPT": "0", "PATH": "/usr/bin:/bin:/usr/local/bin"}
    try:
        subprocess.run(["git", "clone", "--depth=1", "--", url, str(target)], check=True, timeout=seconds, env=env, capture_output=True)
        commit = subprocess.run(["git", "-C", str(target), "rev-parse", "HEAD"], check=True, timeout=seconds, env=env, capture_output=True, text=True).stdout.strip()
        if final.exists():
            shutil.rmtree(final)
        target.rename(final)
    finally:
        shutil.rmtree(target, ignore_errors=True)
    return commit


def source_tree(spark: SparkSession, root: str, repo_id: str, most_bytes: int = MOST_BYTES, pattern: str = "*.py") -> tuple[DataFrame, DataFrame]:
    """(files, warnings) of a tree: (repo_id, file_path, source) and (repo_id, file_path, warning).

    Files below a skipped directory are passed over. Those that are too large or no UTF-8 become warnings; 0 is no limit.
    The contents of large files are never read.
    """
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    fs, at = file_system(spark, root)
    base = fs.resolvePath(at).toUri().getPath()  # as the scan names its files, whatever the file system
    path = F.regexp_replace("path", r"^.*?\Q" + base + r"\E/", "")
    rows = raw.select(F.lit(repo_id).alias("repo_id"), path.alias("file_path"), "length", "content").filter(~is_skipped(F.col("file_path")))
    large = rows.filter(F.col("length") > most_bytes) if most_bytes > 0 else rows.filter(F.lit(False))
    small = rows.filter(F.col("length") <= most_bytes) if most_bytes > 0 else rows

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples():
                try:
                    out.append((r.repo_id, r.file_path, bytes(r.content).decode("utf-8-sig"), None))
                except UnicodeDecodeError as e:
                    out.append((r.repo_id, r.file_path, None, f"not UTF-8: {e.reason}"))
            yield pd.DataFrame(out, columns=["repo_id", "file_path", "source", "warning"])

    read = small.select("repo_id", "file_path", "content").mapInPandas(decode, "repo_id string, file_path string, source string, warning string")
    warnings = large.select("repo_id", "file_path", F.concat(F.lit("larger than "), F.lit(most_bytes), F.lit(" bytes")).alias("warning")).unionByName(read.filter("warning is not null").drop("source"))
    return read.filter("source is not null").drop("warning"), warnings


def questions(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation questions, one JSON object a line; blank lines are passed over, a line that is wrong raises."""
    return spark.read.schema(schemas.QUESTIONS).option("mode", "FAILFAST").json(path)


def decoded_events(streams: DataFrame) -> DataFrame:
    """(query_id, seq, event, payload) of text streams (query_id, text) of blocks of event: and data: lines.

    Blocks are parted by blank lines; comment lines start with a colon; data over several lines is joined. Blocks
    without an event are passed over. seq counts from 0 in the order of the text.
    """
    blocks = streams.select("query_id", F.posexplode(F.filter(F.split(F.regexp_replace("text", "\r\n?", "\n"), r"\n[ \t]*\n+"), lambda b: F.regexp_like(b, F.lit(r"(?m)^event:")))).alias("seq", "block"))
    data = F.array_join(F.regexp_extract_all("block", F.lit(r"(?m)^data: ?(.*)$"), 1), "\n")
    return blocks.select("query_id", "seq", F.regexp_extract("block", r"(?m)^event: ?(.*)$", 1).alias("event"), data.alias("payload"))


def encoded_events(events: DataFrame) -> DataFrame:
    """(query_id, seq, text): events (query_id, seq, event, payload) as blocks of a text stream."""
    return events.select("query_id", "seq", F.concat(F.lit("event: "), "event", F.lit("\ndata: "), F.replace("payload", F.lit("\n"), F.lit("\ndata: ")), F.lit("\n\n")).alias("text"))


def external_ranks(results: DataFrame) -> DataFrame:
    """(query_id, id, file_path, score): files of an outside code search, by rank; a file's id comes from its path."""
    key = F.sha2(F.concat_ws("\x1f", "repo_slug", "file_path"), 256)
    return results.select("query_id", F.substring(key, 1, 32).alias("id"), "file_path", (1.0 / (F.col("rank") + 1)).alias("score"))
