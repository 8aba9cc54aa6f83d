"""Files that nobody wrote by hand: generated, minified, copied in or mere data.

Notices in the header label files for training. They are hidden from the features, so that a random forest learns what
such files look like: how well they compress, how their characters, tokens and identifiers are spread, how alike their
lines are, how much is comment, digits or encoded text, how much of their code turns up in other repositories, and
whether the path is of a conventional kind, which labels a file too. Data carry no notice, so a file is labelled as
well where more than half of it are rows of numbers and long encoded words; that measure is hidden from the features.

Many such files carry no notice, so the labels are positive or unknown, and a file that looks like labelled ones has a
score well below 1. A file comes out if labels are at least LIFT times as likely among its like as among all files. Two forests
learn from one half of the files each and judge the other half.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkloom.session import cut, spread

#: Wording of notices. Each must say that the file itself was made or brought in, not be about such files.
NOTICE = re.compile(
    r"""(?ix)
      @generated\b
    | \bauto-?\s?generated\b (?:\s+(?:by|from|with|using|on|file|code)\b | [.:!]? \s* (?:do\ not|please) )
    | (?:^|[\s"'*/#]) generated\ (?:by|from|with|using)\b [^\n]* (?: \n | .)*? \b(?:do\ not\ (?:edit|modify|change|touch)|changes\ will\ be\ lost|\d)
    | \b(?:produced|created|written|built)\ (?:automatically|mechanically)\b
    | \b(?:auto|machine)[- ](?:created|made|written|produced|built)\b
    | \b(?:manual|hand|local)\ (?:changes|edits|modifications)\ (?:will\ be|are)\ (?:lost|overwritten|not\ kept)\b
    | \bdo\ not\ (?:edit|modify)(?:\ this\ file|\ by\ hand|\ manually)?\s*[.!]*\s*(?:$|\n|"|'|\*/|-->)
    | \btaken\ unchanged\ from\b
    | \bvendored\ (?:copy\ (?:of|from)|from|version\ of|in\ from)\b
    | \b(?:bundled|embedded|included)\ third[- ]party\ (?:module|library|code|package)\b
    | \b(?:imported|copied|synced|mirrored)\ (?:verbatim\ |unchanged\ |as\ is\ )?from\ (?:the\ )?\S+\ (?:project|upstream|repository|release|distribution)
    | \bcopyright\ \(c\)\ (?:the\ )?\S+\ contributors\b
    | \bupstream\ release\ archive\b
    """
)
#: A banner that bundlers keep; it labels for training like a notice.
BANNER = re.compile(r"\A\s*/\*!")
HEADER = re.compile(
    r"""\A(?:\#![^\n]*\n)?(?:\s*(?:[rRuU]?\"\"\"[\s\S]*?(?:\"\"\"|\Z)|[rRuU]?'''[\s\S]*?(?:'''|\Z)|[rRuU]?"[^"\n]*"|[rRuU]?'[^'\n]*'(?=\s*$)|/\*[\s\S]*?\*/|<!--[\s\S]*?-->|(?:(?:\#|//|;|--)[^\n]*(?:\n|\Z))+))+""",
    re.M,
)
LANGUAGE_COMMENT = re.compile(r"(?m)(?:#|//)[^\n]*|/\*[\s\S]*?\*/|\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|<!--[\s\S]*?-->")
IDENTIFIER = re.compile(r"[^\W\d]\w*")
LONG_TOKEN = re.compile(r"[A-Za-z0-9+/=_-]{40,}")
LEXICAL = re.compile(r"\w+|[^\w\s]")
LITERAL = re.compile(r""""[^"\\\n]*"|'[^'\\\n]*'|\d[\w.]*""")
NAMES = re.compile(r"[^\W\d]\w*")
#: Rows of numbers, at least eight of them, with what parts them.
NUMBERS = re.compile(r"(?:(?<![\w.])[-+]?(?:0[xX][0-9a-fA-F]+|\d[\d_]*(?:\.\d*)?(?:[eE][-+]?\d+)?)[\s,;|]+){8,}")
COPIED_PATH = r"(?i)(?:^|/)(?:vendor|_vendor|third[_-]?party|node_modules|bower_components|extern|externals?|deps|site-packages|godeps|dist-packages)/"
MADE_PATH = r"(?i)(?:_pb2(?:_grpc)?|[._-]generated|\.gen|\.g|_gen)\.\w+$"
SHRUNK_PATH = r"(?i)[.-](?:min|bundle|packed|compiled)\.\w+$"

#: Sums over the chunks of a file, by name.
SUMS = ["chars", "lines", "digits", "spaces", "coded", "comments", "names", "name_chars", "short_names", "entropy", "packed", "signs", "tokens", "token_entropy", "alike", "data"]
#: The highest over the chunks of a file: its longest line, and the share of lines of one chunk that are built alike.
TOPS = ["longest", "uniform"]
#: A chunk of fewer characters says nothing about copying.
LEAST_COPIED = 80
TREES, DEPTH, SEED = 40, 8, 11
#: A file comes out if the odds that it is labelled are so many times those of all files.
LIFT = 2.0
#: At most so many rows train the forest; of more, a seeded sample is taken.
MOST_TRAINING = 200_000


def stats(text: str) -> list[float]:
    """SUMS and TOPS of a text whose notice is taken away; entropies and packed are weighted by length.

    Lines are built alike if they are equal but for their names, numbers and strings.
    """
    n = len(text)
    names = IDENTIFIER.findall(text)
    freq = Counter(text)
    entropy = -sum(c / n * math.log2(c / n) for c in freq.values()) if n else 0.0
    tokens = LEXICAL.findall(text)
    spread_ = sum(c * math.log2(c) for c in Counter(tokens).values())
    token_entropy = math.log2(len(tokens)) - spread_ / len(tokens) if tokens else 0.0
    lines = text.split("\n")
    built = Counter(NAMES.sub("w", LITERAL.sub("0", x)) for x in lines if x.strip())
    alike = sum(c for c in built.values() if c > 2)
    most = max(built.values(), default=0)
    return [
        n,
        len(lines),
        sum(freq[c] for c in "0123456789"),
        sum(freq[c] for c in " \t\n"),
        sum(map(len, LONG_TOKEN.findall(text))),
        sum(map(len, LANGUAGE_COMMENT.findall(text))),
        len(names),
        sum(map(len, names)),
        sum(len(x) == 1 for x in names),
        entropy * n,
        len(zlib.compress(text.encode("utf-8", "surrogatepass"), 6)),
        sum(freq[c] for c in "(){}[];,=<>&|!"),
        len(tokens),
        token_entropy * len(tokens),
        alike,
        sum(map(len, NUMBERS.findall(text))) + sum(map(len, LONG_TOKEN.findall(text))),
        max(map(len, lines)),
        most / (sum(built.values()) or 1) if most > 2 else 0.0,
    ]


def own_text(chunks: DataFrame) -> DataFrame:
    """(repo_id, file_path, id, chunk_type, content) of the chunks that make up their files: methods only where their class has no chunk.

    Which methods those are is told from keys alone, so contents are not moved for it.
    """
    key = ["repo_id", "file_path"]
    rows = chunks.filter(F.col("content").isNotNull() & F.col("repo_id").isNotNull() & F.col("file_path").isNotNull())
    method = F.coalesce(F.col("chunk_type") == "method", F.lit(False))
    classes = rows.filter("chunk_type = 'class'").select(*key, F.col("symbol_name").alias("parent_symbol")).distinct()
    orphans = rows.filter(method).select(*key, "parent_symbol", "id").join(classes, [*key, "parent_symbol"], "left_anti").select(*key, "id").distinct()
    columns = [*key, "id", "chunk_type", "content"]
    return rows.filter(~method).select(columns).unionByName(rows.filter(method).select(columns).join(orphans, [*key, "id"], "left_semi"))


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """(repo_id, file_path, id, mark, notice, SUMS..., TOPS...) of own_text(); notice is also told for a bundler's banner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, mark, notice = [], [], []
            for kind, text in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                head = HEADER.match(text) if kind == "module_doc" else None
                told = bool(head and NOTICE.search(head.group())) or bool(BANNER.match(text))
                notice.append(told)
                if told and head:
                    text = text[head.end() :]
                found.append(stats(text))
                flat = " ".join(text.split())
                mark.append(flat if len(flat) >= LEAST_COPIED and not (kind == "module_doc" and head and not told and head.end() >= len(text)) else None)
            columns = [pa.array(x, pa.float64()) for x in zip(*found, strict=True)] if found else [pa.array([], pa.float64()) for _ in SUMS + TOPS]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(mark, pa.string()), pa.array(notice), *columns], ["repo_id", "file_path", "id", "mark", "notice", *SUMS, *TOPS])

    out = spread(own_text(chunks), "repo_id", "file_path").mapInArrow(run, "repo_id string, file_path string, id string, mark string, notice boolean, " + ", ".join(f"{s} double" for s in SUMS + TOPS))
    return out.withColumn("mark", F.xxhash64("mark") * F.when(F.col("mark").isNotNull(), 1))


def path_kinds() -> dict[str, Column]:
    """Features of the path: whether its folders or its name are of the kinds that conventions reserve for such files."""
    return {f"f_path_{k}": F.regexp_like("file_path", F.lit(p)).cast("double") for k, p in (("copied", COPIED_PATH), ("made", MADE_PATH), ("shrunk", SHRUNK_PATH))}


def ratios(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """The features of the forest from sums, longest and copied."""
    per = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    features = {
        "f_packed": per("packed", "chars"),
        "f_entropy": per("entropy", "chars"),
        "f_name_length": per("name_chars", "names"),
        "f_short_names": per("short_names", "names"),
        "f_comments": per("comments", "chars"),
        "f_digits": per("digits", "chars"),
        "f_spaces": per("spaces", "chars"),
        "f_coded": per("coded", "chars"),
        "f_signs": per("signs", "chars"),
        "f_line": per("chars", "lines"),
        "f_token_entropy": per("token_entropy", "tokens"),
        "f_alike": per("alike", "lines"),
        "f_longest": F.col("longest"),
        "f_uniform": F.col("uniform"),
        "f_copied": F.col("copied"),
        **path_kinds(),
    }
    return df.withColumns(features), list(features)


def file_sums(chunks: DataFrame) -> DataFrame:
    """One row per file: its sums and tops, whether it has a notice, and the share of its code that other repositories hold too.

    A chunk counts once, however often it was delivered, and of differing rows of an id the first in order; chunks are
    grouped by id before they are by file, so a file that holds a third of all chunks makes no large group. The
    repositories of a piece of code are counted over distinct (mark, repo_id), so code that a third of all files share
    makes no large group.
    """
    keys = ["repo_id", "file_path"]
    values = ["mark", "notice", *SUMS, *TOPS]
    c = cut(chunk_stats(chunks).groupBy(*keys, "id").agg(F.min(F.struct(*values)).alias("v")).select(*keys, "v.*"))
    spread = c.filter("mark is not null").select("mark", "repo_id").distinct().groupBy("mark").agg(F.count("*").alias("repos")).filter("repos > 1")
    c = c.join(spread, "mark", "left")
    copied = F.coalesce(F.try_divide(F.sum(F.when(F.col("repos") > 1, F.col("chars")).otherwise(0.0)), F.sum(F.when(F.col("mark").isNotNull(), F.col("chars")))), F.lit(0.0))
    return c.groupBy(*keys).agg(*[F.sum(s).alias(s) for s in SUMS], *[F.max(s).alias(s) for s in TOPS], F.max("notice").alias("notice"), copied.alias("copied"))


def label() -> Column:
    """1 where a notice, the path or the share of data labels a file, else 0."""
    data = (F.col("data") > 0.5 * F.col("chars")).cast("double")
    return F.greatest(F.col("notice").cast("double"), data, *path_kinds().values())


def scored(chunks: DataFrame) -> DataFrame:
    """(repo_id, file_path, score, least) of every file with any text beside a notice; least is the score that tells.

    Null keys and contents are left out. Where no file is labelled none comes out. The number of training rows is bounded by MOST_TRAINING.
    """
    files, names = ratios(cut(file_sums(chunks).filter("chars > spaces")))
    n, base = files.agg(F.count("*"), F.avg(label())).first()
    if not base or base == 1:  # nothing to tell apart
        return files.select("repo_id", "file_path", F.lit(base or 0.0).alias("score"), F.lit(0.5).alias("least"))
    draw = F.pmod(F.xxhash64("repo_id", "file_path", F.lit(SEED)), F.lit(1_000_000))
    train = files if n <= MOST_TRAINING else files.filter(draw < int(1_000_000 * MOST_TRAINING / n))
    assemble = VectorAssembler(inputCols=names, outputCol="features")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, maxBins=64, seed=SEED, minInstancesPerNode=2, featureSubsetStrategy="0.3")
    half = F.pmod(F.xxhash64("repo_id", "file_path", F.lit(SEED + 1)), F.lit(2))
    learn = lambda k: forest.fit(assemble.transform(train.filter(half != k).select(label().alias("label"), *names)))
    # no file is scored by a forest that has learnt that it carries no label
    out = reduce(DataFrame.unionByName, [learn(k).transform(assemble.transform(files.filter(half == k))) for k in (0, 1)])
    odds = LIFT * base / (1 - base)
    return out.select("repo_id", "file_path", vector_to_array("probability")[1].alias("score"), F.lit(odds / (1 + odds)).alias("least"))


def not_handwritten(chunks: DataFrame) -> DataFrame:
    """(repo_id, file_path, score) of the files whose score the forest puts at least as high as the score that tells."""
    return scored(chunks).filter("score >= least").drop("least")
