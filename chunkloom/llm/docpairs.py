"""Pairs of code and description from function and method chunks.

A lexer written as one regular expression turns each chunk into token rows. Windows over the tokens of a chunk do
the rest: cumulative sums of the brackets give the depth, the first colon of depth 0 after `def` ends the header,
line ends and semicolons of depth 0 separate statements (islands), and lag tells which comments stand on lines of
their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tokens in the order in which they are tried: triple-quoted and plain strings with their prefix, unterminated
#: triple quotes, comments, joined lines, line ends, brackets, colons, semicolons, and runs of anything else. The repeated
#: groups are possessive: the regular expressions of the JVM match others by recursion, which long lines would overflow.
PREFIX = r"(?:[rRbBuUfFtT]{1,2}(?=[\"']))?"
TOKEN = "|".join(
    [
        PREFIX + r'(?:"""[\s\S]*?(?<!\\)(?:\\\\)*"""|' + r"'''[\s\S]*?(?<!\\)(?:\\\\)*'''|" + r'"""[\s\S]*|' + r"'''[\s\S]*)",
        PREFIX + r'(?:"[^"\\\n]*+"|' + r"'[^'\\\n]*+'|" + r'"[^\n]*?(?<!\\)(?:\\\\)*"|' + r"'[^\n]*?(?<!\\)(?:\\\\)*'|[\"'][^\n]*)",
        r"#[^\n]*",
        r"\\\r?\n",
        r"\n",
        r"[(\[{]",
        r"[)\]}]",
        r":",
        r";",
        r"(?:(?![rRbBuUfFtT]{1,2}[\"'])[^\s\"'#()\[\]{}:;\\][^\"'#()\[\]{}:;\\\nrRbBuUfFtT]*+)++",
    ]
)
#: A string token that is whole and neither formatted nor bytes.
PLAIN = r"(?s)^[rRuU]{0,1}(?:(\"\"\"|''').*\1|(?!\"\"\"|''')([\"']).*\2)$"

#: Text that stands in place of a description.
DIRECTIVE = r"(?im)^[ \t]*(?:type:[ \t]*ignore|noqa|pragma:|pylint:|fmt:|mypy:|isort:|flake8:|ruff:|yapf:|pyright:|nosec|noinspection|coverage:|cython:|-\*-|vim?:|lint:|codespell:|black:).*$"
NOTE = r"(?im)\b(?:todo|fixme|xxx|hack|tbd|wip)\b.*$"
TEMPLATE = r"(?i)(?<![\w])_[a-z]++(?:_[a-z]++)*+_(?![\w])|<[a-z][a-z _-]*>|\[(?:description|summary|type|optional)\]|\bno (?:documentation|docstring|description)(?: yet| available)?\b|\b(?:undocumented|lorem ipsum|docstring|placeholder)\b|\bn/a\b"
TAG = r"(?im)^[ \t]*(?::|@|\\)(?:param|parameter|arg|argument|key|keyword|type|return|returns|rtype|yield|yields|raise|raises|exception|throws|var|ivar)\b(?:[ \t]+[\w.\[\], ]+?)?(?::|$)"
HEADING = r"(?im)^[ \t]*(?:args|arguments|parameters?|params|keyword args|returns?|yields?|raises|attributes|examples?|notes?|other parameters)[ \t]*:?[ \t]*$"
TYPED = r"(?m)^[ \t]*\*{0,2}\w+[ \t]*(?:\([^)\n]*\))?[ \t]*:(?=\s|$)"
NUMPY = r"(?m)^[ \t]*\*{0,2}\w+ : .*$"
TYPE_ONLY = r"(?im)^[ \t]*(?:none|int|str|bool|float|bytes|object|any|(?:list|set|dict|tuple|optional|union|iterable|iterator)\[[\w\[\], .|]*\])[ \t]*:?[ \t]*$"
WORD = r"\p{IsHan}|[\p{L}_][\p{L}\p{M}\p{N}_'’]*"
LEAST_WORDS = 4


def words_left(doc: Column, name: Column) -> Column:
    """How many words of doc remain besides those of the name, empty tags, notes, directives and templates."""
    text = doc
    for pattern in (DIRECTIVE, NOTE, TEMPLATE, TAG, NUMPY, HEADING, TYPE_ONLY, TYPED):
        text = F.regexp_replace(text, pattern, " ")
    words = F.transform(F.regexp_extract_all(text, F.lit(WORD), 0), lambda w: F.lower(w))
    parts = F.array_append(F.split(F.lower(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1_$2")), "_+"), F.lower(name))
    return F.size(F.filter(words, lambda w: ~F.array_contains(parts, w) & F.regexp_like(w, F.lit(r"\p{L}"))))


def tokens(chunks: DataFrame) -> DataFrame:
    """(uid, id, symbol_name, content, pos, kind, text), one row per token; kinds: S string, X other string, # comment, N line end, ( ) : ; and W.

    Chunk columns are kept on the first token only, texts on strings, comments and the word before a header.
    Repeated rows of a chunk give its tokens once. A chunk without any token gives no rows.
    """
    kept = chunks.filter(F.col("chunk_type").isin("function", "method") & F.col("content").isNotNull() & F.col("id").isNotNull())
    uid = F.xxhash64("id", "content", "symbol_name").alias("uid")
    once = kept.select(uid, "id", F.coalesce("symbol_name", F.lit("")).alias("symbol_name"), F.regexp_replace("content", "\r\n?", "\n").alias("content")).groupBy("uid").agg(F.first("id").alias("id"), F.first("symbol_name").alias("symbol_name"), F.first("content").alias("content"))
    t = once.select("uid", "id", "symbol_name", "content", F.posexplode(F.regexp_extract_all("content", F.lit(TOKEN), 0)).alias("pos", "text"))
    first = F.substring("text", 1, 1)
    kind = (
        F.when(first == "#", "#")
        .when(first == "\n", "N")
        .when(first == "\\", "J")
        .when(first.isin("(", "[", "{"), "(")
        .when(first.isin(")", "]", "}"), ")")
        .when(first == ":", ":")
        .when(first == ";", ";")
        .when(F.regexp_like("text", F.lit(PLAIN)), "S")
        .when(F.regexp_like("text", F.lit(r"^[rRbBuUfFtT]{0,2}[\"']")), "X")
        .otherwise("W")
    )
    head = F.col("pos") == 0
    t = t.withColumn("kind", kind).filter("kind <> 'J'")
    keep = F.col("kind").isin("S", "#") | ((F.col("kind") == "W") & F.regexp_like("text", F.lit(r"\bdef\s+\w")))
    return t.select("uid", *[F.when(head, F.col(c)).alias(c) for c in ("id", "symbol_name", "content")], "pos", "kind", F.when(keep, F.col("text")).alias("text"))


def doc_pairs(chunks: DataFrame) -> DataFrame:
    """(chunk_id, code, description, words) of every function and method chunk with real documentation.

    The documentation is the plain string that is the first statement of the body, however it is quoted, joined or
    put in brackets, else the comment lines between header and first statement. It is real if at least LEAST_WORDS
    words are left. Null or empty contents, chunks without a header (`def` missing or cut off) and strings that do
    not end give no pair; a null symbol_name takes no words away. Ties don't occur: one row per chunk and content.
    """
    w = Window.partitionBy("uid").orderBy("pos")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    step = F.when(F.col("kind") == "(", 1).when(F.col("kind") == ")", -1).otherwise(0)
    t = tokens(chunks)
    t = t.withColumns(
        {
            "depth": F.sum(step).over(w),
            "defined": F.coalesce(F.max(F.when((F.col("kind") == "W") & F.col("text").isNotNull(), 1).otherwise(0)).over(w), F.lit(0)),
            "last": F.lag("kind").over(w),
        }
    )
    ends = (F.col("kind") == ":") & (F.col("depth") == 0) & (F.col("defined") == 1)
    t = t.withColumn("body", F.coalesce(F.max(F.when(ends, 1).otherwise(0)).over(before), F.lit(0)))
    code = (F.col("body") == 1) & ~F.col("kind").isin("#", "N", ";")
    stop = (F.col("body") == 1) & (F.col("depth") == 0) & F.col("kind").isin("N", ";")
    t = t.withColumns({"coded": F.coalesce(F.max(F.when(code, 1).otherwise(0)).over(before), F.lit(0)), "island": F.coalesce(F.sum(F.when(stop, 1).otherwise(0)).over(before), F.lit(0))})
    t = t.withColumn("first_island", F.min(F.when(code, F.col("island"))).over(Window.partitionBy("uid")))
    statement = code & (F.col("island") == F.col("first_island"))
    comment = (F.col("body") == 1) & (F.col("kind") == "#") & (F.col("coded") == 0) & (F.col("last") == "N")
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("pos", "kind", "text")))), lambda x: x)
    g = t.filter(statement | comment | (F.col("pos") == 0)).groupBy("uid").agg(F.max("id").alias("chunk_id"), F.max("symbol_name").alias("symbol_name"), F.max("content").alias("code"), in_order(statement).alias("s"), in_order(comment).alias("c"))
    shape = F.array_join(F.transform("s", lambda x: x["kind"]), "")
    strip = lambda x: F.regexp_replace(F.regexp_replace(x["text"], r"(?s)^[rRuU]?(?:\"\"\"|'''|[\"'])|(?:\"\"\"|'''|[\"'])$", ""), r"\\[nrt]", "\n")
    doc = F.array_join(F.transform(F.filter("s", lambda x: x["kind"] == "S"), strip), "")
    remarks = F.array_join(F.transform("c", lambda x: F.regexp_replace(x["text"], r"^#+[!:]?", "")), "\n")
    g = g.withColumn("description", F.when(F.regexp_like(shape, F.lit(r"^\(*S+\)*$")), doc).otherwise(remarks))
    g = g.withColumn("words", words_left(F.col("description"), F.col("symbol_name")))
    return g.filter(F.col("words") >= LEAST_WORDS).select("chunk_id", "code", F.trim("description").alias("description"), "words")
