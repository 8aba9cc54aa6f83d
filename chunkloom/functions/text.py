"""Text functions: the code tokenizer, document text, clipping, languages and search keywords."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word with its single underscores, and the parts of a segment by case and digits (ASCII only).
RAW = r"[\p{L}\p{N}]+(?:_[\p{L}\p{N}]+)*"
PART = r"[A-Z]+(?=[A-Z][a-z]|[0-9]|\z)|[A-Z]?[a-z]+|[0-9]+|[A-Z]+"
HAN = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]"
CLIP_MARKER = "\n... [truncated]"

#: Words that say nothing to a code search.
STOPWORDS = (
    "a an and are across as at be before between by can do does explain for from get give happen happens how in into is it its like list of on or over show that the their them then there these this through to travel travels under up use used uses using "
    "what when where which who whom why will with within work works would"
).split()
#: What counts as a name of code in a question: parts with dots between, lower-case words with underscores, and
#: capitalised words written together.
PLAIN = "[A-Za-z_][A-Za-z0-9_]*"
DOTTED = rf"\b{PLAIN}(?:\.{PLAIN})++"
SNAKE = r"\b[a-z][a-z0-9]*(?:_[a-z0-9]+)++\b"
CAMEL = r"\b[A-Z][a-z]+(?:[A-Z][a-z]*)++\b"
IDENTIFIER = f"{DOTTED}|{SNAKE}|{CAMEL}"


def fold(text: Column) -> Column:
    """Case folding; exact but for rare code points that fold to more than a lower-case letter (ß is handled)."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def tokenize(text: Column) -> Column:
    """Tokens of prose, paths, snake_case and camelCase: each word gives its compact form and its parts, once each.

    Null gives null, a text without words an empty array.
    """

    def word(raw: Column) -> Column:
        def segment(s: Column) -> Column:
            parts = F.regexp_extract_all(s, F.lit(PART), 0)
            return F.when(F.size(parts) == 0, F.array(s)).otherwise(parts)

        parts = F.flatten(F.transform(F.split(raw, "_"), segment))
        return F.array_distinct(F.concat(F.array(fold(F.replace(raw, F.lit("_"), F.lit("")))), F.transform(parts, fold)))

    return F.flatten(F.transform(F.regexp_extract_all(text, F.lit(RAW), 0), word))


def query_terms(text: Column) -> Column:
    """The distinct tokens of a query, in order."""
    return F.array_distinct(tokenize(text))


def document_text(symbol_name: Column, file_path: Column, signature: Column, content: Column) -> Column:
    """The one text of a chunk that is searched; nulls count as empty."""
    return F.concat_ws("\n", *[F.coalesce(c, F.lit("")) for c in (symbol_name, file_path, signature, content)])


def cap(text: Column, limit: int, marker: str = CLIP_MARKER) -> Column:
    """A text of at most limit characters, its end replaced by the marker where it is longer."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, max(0, limit - len(marker))), F.lit(marker[:limit]))).otherwise(text)


def clip(text: Column, limit: int = 1200, marker: str = CLIP_MARKER) -> Column:
    """The first limit characters of a text, and the marker after them where it is longer."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(marker))).otherwise(text)


def passage(symbol_name: Column, file_path: Column, content: Column, chars: int = 256) -> Column:
    """What a reranker reads of a chunk."""
    return F.concat_ws("\n", F.coalesce(symbol_name, F.lit("")), F.coalesce(file_path, F.lit("")), F.substring(F.coalesce(content, F.lit("")), 1, chars))


def is_chinese(text: Column) -> Column:
    """Whether a text has any Han character; null counts as none."""
    return F.coalesce(F.regexp_like(text, F.lit(HAN)), F.lit(False))


def keywords(query: Column, most: int = 3) -> Column:
    """Up to `most` search terms: what stands in backticks, then identifiers, then words of more than two letters that say something."""
    ticked = F.transform(F.regexp_extract_all(query, F.lit(r"`([^`]+)`"), 1), F.trim)
    named = F.regexp_extract_all(query, F.lit(IDENTIFIER), 0)
    plain = F.filter(F.split(F.regexp_replace(query, r"(?U)[^\w\s.]", " "), r"\s+"), lambda w: (F.length(w) > 2) & ~F.lower(w).isin(*STOPWORDS))
    exact = F.array_distinct(F.filter(F.concat(ticked, named), lambda w: w != ""))
    return F.slice(F.when(F.size(exact) >= most, exact).otherwise(F.array_distinct(F.concat(exact, plain))), 1, most)


def fixed(value: Column, digits: int = 3, signed: bool = False) -> Column:
    """A number with so many decimals, and a plus sign where asked for; null stays null."""
    return F.when(value.isNotNull(), F.format_string(f"%{'+' if signed else ''}.{digits}f", value.cast("double")))
