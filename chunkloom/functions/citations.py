"""Citations in answers: extraction, redaction, rendering and the notes below an answer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as a citation, and the texts put into answers.
FILE_LINE = r"(?U)`?([\w./\-]+\.py):(\d+)`?"
SYMBOL = r"(?U)`([A-Za-z_][\w]*(?:\.[A-Za-z_][\w]*)+)`"
EVIDENCE_ID = r"\[(C\d+)\]"
#: Ids and places in one scan; they can't overlap, so it finds what the two find, by position in the text.
ID_OR_FILE_LINE = r"(?U)\[(C\d+)\]|`?([\w./\-]+\.py):(\d+)`?"
MARKER, MARKER_ZH = "[unverified reference removed]", "[已移除未验证引用]"
UNCITED = "> ⚠️ This answer cites no indexed code, so nothing in it was checked against the index. Treat it as unverified rather than as verified."
UNCITED_ZH = "> ⚠️ 此回答没有引用已索引代码，因此其中没有内容经过索引核验；请将其视为未验证回答。"

CITATION = "struct<kind:string,token:string,symbol:string,file_path:string,line:int>"


def file_lines(answer: Column) -> Column:
    """Citations of the form path.py:12, in order, as structs of CITATION."""
    path = F.regexp_extract_all(answer, F.lit(FILE_LINE), 1)
    line = F.regexp_extract_all(answer, F.lit(FILE_LINE), 2)
    return F.zip_with(path, line, lambda p, n: F.struct(F.lit("file").alias("kind"), F.concat_ws(":", p, n).alias("token"), p.alias("symbol"), p.alias("file_path"), F.try_to_number(n, F.lit("999999999")).cast("int").alias("line")))


def symbols(answer: Column) -> Column:
    """Dotted names in backticks, in order, as structs of CITATION."""
    names = F.regexp_extract_all(answer, F.lit(SYMBOL), 1)
    return F.transform(names, lambda s: F.struct(F.lit("symbol").alias("kind"), s.alias("token"), s.alias("symbol"), F.lit("").alias("file_path"), F.lit(0).alias("line")))


def extract(answer: Column) -> Column:
    """All citations of an answer: places first, then names. A null answer has none."""
    a = F.coalesce(answer, F.lit(""))
    return F.concat(file_lines(a), symbols(a))


def evidence_ids(answer: Column) -> Column:
    """[C1]-style ids in order, repeated ones kept."""
    return F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(EVIDENCE_ID), 1)


def extract_by_position(answer: Column) -> Column:
    """Evidence ids and places of an answer by position in the text, as structs of CITATION; names in backticks are code, not citations."""
    a = F.coalesce(answer, F.lit(""))
    part = lambda n: F.regexp_extract_all(a, F.lit(ID_OR_FILE_LINE), n)

    def one(m: Column) -> Column:
        isid = m["i"] != ""
        line = F.when(~isid, F.try_to_number(m["n"], F.lit("999999999")).cast("int"))
        return F.struct(F.when(isid, "id").otherwise("file").alias("kind"), F.when(isid, m["i"]).otherwise(F.concat_ws(":", m["p"], m["n"])).alias("token"), F.when(isid, m["i"]).otherwise(m["p"]).alias("symbol"), m["p"].alias("file_path"), line.alias("line"))

    return F.transform(F.arrays_zip(part(1).alias("i"), part(2).alias("p"), part(3).alias("n")), one)


def redact(answer: Column, unverified: Column, chinese: Column) -> Column:
    """The answer with each unverified citation (structs of CITATION) replaced by the marker.

    Places are replaced in backticks, and bare where they are no part of a longer path; names in backticks only.
    """
    marker = F.when(chinese, F.lit(MARKER_ZH)).otherwise(F.lit(MARKER))
    quote = lambda t: F.concat(F.lit(r"\Q"), t, F.lit(r"\E"))

    def one(text: Column, c: Column) -> Column:
        ticked = F.regexp_replace(text, F.concat(F.lit("`"), quote(c["token"]), F.lit("`")), marker)
        bare = F.regexp_replace(ticked, F.concat(F.lit(r"(?U)(?<![\w./-])"), quote(c["token"]), F.lit(r"(?![\w./:-])")), marker)
        return F.when(c["kind"] == "id", F.replace(text, F.concat(F.lit("["), c["token"], F.lit("]")), marker)).when(c["kind"] == "file", bare).otherwise(ticked)

    return F.aggregate(unverified, answer, one)


def render_ids(answer: Column, tokens: Column) -> Column:
    """Evidence ids replaced by their tokens in backticks; tokens is a map of id to token. Ids side by side are parted first."""
    apart = F.regexp_replace(answer, r"(\[C\d+\])(?=\[C\d+\])", "$1 ")
    return F.aggregate(F.map_entries(tokens), apart, lambda t, e: F.replace(t, F.concat(F.lit("["), e["key"], F.lit("]")), F.concat(F.lit("`"), e["value"], F.lit("`"))))


def with_note(answer: Column, score: Column, threshold: float, cited: Column, removed: Column, chinese: Column) -> Column:
    """The answer with the note that belongs below it: nothing cited, or a score below the threshold; else as it is."""
    plural = F.when(removed != 1, "s").otherwise("")
    low = F.when(chinese, F.format_string(f"> ⚠️ 引用可信度 %.2f 低于 {threshold:.2f} 的保护阈值：已移除 %d 个未在索引中找到的引用。", score, removed)).otherwise(
        F.format_string(f"> ⚠️ Groundedness %.2f is below the {threshold:.2f} guardrail: %d unverified reference%s removed (not found in the index).", score, removed, plural)
    )
    note = F.when(cited == 0, F.when(chinese, F.lit(UNCITED_ZH)).otherwise(F.lit(UNCITED))).when(score < threshold, low)
    body = F.regexp_replace(answer, r"\s+$", "")
    return F.when(note.isNull(), answer).when(body == "", note).otherwise(F.concat(body, F.lit("\n\n"), note))
