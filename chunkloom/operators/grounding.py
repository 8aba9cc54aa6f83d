"""Groundedness: citations of answers held against the index, redacted where they fail."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chunkloom.functions import citations as C
from chunkloom.functions.text import is_chinese
from chunkloom.operators.graph import resolve
from chunkloom.operators.lookup import containing

THRESHOLD = 0.95


def cited(answers: DataFrame, by_id: bool = False) -> DataFrame:
    """(answer_id, repo_id, position, kind, token, symbol, file_path, line): one row per citation of (answer_id, repo_id, answer).

    by_id: citations are evidence ids and places, by position in the text; else places, then names.
    """
    found = C.extract_by_position if by_id else C.extract
    c = answers.select("answer_id", "repo_id", F.posexplode(found(F.col("answer"))).alias("position", "c"))
    return c.select("answer_id", "repo_id", "position", "c.*")


def cited_evidence(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """cited() by id, with look (what the token is looked up as), shown (the token of an id) and given_chunk.

    evidence: (answer_id, evidence_id, token) and chunk_id if there is one. An id that it lacks has no look-up.
    """
    given = F.col("chunk_id") if "chunk_id" in evidence.columns else F.lit(None).cast("string")
    e = evidence.groupBy("answer_id", F.col("evidence_id").alias("token")).agg(F.min(F.struct(F.col("token").alias("shown"), given.alias("given_chunk"))).alias("e"))
    c = cited(answers, True).join(e.withColumn("kind", F.lit("id")), ["answer_id", "token", "kind"], "left").select("*", "e.*").drop("e")
    isid, place = F.col("kind") == "id", f"{C.FILE_LINE}$"
    path, line = (F.regexp_extract("shown", f"^{place}", n) for n in (1, 2))
    at = isid & (path != "")
    return c.select(
        "answer_id", "repo_id", "position", "kind", "token", "shown", "given_chunk",
        F.when(~isid | at, "file").when(F.concat(F.lit("`"), "shown", F.lit("`")).rlike(f"^{C.SYMBOL}$"), "symbol").alias("look"),
        F.when(at, path).when(isid, F.coalesce("shown", "symbol")).otherwise(F.col("symbol")).alias("symbol"),
        F.when(at, path).otherwise(F.col("file_path")).alias("file_path"),
        F.when(at, F.try_to_number(line, F.lit("999999999")).cast("int")).when(isid, 0).otherwise(F.col("line")).alias("line"),
    )


def verify(answers: DataFrame, chunks: DataFrame, symbols: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """cited() with verified and chunk_id; with evidence also shown, the token of an id.

    With evidence (answer_id, evidence_id, token) answers cite by [C1] and by place; an id is verified if its token is.

    A place is verified if a chunk of its file holds its line; a name if it resolves to a symbol. Distinct places and
    names are looked up once, however many answers cite them. A line beyond the integers fails.
    """
    c = cited(answers).withColumn("look", F.col("kind")) if evidence is None else cited_evidence(answers, evidence)
    places = c.filter("look = 'file' and line is not null").select("repo_id", "file_path", "line").distinct().withColumn("point_id", F.concat_ws("\x1f", "repo_id", "file_path", F.col("line").cast("string")))
    at = containing(places, chunks).select("repo_id", "file_path", "line", F.col("id").alias("place_chunk"))
    names = c.filter("look = 'symbol'").select(F.lit(0).alias("query_id"), "repo_id", "symbol").distinct()
    w = Window.partitionBy("repo_id", "symbol").orderBy("qualified_name", "file_path", "line", "id")
    known = resolve(names, symbols).withColumn("n", F.row_number().over(w)).filter("n = 1").select("repo_id", "symbol", F.lit(True).alias("named"), F.col("chunk_id").alias("name_chunk"))
    out = c.join(at, ["repo_id", "file_path", "line"], "left").join(known, ["repo_id", "symbol"], "left")
    ok = F.when(F.col("look") == "file", F.col("place_chunk").isNotNull()).otherwise(F.col("look").isNotNull() & F.coalesce("named", F.lit(False)))
    chunk = F.when(F.col("look") == "file", F.col("place_chunk")).otherwise(F.col("name_chunk"))
    more = [] if evidence is None else ["shown"]
    if evidence is not None:
        chunk = F.coalesce("given_chunk", chunk)
    return out.select("answer_id", "repo_id", "position", "kind", "token", "symbol", "file_path", "line", ok.alias("verified"), chunk.alias("chunk_id"), *more)


def merged(citations: DataFrame) -> DataFrame:
    """(answer_id, symbol, file_path, line, tokens, verified, chunk_id): citations of verify() that name the same place, as one.

    verified if any of them is; tokens in the order in which the answer has them first.
    """
    tokens = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("position", "token"))), lambda x: x["token"]))
    return citations.groupBy("answer_id", "symbol", "file_path", "line").agg(tokens.alias("tokens"), F.max("verified").alias("verified"), F.min("chunk_id").alias("chunk_id"))


def unmatched(tokens: DataFrame, citations: DataFrame) -> DataFrame:
    """(answer_id, token) of tokens that no citation of the answer has."""
    return tokens.select("answer_id", "token").distinct().join(citations.select("answer_id", "token"), ["answer_id", "token"], "left_anti")


def scores(answers: DataFrame, chunks: DataFrame, symbols: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """(answer_id, citations, verified, score): the verified share of an answer's citations, 0 where it has none."""
    v = verify(answers, chunks, symbols, evidence).groupBy("answer_id").agg(F.count("*").alias("citations"), F.count_if("verified").alias("verified"))
    out = answers.select("answer_id").distinct().join(v, "answer_id", "left")
    return out.select("answer_id", F.coalesce("citations", F.lit(0)).alias("citations"), F.coalesce("verified", F.lit(0)).alias("verified"), F.coalesce(F.try_divide("verified", "citations"), F.lit(0.0)).alias("score"))


def enforce(answers: DataFrame, chunks: DataFrame, symbols: DataFrame, threshold: float = THRESHOLD, evidence: DataFrame | None = None) -> DataFrame:
    """(answer_id, answer, score, removed): answers as they may be shown, unverified citations replaced and a note below.

    The score is that before redaction. Unverified citations are replaced whatever the score; the note comes only below
    the threshold or where nothing is cited. With evidence, verified ids become their tokens.
    """
    v = verify(answers, chunks, symbols, evidence)
    bad = F.filter(F.array_sort(F.collect_list(F.struct("position", "verified", "kind", "token", "symbol", "file_path", "line"))), lambda c: ~c["verified"])
    ids = F.lit(None) if evidence is None else F.array_distinct(F.collect_list(F.when(F.col("verified") & (F.col("kind") == "id"), F.struct("token", "shown"))))
    per = v.groupBy("answer_id").agg(F.count("*").alias("cited"), F.count_if("verified").alias("good"), bad.alias("bad"), ids.alias("ids"))
    a = answers.select("answer_id", "answer", "repo_id").distinct().join(per, "answer_id", "left")
    chinese = is_chinese(F.col("answer"))
    score = F.coalesce(F.try_divide("good", "cited"), F.lit(0.0))
    n = F.coalesce("cited", F.lit(0))
    removed = F.coalesce(F.size("bad"), F.lit(0))
    shown = F.col("answer") if evidence is None else F.coalesce(C.render_ids(F.col("answer"), F.map_from_entries("ids")), "answer")
    cut = F.when(removed > 0, C.redact(shown, F.col("bad"), chinese)).otherwise(shown)
    return a.select("answer_id", C.with_note(cut, score, threshold, n, removed, chinese).alias("answer"), score.alias("score"), removed.alias("removed"))
