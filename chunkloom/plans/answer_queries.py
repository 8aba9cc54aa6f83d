"""Queries over answers, evaluations, conversations and repositories, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.functions import citations, intents, text
from chunkloom.operators import evaluation as E
from chunkloom.operators import grounding, history
from chunkloom.operators import repositories as P
from chunkloom.session import table


def _answers(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "per_question").select("row_id", "repo_id", "answer").filter("answer is not null").distinct()
    return a.withColumnRenamed("row_id", "answer_id")


def citation_extract(spark: SparkSession, d: str) -> DataFrame:
    return grounding.cited(_answers(spark, d)).select("answer_id", "position", "kind", "token", "line")


def citation_verify(spark: SparkSession, d: str) -> DataFrame:
    v = grounding.verify(_answers(spark, d), table(spark, d, "chunks"), table(spark, d, "symbols"))
    return v.select("answer_id", "position", "verified", "chunk_id")


def citation_redact(spark: SparkSession, d: str) -> DataFrame:
    return grounding.enforce(_answers(spark, d), table(spark, d, "chunks"), table(spark, d, "symbols"))


def groundedness_score(spark: SparkSession, d: str) -> DataFrame:
    s = grounding.scores(_answers(spark, d), table(spark, d, "chunks"), table(spark, d, "symbols"))
    return s.withColumn("score", F.round("score", 6))


def evidence_ids(spark: SparkSession, d: str) -> DataFrame:
    return _answers(spark, d).select("answer_id", F.posexplode(citations.evidence_ids(F.col("answer"))).alias("position", "evidence_id"))


def recall_mrr_ndcg(spark: SparkSession, d: str) -> DataFrame:
    s = E.scored(table(spark, d, "per_question"))
    return s.select("row_id", *[F.round(c, 6).alias(c) for c in ("recall", "mrr", "ndcg")], "cited")


def eval_stratified(spark: SparkSession, d: str) -> DataFrame:
    return E.suite(table(spark, d, "per_question"))


def eval_repeats(spark: SparkSession, d: str) -> DataFrame:
    return E.over_repeats(table(spark, d, "per_question"))


def composite_scores(spark: SparkSession, d: str) -> DataFrame:
    return E.composites(table(spark, d, "per_question"))


def ablation_margins(spark: SparkSession, d: str) -> DataFrame:
    return E.margins(table(spark, d, "per_question"))


def h1_decision(spark: SparkSession, d: str) -> DataFrame:
    return E.decision(table(spark, d, "per_question"))


def _turns(spark: SparkSession, d: str) -> DataFrame:
    """The answers to a question as a conversation, in order of their rows."""
    r = table(spark, d, "per_question").select("question_id", "row_id", "answer").distinct()
    return r.select(F.col("question_id").alias("conv_id"), F.col("row_id").alias("turn"), F.when(F.col("row_id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.col("answer").alias("content"))


def bounded_history(spark: SparkSession, d: str) -> DataFrame:
    return history.bounded(_turns(spark, d))


def history_symbol(spark: SparkSession, d: str) -> DataFrame:
    return history.recent_symbol(_turns(spark, d))


def _observations(spark: SparkSession, d: str) -> DataFrame:
    """What each row retrieved, as observations of two tools."""
    r = table(spark, d, "per_question").select("row_id", "retrieved_chunk_ids", "gt_chunk_ids").distinct()
    one = r.select("row_id", F.posexplode("retrieved_chunk_ids").alias("ordinal", "token"), F.lit("search_code").alias("origin"))
    two = r.select("row_id", F.posexplode("gt_chunk_ids").alias("at", "token")).select("row_id", (F.col("at") + 100).alias("ordinal"), "token", F.lit("find_references").alias("origin"))
    o = one.unionByName(two)
    return o.select(F.col("row_id").alias("query_id"), "ordinal", "origin", "token", F.col("token").alias("chunk_id"), F.lit("").alias("symbol"), F.lit("").alias("content"), F.lit(None).cast("double").alias("score"))


def evidence_merge(spark: SparkSession, d: str) -> DataFrame:
    m = history.merged_evidence(_observations(spark, d))
    return m.select("query_id", "evidence_id", "token", F.array_join("origins", ",").alias("origins"))


def graph_evidence(spark: SparkSession, d: str) -> DataFrame:
    o = _observations(spark, d)
    m = history.merged_evidence(o)
    return history.graph_evidence(m, o.filter("origin = 'search_code'").select("query_id", "chunk_id"), ("find_references",))


def ordered_distinct_seeds(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "per_question").select(F.col("row_id").alias("query_id"), F.posexplode("retrieved_files").alias("rank", "file_path"), F.lit("").alias("symbol_name"), F.lit(0).alias("start_line"))
    return history.seeds(r).select("query_id", "file_path", "place")


def language_route(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "per_question").select("question").filter("question is not null").distinct()
    c = F.col("question")
    return q.select("question", text.is_chinese(c).alias("chinese"), intents.needs_multihop(c).alias("multihop"), intents.is_reference_query(c).alias("reference"), intents.is_dependents_query(c).alias("dependents"), intents.call_direction(c).alias("direction"), intents.subject(c).alias("subject"), intents.path(c).alias("path"))


def reuse_candidate(spark: SparkSession, d: str) -> DataFrame:
    return P.reusable(table(spark, d, "repos").distinct())


def list_page_truncated(spark: SparkSession, d: str) -> DataFrame:
    return P.page(table(spark, d, "repos").distinct())


def operational_counts(spark: SparkSession, d: str) -> DataFrame:
    return P.counts(table(spark, d, "chunks"), table(spark, d, "symbols"))


def edge_type_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "edges").groupBy("repo_id", "edge_type").agg(F.count_distinct("id").alias("edges"))


def vector_dims(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks")
    return c.groupBy(F.coalesce(F.size("embedding"), F.lit(-1)).alias("dim")).agg(F.count_distinct("id").alias("chunks"), F.count_distinct(F.when(F.exists("embedding", lambda x: x != 0), F.col("id"))).alias("nonzero"))


def quota_days(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("session"), F.col("ts").alias("at"))
    return P.over_quota(e, 2)


def _live(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "repos").distinct()
    return r.filter("status <> 'ready'").select("id", F.to_json(F.struct(F.lit("embedding").alias("status"), (F.col("progress") + 60).cast("string").alias("progress"))).alias("payload"))


def live_status(spark: SparkSession, d: str) -> DataFrame:
    return P.with_live_state(table(spark, d, "repos").distinct(), _live(spark, d))


def cache_anti_join(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks")
    from chunkloom.functions.keys import embedding_key

    cache = c.filter("chunk_type = 'class' and content is not null and embedding is not null").groupBy(embedding_key("stub", F.col("content")).alias("key")).agg(F.max("embedding").alias("vector"))
    return P.missing_embeddings(c, cache, "stub").select("key")


def job_state_latest(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pipeline_contexts").distinct()
    state = F.when(F.col("error").isNotNull(), "failed").when(F.col("completed_at").isNotNull(), "ready").when(F.size("parsed_files") > 0, "embedding").otherwise("cloning")
    rank = P.stage_rank(F.col("status"))
    return p.withColumn("status", state).groupBy("repo_id").agg(F.max_by("status", rank).alias("status"), F.count_distinct("context_id").alias("contexts"))


FUNCTIONS = (
    citation_extract, citation_verify, citation_redact, groundedness_score, evidence_ids, recall_mrr_ndcg, eval_stratified, eval_repeats, composite_scores, ablation_margins, h1_decision, bounded_history, history_symbol, evidence_merge,
    graph_evidence, ordered_distinct_seeds, language_route, reuse_candidate, list_page_truncated, operational_counts, edge_type_counts, vector_dims, quota_days, live_status, cache_anti_join, job_state_latest,
)
QUERIES = {f.__name__: f for f in FUNCTIONS}

ANSWERS = "a as (select distinct row_id as answer_id, repo_id, answer from per_question where answer is not null)"
PLACE = r"`?([\w./\-]+\.py):(\d+)`?".replace(r"\w", r"\p{L}\p{N}_\p{Mn}\p{Mc}")
NAME = r"`([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+)`".replace(r"\w", r"[\p{L}\p{N}_]")
CITED = rf"""{ANSWERS}, p as (select answer_id, repo_id, answer, regexp_extract_all(answer, '{PLACE}', 1) as f, regexp_extract_all(answer, '{PLACE}', 2) as n, regexp_extract_all(answer, '{NAME}', 1) as s from a),
    cited as (select answer_id, repo_id, 'file' as kind, unnest(f) as file_path, cast(unnest(n) as int) as line, generate_subscripts(f, 1) - 1 as position, '' as symbol from p
        union all select answer_id, repo_id, 'symbol', '', 0, len(f) + generate_subscripts(s, 1) - 1, unnest(s) from p)"""
VERIFIED = f"""{CITED}, c as (select id, min(repo_id) as repo_id, min(file_path) as file_path, min(start_line) as a, min(end_line) as z from chunks where id is not null group by id),
    sy as (select id, min(repo_id) as repo_id, min(qualified_name) as q, min(file_path) as file_path, min(line) as line, min(chunk_id) as chunk_id from symbols group by id),
    pl as (select x.repo_id, x.file_path, x.line, arg_min(c.id, (-c.a, c.z, c.id)) as id from (select distinct repo_id, file_path, line from cited where kind = 'file') x join c on c.repo_id = x.repo_id and c.file_path = x.file_path and c.a <= x.line and c.z >= x.line group by 1, 2, 3),
    nm0 as (select x.repo_id, x.symbol, sy.q = x.symbol as exact, sy.* exclude (repo_id) from (select distinct repo_id, symbol from cited where kind = 'symbol') x join sy on sy.repo_id = x.repo_id and (sy.q = x.symbol or ends_with(sy.q, '.' || x.symbol))),
    nm as (select repo_id, symbol, arg_min(struct_pack(v := chunk_id), (not exact, q, file_path, line, id)).v as chunk_id from nm0 group by 1, 2),
    verified as (select t.*, case when kind = 'file' then pl.id is not null else nm.symbol is not null end as verified, case when kind = 'file' then pl.id else nm.chunk_id end as chunk_id
        from cited t left join pl on t.kind = 'file' and pl.repo_id = t.repo_id and pl.file_path = t.file_path and pl.line = t.line left join nm on t.kind = 'symbol' and nm.repo_id = t.repo_id and nm.symbol = t.symbol)"""
LATEST = "r as (select * from (select *, row_number() over (partition by row_id order by received_at desc, evaluated_at desc, question_id) as rn from per_question) where rn = 1)"
MEANS = ", ".join(f"round(coalesce(avg({m}), 0), 6) as {m}" for m in E.METRICS)
COMPOSITES = f"""{LATEST}, q as (select baseline, taxonomy, question_id, {", ".join(f"avg({m}) as {m}" for m in E.METRICS)} from r group by 1, 2, 3),
    m as (select baseline, taxonomy, {", ".join(f"coalesce(avg({m}), 0) as {m}" for m in E.METRICS)} from q group by 1, 2),
    comp as (select baseline, taxonomy, round((recall_at_k + mrr + ndcg_at_k) / 3, 6) as composite, round((recall_at_k + mrr + ndcg_at_k + groundedness) / 4, 6) as composite_four from m)"""
MARGINS = f"{COMPOSITES}, mar as (select b.taxonomy, b.baseline, round(a.composite - b.composite, 6) as margin, round(a.composite - b.composite, 6) >= 0.05 as passes from comp a join comp b using (taxonomy) where a.baseline = 'B4' and b.baseline <> 'B4' and taxonomy in ('L2', 'L3'))"
ADDRESS = r"lower(regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)', 1)) || regexp_replace(regexp_replace(substr(trim(url), length(regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)', 1)) + 1), '/+$', ''), '\.git$', '')"
RANK = "case status when 'queued' then 0 when 'cloning' then 1 when 'parsing' then 2 when 'embedding' then 3 when 'graphing' then 4 when 'ready' then 5 when 'failed' then 6 else -1 end"
OBSERVED = """o as (select distinct on (query_id, ordinal, token) * from (select row_id as query_id, unnest(retrieved_chunk_ids) as token, generate_subscripts(retrieved_chunk_ids, 1) - 1 as ordinal, 'search_code' as origin from (select distinct row_id, retrieved_chunk_ids from per_question)
    union all select row_id, unnest(gt_chunk_ids), generate_subscripts(gt_chunk_ids, 1) + 99, 'find_references' from (select distinct row_id, gt_chunk_ids from per_question)))"""
SQL = {
    "citation_extract": f"with {CITED} select answer_id, position, kind, case when kind = 'file' then file_path || ':' || line else symbol end as token, line from cited",
    "citation_verify": f"with {VERIFIED} select answer_id, position, verified, chunk_id from verified",
    "groundedness_score": f"with {VERIFIED} select a.answer_id, count(v.answer_id) as citations, count(*) filter (where verified) as verified, round(coalesce(count(*) filter (where verified) / nullif(count(v.answer_id), 0), 0), 6) as score from (select distinct answer_id from a) a left join verified v on v.answer_id = a.answer_id group by 1",
    "evidence_ids": rf"with {ANSWERS}, x as (select answer_id, regexp_extract_all(answer, '\[(C\d+)\]', 1) as i from a) select answer_id, generate_subscripts(i, 1) - 1 as position, unnest(i) as evidence_id from x",
    "recall_mrr_ndcg": f"""with {LATEST}, x as (select row_id, coalesce(retrieved_chunk_ids, []) as got, coalesce(gt_chunk_ids, []) as gt, len(coalesce(citations, [])) > 0 as cited from r),
        h as (select row_id, got, gt, cited, len(list_distinct(gt)) as n, list_transform(got[1:5], lambda g: list_contains(gt, g)) as hit from x)
        select row_id, round(case when n = 0 then 1.0 else len(list_filter(hit, lambda b: b)) / n end, 6) as recall, round(coalesce(1.0::double / nullif(list_position(hit, true), 0), 0), 6) as mrr,
            round(case when n = 0 then 0.0 else coalesce(list_sum(list_transform(range(1, len(hit) + 1), lambda i: case when hit[i] then 1 / log2(i + 1) else 0 end)), 0) / list_sum(list_transform(range(1, least(n, 5) + 1), lambda i: 1 / log2(i + 1))) end, 6) as ndcg, cited from h""",
    "eval_stratified": f"""with {LATEST}, g as (select baseline, case when grouping(taxonomy) = 1 then 'all' else taxonomy end as taxonomy, count(*) as questions, {MEANS}, count(*) filter (where len(citations) = 0) as uncited from r group by grouping sets ((baseline), (baseline, taxonomy))),
        every as (select baseline, unnest(['L1', 'L2', 'L3', 'all']) as taxonomy from (select distinct baseline from r))
        select baseline, taxonomy, coalesce(questions, 0) as questions, {", ".join(f"coalesce({m}, 0) as {m}" for m in E.METRICS)}, coalesce(uncited, 0) as uncited from every left join g using (baseline, taxonomy)""",
    "eval_repeats": f"with {LATEST} select baseline, question_id, count(distinct repeat_no) as repeats, {', '.join(f'round(avg({m}), 6) as {m}_mean, min({m}) as {m}_min, max({m}) as {m}_max' for m in E.METRICS)} from r group by 1, 2",
    "composite_scores": f"with {COMPOSITES} select * from comp",
    "ablation_margins": f"with {MARGINS} select * from mar",
    "h1_decision": f"with {MARGINS} select 'B4' as arm, count(*) as compared, coalesce(bool_and(passes), false) and count(*) = 4 as supported from mar where baseline in ('B2', 'B3')",
    "bounded_history": """with t as (select distinct question_id as conv_id, row_id as turn, case when row_id % 2 = 0 then 'user' else 'assistant' end as role, substr(coalesce(answer, ''), 1, 4000) as content from per_question),
        n as (select *, row_number() over (partition by conv_id order by turn desc) as n from t), u as (select *, coalesce(sum(length(content)) over (partition by conv_id order by turn desc rows between unbounded preceding and 1 preceding), 0) as used from n where n <= 6)
        select conv_id, turn, role, substr(content, 1, cast(greatest(0, 2000 - used) as int)) as content from u where substr(content, 1, cast(greatest(0, 2000 - used) as int)) <> ''""",
    "evidence_merge": f"""with {OBSERVED}, m as (select query_id, token, min(ordinal) as at_, bool_or(origin = 'search_code') as s, bool_or(origin = 'find_references') as f from o group by 1, 2)
        select query_id, 'C' || row_number() over (partition by query_id order by at_) as evidence_id, token, case when s and f then 'search_code,find_references' when s then 'search_code' else 'find_references' end as origins from m""",
    "graph_evidence": f"with {OBSERVED} select distinct query_id, token as chunk_id from o where origin = 'find_references' and (query_id, token) not in (select query_id, token from o where origin = 'search_code')",
    "ordered_distinct_seeds": """with p as (select row_id as query_id, unnest(retrieved_files) as file_path, generate_subscripts(retrieved_files, 1) as rank from per_question), g as (select query_id, file_path, min(rank) as best from p group by 1, 2)
        select query_id, file_path, place from (select *, row_number() over (partition by query_id order by best, file_path) as place from g) where place <= 3""",
    "reuse_candidate": f"select address, id, status from (select *, row_number() over (partition by address order by {RANK} desc, created_at desc, id) as n from (select distinct {ADDRESS} as address, id, status, created_at from repos where status <> 'failed' and url is not null)) where n = 1",
    "list_page_truncated": "with t as (select id, url, status, created_at from (select distinct * from repos) order by created_at desc, id limit 51) select id, url, status, created_at, more from (select *, count(*) over () > 50 as more, row_number() over (order by created_at desc, id) as n from t) where n <= 50",
    "operational_counts": "select coalesce(c.repo_id, s.repo_id) as repo_id, coalesce(n, 0) as chunks, coalesce(m, 0) as symbols from (select repo_id, count(distinct id) as n from chunks group by 1) c full join (select repo_id, count(distinct id) as m from symbols group by 1) s on c.repo_id = s.repo_id",
    "edge_type_counts": "select repo_id, edge_type, count(distinct id) as edges from edges group by 1, 2",
    "vector_dims": "select coalesce(len(embedding), -1) as dim, count(distinct id) as chunks, count(distinct id) filter (where len(list_filter(embedding, lambda x: x <> 0)) > 0) as nonzero from chunks group by 1",
    "quota_days": "select cast(user_id as varchar) as session, cast(ts as date) as day, count(*) as n from events where user_id is not null group by 1, 2 having count(*) > 2",
    "live_status": "select id, case when status <> 'ready' then 'embedding' else status end as status, case when status <> 'ready' and progress + 60 between 0 and 100 then progress + 60 else progress end as progress from (select distinct * from repos)",
    "cache_anti_join": "select distinct 'embed:stub:' || sha256(content) as key from chunks where content is not null and content not in (select content from (select content, max(embedding) as v from chunks where chunk_type = 'class' and content is not null and embedding is not null group by 1) where len(list_filter(v, lambda x: x <> 0)) > 0)",
    "job_state_latest": f"""with p as (select distinct * from pipeline_contexts), s as (select repo_id, context_id, case when error is not null then 'failed' when completed_at is not null then 'ready' when len(parsed_files) > 0 then 'embedding' else 'cloning' end as status from p)
        select repo_id, arg_max(status, {RANK}) as status, count(distinct context_id) as contexts from s group by 1""",
}
