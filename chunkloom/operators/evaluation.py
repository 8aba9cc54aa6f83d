"""Ranking metrics, suite means, repeats, and the decision rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = ("L1", "L2", "L3")
MARGIN = 0.05
METRICS = ("recall_at_k", "mrr", "ndcg_at_k", "groundedness")


def recall(retrieved: Column, truth: Column, k: int) -> Column:
    """Share of the truth among the first k; 1 where there is no truth. An id retrieved twice counts twice."""
    hits = F.size(F.filter(F.slice(retrieved, 1, k), lambda x: F.array_contains(truth, x)))
    return F.when(F.size(F.array_distinct(truth)) == 0, F.lit(1.0)).otherwise(hits / F.size(F.array_distinct(truth)))


def mrr(retrieved: Column, truth: Column) -> Column:
    """One over the place of the first hit, 0 without one."""
    hit = F.array_min(F.filter(F.transform(retrieved, lambda x, i: F.when(F.array_contains(truth, x), i + 1)), lambda p: p.isNotNull()))
    return F.coalesce(1.0 / hit, F.lit(0.0))


def ndcg(retrieved: Column, truth: Column, k: int) -> Column:
    """Binary nDCG over the first k; 0 where there is no truth."""
    gain = F.aggregate(F.transform(F.slice(retrieved, 1, k), lambda x, i: F.when(F.array_contains(truth, x), 1.0 / F.log2((i + 2).cast("double"))).otherwise(F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
    n = F.least(F.size(F.array_distinct(truth)), F.lit(k))
    ideal = F.aggregate(F.transform(F.filter(F.sequence(F.lit(1), F.lit(k)), lambda i: i <= n), lambda i: 1.0 / F.log2((i + 1).cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return F.when(n == 0, F.lit(0.0)).otherwise(gain / ideal)


def latest(rows: DataFrame) -> DataFrame:
    """The rows of an evaluation once each: of a row_id the one received last."""
    w = Window.partitionBy("row_id").orderBy(F.desc("received_at"), F.desc("evaluated_at"), F.asc("question_id"))
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def scored(rows: DataFrame, k: int = 5) -> DataFrame:
    """(row_id, baseline, repeat_no, question_id, taxonomy, recall, mrr, ndcg, cited): metrics made anew from the lists."""
    r = latest(rows.select("row_id", "baseline", "repeat_no", "question_id", "taxonomy", "gt_chunk_ids", "retrieved_chunk_ids", "citations", "evaluated_at", "received_at"))
    got, truth = F.coalesce("retrieved_chunk_ids", F.array().cast("array<string>")), F.coalesce("gt_chunk_ids", F.array().cast("array<string>"))
    return r.select("row_id", "baseline", "repeat_no", "question_id", "taxonomy", recall(got, truth, k).alias("recall"), mrr(F.slice(got, 1, k), truth).alias("mrr"), ndcg(got, truth, k).alias("ndcg"), (F.size(F.coalesce("citations", F.array().cast("array<string>"))) > 0).alias("cited"))


def suite(rows: DataFrame) -> DataFrame:
    """(baseline, taxonomy, questions, means of the metrics, uncited): per level and, with taxonomy `all`, over all.

    One pass with grouping sets; every baseline has all levels, those without rows with 0.
    """
    r = latest(rows.select("row_id", "baseline", "question_id", "taxonomy", "citations", "evaluated_at", "received_at", *METRICS))
    g = r.groupingSets([[F.col("baseline")], [F.col("baseline"), F.col("taxonomy")]], "baseline", "taxonomy").agg(
        F.count("*").alias("questions"), *[F.avg(m).alias(m) for m in METRICS], F.count_if(F.size("citations") == 0).alias("uncited"), F.grouping("taxonomy").alias("over")
    )
    g = g.withColumn("taxonomy", F.when(F.col("over") == 1, "all").otherwise(F.col("taxonomy"))).drop("over")
    every = r.select("baseline").distinct().withColumn("taxonomy", F.explode(F.array(*[F.lit(x) for x in (*LEVELS, "all")])))
    out = every.join(g, ["baseline", "taxonomy"], "left")
    return out.select("baseline", "taxonomy", F.coalesce("questions", F.lit(0)).alias("questions"), *[F.round(F.coalesce(m, F.lit(0.0)), 6).alias(m) for m in METRICS], F.coalesce("uncited", F.lit(0)).alias("uncited"))


def over_repeats(rows: DataFrame) -> DataFrame:
    """(baseline, question_id, repeats, and mean, least and highest of each metric) over the repeats of a question."""
    r = latest(rows.select("row_id", "baseline", "question_id", "repeat_no", "evaluated_at", "received_at", *METRICS))
    per = [f(m) for m in METRICS for f in (lambda m: F.round(F.avg(m), 6).alias(f"{m}_mean"), lambda m: F.min(m).alias(f"{m}_min"), lambda m: F.max(m).alias(f"{m}_max"))]
    return r.groupBy("baseline", "question_id").agg(F.count_distinct("repeat_no").alias("repeats"), *per)


def composites(rows: DataFrame) -> DataFrame:
    """(baseline, taxonomy, composite, composite_four): mean of the metrics without and with groundedness, per level."""
    r = latest(rows.select("row_id", "baseline", "question_id", "taxonomy", "evaluated_at", "received_at", *METRICS))
    q = r.groupBy("baseline", "taxonomy", "question_id").agg(*[F.avg(m).alias(m) for m in METRICS]).groupBy("baseline", "taxonomy").agg(*[F.coalesce(F.avg(m), F.lit(0.0)).alias(m) for m in METRICS])
    three = F.col("recall_at_k") + F.col("mrr") + F.col("ndcg_at_k")
    return q.select("baseline", "taxonomy", F.round(three / 3, 6).alias("composite"), F.round((three + F.col("groundedness")) / 4, 6).alias("composite_four"))


def margins(rows: DataFrame, arm: str = "B4") -> DataFrame:
    """(taxonomy, baseline, margin, passes): how far the arm is ahead of each other baseline, per level of the rule."""
    c = composites(rows).filter(F.col("taxonomy").isin("L2", "L3"))
    a = c.filter(F.col("baseline") == arm).select("taxonomy", F.col("composite").alias("ahead"))
    m = c.filter(F.col("baseline") != arm).join(a, "taxonomy")
    margin = F.round(F.col("ahead") - F.col("composite"), 6)
    return m.select("taxonomy", "baseline", margin.alias("margin"), (margin >= MARGIN).alias("passes"))


def decision(rows: DataFrame, arm: str = "B4", against: tuple[str, ...] = ("B2", "B3")) -> DataFrame:
    """(arm, compared, supported): supported if the arm is ahead of all of them by the margin on both levels; else, or where an arm is missing, not."""
    m = margins(rows, arm).filter(F.col("baseline").isin(*against))
    n = 2 * len(against)
    return m.agg(F.count("*").alias("compared"), F.coalesce(F.every("passes"), F.lit(False)).alias("passed")).select(F.lit(arm).alias("arm"), "compared", (F.col("passed") & (F.col("compared") == n)).alias("supported"))
