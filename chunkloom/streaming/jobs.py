"""Streams: job states, the job queue, events of answers with heartbeat and timeout, and caches with a time to live."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from chunkloom.operators.repositories import stage_rank

QUERY_TTL, TOOL_TTL = "1 hour", "24 hours"
HEARTBEAT_S, BUDGET_S = 20, 240


def job_states(events: DataFrame) -> DataFrame:
    """(repo_id, status): the farthest state of each job, for batches and streams (output mode update or complete)."""
    known = events.filter(stage_rank(F.col("status")) >= 0)
    return known.groupBy("repo_id").agg(F.max_by("status", stage_rank(F.col("status"))).alias("status"))


def monotonic(events: DataFrame) -> DataFrame:
    """(repo_id, status, progress): each event that takes its job forward; what comes late or again is left out.

    A stream with state per repository: the farthest stage seen. Failed and ready end a job.
    """

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        from chunkloom.operators.repositories import PROGRESS, STAGES

        ranks = {s: i for i, s in enumerate(STAGES)} | {"failed": len(STAGES)}
        seen = state.get[0] if state.exists else -1
        out = []
        for b in batches:
            for s in b["status"]:
                r = ranks.get(s, -1)
                if r > seen and seen < ranks["ready"]:
                    seen = r
                    out.append((key[0], s, PROGRESS[s]))
        state.update((seen,))
        yield pd.DataFrame(out, columns=["repo_id", "status", "progress"])

    return events.groupBy("repo_id").applyInPandasWithState(advance, "repo_id string, status string, progress int", "seen int", "append", GroupStateTimeout.NoTimeout)


def consume(spark: SparkSession, queue: str, handle: Callable[[DataFrame, int], None], dead: str, checkpoint: str) -> StreamingQuery:
    """Read jobs of a queue directory and hand each batch to `handle`, at least once; messages that are no job go to `dead`.

    The checkpoint remembers what was handled; a handler that publishes revisions may see a batch again without harm.
    """
    raw = spark.readStream.schema("value string").text(queue)
    parsed = raw.select("value", F.from_json("value", "repo_id string, url string").alias("j"))

    def batch(df: DataFrame, number: int) -> None:
        good = F.col("j.repo_id").isNotNull() & F.col("j.url").isNotNull()
        df.filter(~F.coalesce(good, F.lit(False))).select("value").write.mode("append").text(dead)
        handle(df.filter(good).select("j.repo_id", "j.url").dropDuplicates(), number)

    return parsed.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ordered_events(events: DataFrame) -> DataFrame:
    """(query_id, events, outcome): the events of each query in order up to its last word, for batches.

    The outcome is done, error, or open where neither a final answer nor an error came.
    """
    last = F.min(F.when(F.col("event").isin("final_answer", "error"), F.col("seq")))
    g = events.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("seq", "event", "payload"))).alias("all"), last.alias("end"))
    kept = F.filter("all", lambda e: F.col("end").isNull() | (e["seq"] <= F.col("end")))
    final = F.element_at(F.transform(kept, lambda e: e["event"]), -1)
    return g.select("query_id", kept.alias("events"), F.when(final == "final_answer", "done").when(final == "error", "error").otherwise("open").alias("outcome"))


class Watch(StatefulProcessor):
    """Per query: passes its events on, a heartbeat when it is idle, and a timeout when it takes too long."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.started = handle.getValueState("started", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentProcessingTimeInMs()
        if not self.started.exists():
            self.started.update((now,))
            self.handle.registerTimer(now + HEARTBEAT_S * 1000)
        for b in rows:
            if b["event"].isin(["final_answer", "error"]).any():
                self.started.clear()
            yield pd.DataFrame({"query_id": [key[0]] * len(b), "event": b["event"], "payload": b["payload"]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentProcessingTimeInMs()
        if self.started.exists():
            late = now - self.started.get()[0] >= BUDGET_S * 1000
            if late:
                self.started.clear()
            else:
                self.handle.registerTimer(now + HEARTBEAT_S * 1000)
            yield pd.DataFrame({"query_id": [key[0]], "event": ["error" if late else "heartbeat"], "payload": ['{"code": "TIMEOUT"}' if late else "{}"]})

    def close(self) -> None:
        pass


def watched(events: DataFrame) -> DataFrame:
    """(query_id, event, payload) of a stream of events with heartbeats and timeouts put in, by processing time."""
    return events.groupBy("query_id").transformWithStateInPandas(statefulProcessor=Watch(), outputStructType="query_id string, event string, payload string", outputMode="Append", timeMode="ProcessingTime")


def first_within(rows: DataFrame, keys: list[str], at: str, ttl: str = QUERY_TTL) -> DataFrame:
    """A stream without rows whose keys came before within the time to live."""
    return rows.withWatermark(at, ttl).dropDuplicatesWithinWatermark(keys)


def first_per_slot(rows: DataFrame, keys: list[str], at: str, ttl_s: int, tie: str) -> DataFrame:
    """The batch counterpart: of the rows of a key within each slot of ttl_s seconds only the first, by time and then `tie`."""
    slot = F.floor(F.unix_micros(F.col(at).cast("timestamp")) / (ttl_s * 1_000_000))
    w = Window.partitionBy(*keys, "__slot").orderBy(at, tie)
    return rows.withColumn("__slot", slot).withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__slot", "__n")


def turn_status(turns: DataFrame) -> DataFrame:
    """(turn_id, status): of all statuses of a turn the one that counts most: error, done, then what is open."""
    rank = F.coalesce(*[F.when(F.col("status") == s, F.lit(i)) for i, s in enumerate(("streaming", "interrupted", "done", "error"))], F.lit(-1))
    return turns.groupBy("turn_id").agg(F.max_by("status", rank).alias("status"))
