"""Mix sources to target weights, in tokens.

All tokens of the mix are cut into blocks of equal size. Sainte-Laguë apportionment gives each block to the source
with the highest quotient share / (2 n + 1), where n is what it has, unless its documents, repeated as often as
allowed, are used up. The tokens of a source are spread over shards of its documents: every shard as often as the
whole source fits, then shard after shard once more. In the last of these the documents are taken in the order of a
seeded hash until the rest is filled, so however many shards there are, a source misses less than one document.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from chunkloom.session import cut, spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern by which byte-level BPE splits a text before it merges.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
BLOCKS = 20_000
DOCS_PER_SHARD = 100_000
MOST_SHARDS = 10_000
#: The targets are held on the driver; more sources than this are refused.
MOST_SOURCES = 10_000


@cache
def encoder(vocabulary: bytes):
    """The tokenizer of the text of a vocabulary file."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("counter", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def canonical(source: Column) -> Column:
    """The canonical name of a source: lower case, no outer blanks, _ for -; null where nothing is left."""
    name = F.replace(F.lower(F.regexp_replace(source, r"^\s+|\s+$", "")), F.lit("-"), F.lit("_"))
    return F.when(name != "", name)


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens) of every document that has a source, named canonically. Null and empty texts have 0 tokens.

    The vocabulary, a file of fixed size, is read on the driver and sent with the job.
    """
    with open(vocabulary, "rb") as f:
        shipped = documents.sparkSession.sparkContext.broadcast(f.read())
    rows = documents.select("doc_id", canonical(F.col("source")).alias("source"), "text").filter("source is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shipped.value)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], ["doc_id", "source", "tokens"])

    return spread(rows, "doc_id").mapInArrow(run, "doc_id bigint, source string, tokens bigint")


def apportion(weights: dict, caps: dict, blocks: int) -> dict:
    """Sainte-Laguë: how many of the blocks each key gets, none more than its cap; ties go to the smaller key.

    Blocks are left over only where every key has reached its cap.
    """
    given = dict.fromkeys(weights, 0)
    queue = [(-w, k) for k, w in weights.items() if w > 0 and caps[k] > 0]
    heapq.heapify(queue)
    while blocks and queue:
        _, k = queue[0]
        given[k] += 1
        blocks -= 1
        if given[k] < caps[k]:
            heapq.heapreplace(queue, (-weights[k] / (2 * given[k] + 1), k))
        else:
            heapq.heappop(queue)
    return given


class Plan:
    """Quotas of a mix: block (tokens per block), report (one row per target), quotas (tokens of a source and shard)."""

    def __init__(self, block: float, shards: int, report: list[Row], quotas: list[Row]):
        self.block, self.shards, self.report, self.quotas = block, shards, report, quotas


def shard_of(doc_id: Column, shards: int, seed: int) -> Column:
    return F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.lit(shards)).cast("int")


def spread_quota(tokens: int, own: dict) -> dict:
    """Tokens of a source over its shards, which have own[shard] tokens: whole rounds of all, then once more in the order of the shards.

    They add up to tokens, and no shard is repeated more often than the source as a whole, rounded up.
    """
    rounds, rest = divmod(tokens, sum(own.values()) or 1)
    quota = {}
    for k in sorted(own):
        more = min(own[k], rest)
        quota[k] = rounds * own[k] + more
        rest -= more
    return quota


def plan(counts: DataFrame, targets: DataFrame, blocks: int = BLOCKS, seed: int = 0, docs: int | None = None) -> Plan:
    """Apportion a mix as large as all documents that have a source, of which there are docs.

    Where docs is given, counts is read once only.

    What comes to the driver is one row per target and one per source and shard, both bounded: by MOST_SOURCES and by
    MOST_SHARDS times the targets. Sources without a target add to the size of the mix and get nothing.

    A source is short if the apportionment leaves it no block that it could still give, and its tokens, which the
    blocks round, are fewer than its share.
    """
    goal = {r.source: (float(r.target_share), int(r.max_repeats)) for r in targets.select("source", "target_share", "max_repeats").limit(MOST_SOURCES + 1).collect()}
    if len(goal) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    docs = counts.count() if docs is None else docs
    shards = min(MOST_SHARDS, max(1, -(-docs // DOCS_PER_SHARD)))
    named = F.when(F.col("source").isin(*goal), F.col("source"))
    sizes = counts.groupBy(named.alias("source"), shard_of(F.col("doc_id"), shards, seed).alias("shard")).agg(F.sum("tokens").alias("tokens")).collect()
    total = sum(r.tokens for r in sizes)
    block = max(1.0, total / blocks)
    sizes = [r for r in sizes if r.source is not None]
    have = dict.fromkeys(goal, 0)
    for r in sizes:
        have[r.source] += r.tokens
    fits = lambda s, tokens: int(goal[s][1] * tokens / block)
    caps = {s: fits(s, have[s]) for s in goal}
    given = apportion({s: share for s, (share, _) in goal.items()}, caps, round(total / block))
    used_up = {s for s in goal if given[s] + 1 >= caps[s]}
    report = [
        Row(source=s, target_share=share, max_repeats=most, tokens=have[s], quota_blocks=given[s], quota_tokens=round(given[s] * block), short=s in used_up and most * have[s] < share * total) for s, (share, most) in sorted(goal.items())
    ]
    quotas = []
    for s in goal:
        own = {r.shard: r.tokens for r in sizes if r.source == s}
        part = spread_quota(min(round(given[s] * block), goal[s][1] * have[s]), own)
        quotas += [Row(source=s, shard=k, quota=float(part[k]), shard_tokens=own[k]) for k in own]
    return Plan(block, shards, report, quotas)


REPORT = "source string, target_share double, max_repeats int, tokens bigint, quota_blocks bigint, quota_tokens bigint, short boolean"


def report_frame(spark: SparkSession, p: Plan) -> DataFrame:
    return spark.createDataFrame(p.report, REPORT)


def select(counts: DataFrame, p: Plan, seed: int = 0) -> DataFrame:
    """(doc_id, source, tokens, repeats): every document that is used, and how often.

    Each shard of a source goes through its documents in the order of a seeded hash, as often as its quota holds whole
    rounds, and once more up to the rest. Windows run over one shard of one source, which is bounded. Documents of
    0 tokens are never used.
    """
    spark = counts.sparkSession
    quotas = F.broadcast(spark.createDataFrame(p.quotas, "source string, shard int, quota double, shard_tokens bigint"))
    rows = counts.filter("tokens > 0").withColumn("shard", shard_of(F.col("doc_id"), p.shards, seed)).join(quotas, ["source", "shard"])
    w = Window.partitionBy("source", "shard").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum("tokens").over(w))
    rounds = F.floor(F.col("quota") / F.col("shard_tokens"))
    rest = F.col("quota") - rounds * F.col("shard_tokens")
    repeats = (rounds + F.when(F.col("upto") <= rest, 1).otherwise(0)).cast("int")
    return rows.select("doc_id", "source", "tokens", repeats.alias("repeats")).filter("repeats > 0")


def sourced(documents: DataFrame) -> int:
    """How many documents have a source; reads that column only."""
    return documents.filter(canonical(F.col("source")).isNotNull()).count()


def shortages(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """The report of the apportionment without the mix; tokens are counted once and kept nowhere."""
    return report_frame(documents.sparkSession, plan(token_counts(documents), targets, docs=sourced(documents)))


def mixed(documents: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    """The mix itself; tokens are counted once and kept in the shared folder."""
    counts = cut(token_counts(documents))
    return select(counts, plan(counts, targets, seed=seed), seed)


def shares(documents: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    """The report: per source its target and quota, and the tokens and share that the mix really has."""
    counts = cut(token_counts(documents))
    p = plan(counts, targets, seed=seed)
    used = select(counts, p, seed).groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("mixed_tokens"), F.max("repeats").alias("most_repeats"))
    out = report_frame(documents.sparkSession, p).join(F.broadcast(used), "source", "left").fillna(0, ["mixed_tokens", "most_repeats"])
    whole = out.agg(F.sum("mixed_tokens")).first()[0] or 0
    return out.withColumn("actual_share", F.round(F.col("mixed_tokens") / F.lit(max(1, whole)), 6))
