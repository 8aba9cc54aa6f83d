"""Per-key aggregation that stays balanced when a few keys own most rows.

Two stages: rows of heavy keys get a random salt, partial results are made per (key, salt), and the
partials, at most `salts` for a key, are merged by key. Keys that are not heavy have the single salt 0,
so they cost no more than in a plain aggregation.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALT = "__salt"
HOT = "__hot"


@dataclass(frozen=True)
class Agg:
    """One aggregate: kind is count, sum, min, max or count_distinct; column is unused for count."""

    name: str
    kind: str
    column: str | None = None


#: How each kind is computed over rows and how its partial results are merged.
PARTIAL = {"count": lambda c: F.count(F.lit(1)), "sum": F.sum, "min": F.min, "max": F.max}
MERGE = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}


def heavy_keys(df: DataFrame, key: str, share: float = 0.01) -> DataFrame:
    """The keys with at least `share` of all rows, counted over all rows.

    There are at most 1/share of them whatever the size of df, which is what allows their broadcast.
    Null is a key like any other. An empty df has no heavy keys.
    """
    if not 0 < share <= 1:
        raise ValueError("share must be in (0, 1]")
    total = df.count()  # a sum of Parquet footers, no column is read
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= share * total).select(key)


def with_salt(df: DataFrame, key: str, heavy: DataFrame, salts: int, spread: Column | None = None, seed: int = 7) -> DataFrame:
    """df with a column of salts: for heavy keys from `spread`, or at random where that is None, else 0."""
    marked = heavy.select(F.col(key).alias("__heavy_key"), F.lit(True).alias(HOT))
    joined = df.join(F.broadcast(marked), df[key].eqNullSafe(F.col("__heavy_key")), "left")
    draw = F.floor(F.rand(seed) * salts) if spread is None else F.pmod(F.xxhash64(spread), F.lit(salts))
    return joined.withColumn(SALT, F.when(F.col(HOT), draw.cast("int")).otherwise(F.lit(0))).drop("__heavy_key", HOT)


def salted_aggregate(df: DataFrame, key: str, aggs: list[Agg], share: float = 0.01, salts: int = 32, heavy: DataFrame | None = None) -> DataFrame:
    """One row per key with the aggregates asked for, no task carrying a heavy key alone.

    Count-distinct takes its salt from the value, so that a value is counted under one salt only; all other
    kinds share one pass with random salts. Nulls: a null key is a group; null values are ignored by sum, min,
    max and count_distinct (0 where all are null), as in SQL. An empty df gives no rows. Other columns of df,
    whatever their names, are not read.
    """
    if unknown := {a.kind for a in aggs} - {*PARTIAL, "count_distinct"}:
        raise ValueError(f"unknown aggregates: {sorted(unknown)}")
    names = [f"__v{i}" for i in range(len(aggs))]
    columns = [F.col(a.column).alias(n) for a, n in zip(aggs, names, strict=True) if a.column]
    base = df.select(F.col(key).alias("__key"), *columns)
    hot = heavy_keys(base, "__key", share) if heavy is None else heavy.select(F.col(key).alias("__key"))
    parts = []
    plain = [(a, n) for a, n in zip(aggs, names, strict=True) if a.kind != "count_distinct"]
    if plain:
        partial = with_salt(base.select("__key", *{n: None for a, n in plain if a.column}), "__key", hot, salts)
        partial = partial.groupBy("__key", SALT).agg(*[PARTIAL[a.kind](n).alias(n) for a, n in plain])
        parts.append(partial.groupBy("__key").agg(*[MERGE[a.kind](n).alias(n) for a, n in plain]))
    for a, n in zip(aggs, names, strict=True):
        if a.kind == "count_distinct":
            values = with_salt(base.select("__key", n), "__key", hot, salts, F.col(n)).distinct()
            partial = values.groupBy("__key", SALT).agg(F.count(n).alias(n))
            parts.append(partial.groupBy("__key").agg(F.sum(n).alias(n)))

    def merge(left: DataFrame, right: DataFrame) -> DataFrame:
        r = right.withColumnRenamed("__key", "__other")
        return left.join(r, left["__key"].eqNullSafe(r["__other"])).drop("__other")

    out = reduce(merge, parts)
    return out.select(F.col("__key").alias(key), *[F.col(n).alias(a.name) for a, n in zip(aggs, names, strict=True)])


def heavy_owners(tables: dict[str, DataFrame], key: str, share: float) -> DataFrame:
    """(table_name, key) of the keys that own at least `share` of a table's rows, repeated rows included.

    The row counts come from salted_aggregate; null keys own nothing. Empty tables give no rows.
    """
    found = []
    for name, df in tables.items():
        counts = salted_aggregate(df, key, [Agg("n", "count")], share=min(share, 0.01))
        found.append(counts.filter((F.col("n") >= share * df.count()) & F.col(key).isNotNull()).select(F.lit(name).alias("table_name"), key))
    return reduce(DataFrame.unionByName, found)


def degrees(edges: DataFrame, share: float = 0.001, salts: int = 32) -> DataFrame:
    """(repo_id, symbol_id, in_degree, out_degree) over distinct edges, popular targets and large repositories salted.

    An edge is (repo_id, source_id, target_id, edge_type, source_line); repeated rows count once. Null endpoints are
    left out; a self edge counts on both sides.
    """
    e = edges.select("repo_id", "source_id", "target_id", "edge_type", "source_line").distinct()
    ends = e.select("repo_id", F.explode(F.array(F.struct(F.col("source_id").alias("symbol_id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("target_id").alias("symbol_id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("x"))
    ends = ends.select(F.struct("repo_id", "x.symbol_id").alias("k"), "x.i", "x.o").filter("k.symbol_id is not null")
    out = salted_aggregate(ends, "k", [Agg("in_degree", "sum", "i"), Agg("out_degree", "sum", "o")], share=share, salts=salts)
    return out.select("k.repo_id", "k.symbol_id", "in_degree", "out_degree")
