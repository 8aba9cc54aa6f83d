"""Embedding in batches: what a cache holds is not embedded again, and answers of a model are put back in order."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.functions.keys import embedding_key

BATCH = 64


def in_order(items: Sequence[tuple[int, Sequence[float]]], n: int, dim: int) -> list[list[float]]:
    """The vectors of a model's answer by their index; raises where an index is missing, given twice or out of range, or a vector is not dim long."""
    out: list[list[float] | None] = [None] * n
    for i, vector in items:
        if not 0 <= i < n:
            raise ValueError(f"index {i} is not below {n}")
        if out[i] is not None:
            raise ValueError(f"index {i} came twice")
        if len(vector) != dim:
            raise ValueError(f"index {i} has {len(vector)} numbers, not {dim}")
        out[i] = [float(x) for x in vector]
    missing = [i for i, v in enumerate(out) if v is None]
    if missing:
        raise ValueError(f"no vector for {missing[:5]}")
    return out


def embed(texts: DataFrame, cache: DataFrame, model: Callable[[list[str]], Sequence[tuple[int, Sequence[float]]]], name: str, dim: int, batch: int = BATCH) -> tuple[DataFrame, DataFrame]:
    """(vectors, new): (id, vector) of every text, and the (key, vector) rows that the cache lacks.

    texts: (id, text), null texts have no vector. model answers a list of texts with (index, vector) in any order. Each
    distinct text that is not cached goes to the model once, in batches; a batch of zeros only is no answer and raises.
    """
    keyed = texts.filter("id is not null and text is not null").select("id", "text", embedding_key(name, F.col("text")).alias("key"))
    known = cache.select("key", "vector")
    wanted = keyed.join(known, "key", "left_anti").groupBy("key").agg(F.first("text").alias("text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for a in range(0, len(f), batch):
                part = f.iloc[a : a + batch]
                vectors = in_order(model(list(part["text"])), len(part), dim)
                if not np.any(vectors):
                    raise ValueError("a batch of zeros")
                yield pd.DataFrame({"key": part["key"].to_numpy(), "vector": vectors})

    new = wanted.mapInPandas(run, "key string, vector array<float>")
    every = known.unionByName(new)
    return keyed.select("id", "key").join(every, "key").select("id", "vector"), new
