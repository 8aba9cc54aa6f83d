"""Retrieval in blocks: the chunks of a repository meet all of its queries at once, and only the best of a block leave it.

A repository is one block up to BLOCK chunks and several above, parted by id. So neither pairs of query and chunk nor
tokens are ever shuffled, and no task holds a whole large repository.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType, DoubleType, StructField, StructType

from chunkloom.functions import text

#: Chunks in a block, on average.
BLOCK = 65_536
#: Numbers of a vector that count as one chunk.
WIDTH = 64
#: Bits of a sieve, and of one row of it.
SIEVE, BITMAP = 1 << 24, 1 << 15
#: Queries that meet a block at once.
SLICE = 64
#: Tokens of so many words are remembered by a task.
WORDS = 500_000
DIGITS = 9
#: Twice what rounding moves a score, and more: what is nearer to the last place is compared after rounding.
NEAR = 1e-8
WORD = re.compile(r"[A-Za-z0-9]+(?:_[A-Za-z0-9]+)*")
PART = re.compile(text.PART.replace(r"\z", r"\Z"))


def sieve(marks: DataFrame) -> bytes:
    """A set of the strings of the only column, as SIEVE bits by their hash; it may hold others too, but never lacks one."""
    h = marks.select(F.pmod(F.crc32(marks.columns[0]), F.lit(SIEVE)).alias("h"))
    rows = h.groupBy(F.floor(F.col("h") / BITMAP).cast("int").alias("at")).agg(F.bitmap_construct_agg(F.pmod("h", F.lit(BITMAP))).alias("bits")).collect()
    out = bytearray(SIEVE // 8)
    for r in rows:
        out[r["at"] * BITMAP // 8 : (r["at"] + 1) * BITMAP // 8] = r["bits"]
    return bytes(out)


def passes(bits: bytes, mark: str) -> bool:
    h = crc32(mark.encode()) % SIEVE
    return bool(bits[h >> 3] >> (h & 7) & 1)


def word_tokens(word: str) -> list[str]:
    """The tokens that text.tokenize gives for one ASCII word."""
    parts = [p for s in word.split("_") for p in PART.findall(s) or [s]]
    return list(dict.fromkeys(p.lower() for p in (word.replace("_", ""), *parts)))


def counted(documents: DataFrame, asked: DataFrame) -> DataFrame:
    """(…documents without text, length, terms, tfs): the tokens of each text, counted; of them those that may be asked for.

    documents: (id, repo_id, text, …); asked: (repo_id, term). Documents of repositories that are surely not asked are
    left out. Terms are joined by blanks, as no token has one. Words of ASCII texts are cut once a task each, by the
    rules of text.tokenize; other texts go through text.tokenize itself.
    """
    marks = asked.select("term").union(asked.select(F.concat(F.lit("\n"), "repo_id"))).union(asked.select(F.concat("repo_id", F.lit("\n"), "term")))
    bits = documents.sparkSession.sparkContext.broadcast(sieve(marks))  # SIEVE / 8 bytes
    plain = F.octet_length("text") == F.length("text")
    d = documents.withColumn("tokens", F.when(~plain, text.tokenize(F.col("text")))).withColumn("text", F.when(plain, F.col("text")))
    rest = [c for c in documents.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asks = bits.value
        repos: dict[str, dict[str, bool] | None] = {}  # the terms met in it, and whether they may be asked for there
        words: dict[str, tuple[int, list[str]]] = {}
        met = 0
        for b in batches:
            rows, lengths, terms, tfs = [], [], [], []
            for i, (repo, whole, tokens) in enumerate(zip(*[b.column(c).to_pylist() for c in ("repo_id", "text", "tokens")], strict=True)):
                if repo not in repos:
                    repos[repo] = {} if passes(asks, f"\n{repo}") else None
                pairs = repos[repo]
                if pairs is None:
                    continue
                n, tf = 0, {}
                if tokens is None:
                    for word, times in Counter(WORD.findall(whole)).items():
                        known = words.get(word)
                        if known is None:
                            if len(words) >= WORDS:
                                words.clear()
                            own = word_tokens(word)
                            known = words[word] = len(own), [t for t in own if passes(asks, t)]
                        n += times * known[0]
                        for t in known[1]:
                            tf[t] = tf.get(t, 0) + times
                else:
                    n, tf = len(tokens), Counter(tokens)
                for t in [t for t in tf if t not in pairs]:
                    pairs[t] = passes(asks, f"{repo}\n{t}")
                    met += 1
                tf = {t: k for t, k in tf.items() if pairs[t]}
                if met > WORDS:
                    repos, met = {}, 0
                rows.append(i)
                lengths.append(n)
                terms.append(" ".join(tf))
                tfs.append(list(tf.values()))
            kept = b.select(rest).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(lengths, pa.int32()), pa.array(terms, pa.string()), pa.array(tfs, pa.list_(pa.int32()))], [*rest, "length", "terms", "tfs"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema if f.name != "text"]
    return d.mapInArrow(run, ", ".join([*fields, "length int", "terms string", "tfs array<int>"]))


def in_blocks(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """rows (id, repo_id, …) with the column part; counts: (repo_id, n)."""
    heavy = F.broadcast(parts_of(counts).filter("parts > 1"))  # at most one row for BLOCK chunks
    return rows.join(heavy, "repo_id", "left").withColumn("part", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")


def parts_of(counts: DataFrame) -> DataFrame:
    return counts.select("repo_id", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"))


COLUMNS = ("id", "repo_id", "file_path", "start_line")
#: What packed() keeps of a block: one row, of which body has the documents with a term.
PACKED = "repo_id string, part int, n bigint, length bigint, terms array<string>, dfs array<int>, body binary"


def pack(block: pa.Table) -> pa.Table:
    """A block as one row: documents and their length in all, how many have each term, and those with a term by file, line and id."""
    some = block.filter(pc.not_equal(block["terms"], ""))
    some = some.take(pc.sort_indices(some, sort_keys=[(c, "ascending") for c in ("file_path", "start_line", "id")], null_placement="at_start")).combine_chunks()
    lists = pc.split_pattern(some["terms"], " ").combine_chunks() if some.num_rows else pa.array([], pa.list_(pa.string()))
    coded = lists.flatten().dictionary_encode()
    dfs = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary)).astype(np.int32)
    tfs = some["tfs"].combine_chunks().flatten() if some.num_rows else pa.array([], pa.int32())
    docs = pa.table({c: some[c] for c in ("id", "file_path", "start_line", "length")} | {"size": pc.list_value_length(lists)})
    sink = pa.BufferOutputStream()
    for t in (docs, pa.table({"term": coded.indices, "tf": tfs})):
        with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_table(t)
    row = {"repo_id": block["repo_id"][0].as_py(), "part": block["part"][0].as_py(), "n": block.num_rows, "length": pc.sum(block["length"]).as_py(), "terms": coded.dictionary.to_pylist(), "dfs": dfs.tolist(), "body": sink.getvalue().to_pybytes()}
    kinds = {"repo_id": pa.string(), "part": pa.int32(), "n": pa.int64(), "length": pa.int64(), "terms": pa.list_(pa.string()), "dfs": pa.list_(pa.int32()), "body": pa.binary()}
    return pa.table({k: pa.array([row[k]], kind) for k, kind in kinds.items()})


def unpacked(body: bytes) -> tuple[pa.Table, pa.Table]:
    """(documents, their terms): what pack() put in."""
    source = pa.BufferReader(body)
    return pa.ipc.open_stream(source).read_all(), pa.ipc.open_stream(source).read_all()


def packed(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """PACKED: the documents of counted() with a repository, a row a block."""
    return in_blocks(rows.filter("repo_id is not null"), counts).groupBy("repo_id", "part").applyInArrow(pack, PACKED)


def meet(rows: DataFrame, queries: DataFrame, counts: DataFrame, kinds: list[tuple[str, DataType]], name: str, best) -> DataFrame:
    """(query_id, id, repo_id, file_path, start_line, name) of what best(rows, queries) keeps of each block.

    rows: (repo_id, part, …), as of in_blocks() or packed(); a query meets every part. kinds: the types of the columns
    but the last. best takes two tables and returns the rows that may be kept, and places in the queries, places in
    those rows and scores, each as an array.
    """
    q = queries.filter("repo_id is not null").join(parts_of(counts), "repo_id").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return empty
        own, at_query, at_row, scores = best(left, right)
        own = own.select(COLUMNS).take(pa.array(at_row, pa.int64()))
        asked = right["query_id"].take(pa.array(at_query, pa.int64()))
        return pa.Table.from_arrays([asked, *own.columns, pa.chunked_array([pa.array(scores, pa.float64())])], ["query_id", *COLUMNS, name])

    empty = to_arrow_schema(StructType([StructField(c, t) for c, t in kinds] + [StructField(name, DoubleType())])).empty_table()
    schema = ", ".join([*[f"{c} {t.simpleString()}" for c, t in kinds], f"{name} double"])
    return rows.groupBy("repo_id", "part").cogroup(q.groupBy("repo_id", "part")).applyInArrow(run, schema)


def first(scores: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and rounded values of the highest scores, equal ones by place; NaN is highest, as in Spark."""
    at = np.arange(len(scores))
    if len(scores) > limit:
        last = np.partition(scores, len(scores) - limit)[len(scores) - limit]
        at = np.flatnonzero(~(scores < last - NEAR))
    value = np.round(scores[at], DIGITS)
    order = np.lexsort((at, -np.where(np.isnan(value), np.inf, value)))[:limit]
    return at[order], value[order]


def stacked(found: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not found:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return np.repeat([q for q, _, _ in found], [len(a) for _, a, _ in found]), np.concatenate([a for _, a, _ in found]), np.concatenate([v for _, _, v in found])


def best_by_terms(limit: int, k1: float, b: float):
    """The best of a block of packed() by BM25; ties by file, line and id. queries: (query_id, term, idf, mean_length), a row a term."""

    def best(block: pa.Table, queries: pa.Table) -> tuple:
        docs, held = unpacked(block["body"][0].as_py())
        docs = docs.append_column("repo_id", pc.take(block["repo_id"], pa.array(np.zeros(docs.num_rows, np.int64))))
        asked = pc.unique(queries["term"])
        known = pc.index_in(block["terms"].combine_chunks().flatten(), value_set=asked)
        known = pc.fill_null(known, -1).to_numpy().astype(np.int64)
        term = known[held["term"].to_numpy()]
        kept = np.flatnonzero(term >= 0)
        term = term[kept]
        row = np.repeat(np.arange(docs.num_rows), docs["size"].to_numpy())[kept]
        tf = held["tf"].to_numpy()[kept].astype(float)
        length, mean = docs["length"].to_numpy().astype(float), queries["mean_length"][0].as_py()
        part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[row] / mean))
        order = np.argsort(term, kind="stable")
        row, part, starts = row[order], part[order], np.searchsorted(term[order], np.arange(len(asked) + 1))
        codes = pc.index_in(queries["term"], value_set=asked).to_numpy()
        idf = queries["idf"].to_numpy()
        of = queries["query_id"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        by = np.argsort(of, kind="stable")
        found = []
        for own in np.split(by, np.flatnonzero(np.diff(of[by])) + 1):
            scores = np.zeros(len(length))
            for i in own:
                a, z = starts[codes[i]], starts[codes[i] + 1]
                scores[row[a:z]] += idf[i] * part[a:z]
            some = np.flatnonzero(scores)
            at, value = first(scores[some], limit)
            good = value > 0
            found.append((own[0], some[at[good]], value[good]))
        q, at, value = stacked(found)
        return docs, q, at, value

    return best


def best_by_cosine(limit: int):
    """The nearest of a block by cosine; ties by id. An id counts once, with the nearest of its vectors and the last file and line.

    queries: (query_id, vector) of length 1.
    """

    def numbers(column: pa.ChunkedArray) -> np.ndarray:
        flat = column.combine_chunks()
        return flat.flatten().to_numpy().astype(float).reshape(len(flat), -1)

    def best(rows: pa.Table, queries: pa.Table) -> tuple:
        places = {c: pc.sort_indices(rows, sort_keys=[("id", "ascending"), (c, "descending")]).to_numpy() for c in ("file_path", "start_line")}
        ids = rows["id"].take(pa.array(places["file_path"])).combine_chunks().dictionary_encode().indices.to_numpy()
        starts = np.concatenate(([0], np.flatnonzero(np.diff(ids)) + 1))
        once = {c: rows[c].take(pa.array(places.get(c, places["file_path"])[starts])) for c in ("id", "repo_id", "file_path", "start_line")}
        vectors = numbers(rows["embedding"])[places["file_path"]]
        with np.errstate(invalid="ignore"):  # as for infinite numbers
            vectors /= np.sqrt((vectors * vectors).sum(1))[:, None]
            asked, of = np.unique(numbers(queries["vector"]), axis=0, return_inverse=True)  # equal ones are compared once
            found = []
            for a in range(0, len(asked), SLICE):
                scores = asked[a : a + SLICE] @ vectors.T
                if len(starts) < len(ids):
                    scores = np.maximum.reduceat(scores, starts, 1)
                found += [(a + i, *first(s, limit)) for i, s in enumerate(scores)]
        q, at, value = stacked([(i, *found[u][1:]) for i, u in enumerate(of.ravel())])
        return pa.table(once), q, at, value

    return best
