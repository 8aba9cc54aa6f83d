"""The most similar vectors of every vector, by balanced posting lists.

Centroids are fitted on a bounded sample by splitting until every list is small, so dense regions get more lists. An
in-memory graph over the centroids finds those next to a vector. Each vector goes to its nearest list and to others
whose centroid is hardly farther, so vectors near a boundary are in several lists; the same lists are searched for it.
Within a list all vectors meet in blocks. Copies, of whatever length, are one vector there and become rows again at the
end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DIM = 64
NEAREST = 5
FLOOR = 0.94
#: Vectors that a list should hold, the most lists, and the sampled vectors for each list; all bound the driver's work.
LIST_SIZE, MOST_LISTS, SAMPLED = 400, 16_384, 24
#: A vector goes to lists whose centroid is at most (1 + RATIO) times as far as the nearest, and to no more than COPIES.
RATIO, COPIES = 0.12, 3
#: The same three for the nearest vectors at any similarity: these lie farther off, so lists are longer and overlap more.
WIDE = 3_200, 0.2, 3
#: Without a floor a vector goes to so many lists at least: the nearest may be a small one whose centroid is the vector itself.
LEAST = 2
#: Links of a centroid in the graph, and how many candidates a search keeps.
LINKS, BEAM = 16, 12
#: Vectors of a list that are held against the list at a time.
BLOCK_ROWS = 2_048
#: A list that the sample expects to hold more is parted into blocks, of which each pair meets in a group of its own.
MOST_IN_GROUP = 8_192
#: Vectors whose directions agree to so many units in each number are one class, whatever their lengths.
UNITS = 10_000
#: A class of more ids than this, and than a thousandth of all, meets its neighbours by a broadcast; there are at most 1,000.
HEAVY = 10_000
SEED = 3


def split(x: np.ndarray, leaf: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Centroids of unit vectors: k-means of 8 parts, each split again while it holds more than leaf vectors."""
    if len(x) <= leaf:
        return [x.mean(0)]
    k = min(8, -(-len(x) // leaf))
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(8):
        near = (x @ c.T).argmax(1)
        c = np.stack([x[near == j].sum(0) if (near == j).any() else x[rng.integers(len(x))] for j in range(k)])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    near = (x @ c.T).argmax(1)
    sizes = np.bincount(near, minlength=k)
    if sizes.max() == len(x):  # vectors too alike to be told apart share one list: equal centroids would part their neighbours
        return [x.mean(0)]
    return [y for j in range(k) if (near == j).any() for y in split(x[near == j], leaf, rng)]


class Centroids:
    """Centroids and the graph over them; nearest() is a beam search for many vectors at a time."""

    def __init__(self, points: np.ndarray):
        self.points = (points / np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-12)).astype(np.float32)
        n = len(points)
        rng = np.random.default_rng(SEED)
        links = min(LINKS, n - 1)
        graph = np.empty((n, links + 4 if n > 1 else 0), np.int32)
        for a in range(0, n if n > 1 else 0, 1024):
            s = self.points[a : a + 1024] @ self.points.T
            s[np.arange(len(s)), np.arange(a, a + len(s))] = -2
            graph[a : a + 1024, :links] = np.argpartition(-s, links - 1, axis=1)[:, :links]
        if n > 1:
            graph[:, links:] = rng.integers(0, n, (n, 4))
        self.graph = graph
        #: Searches start from these, spread over the whole space.
        self.entries = rng.choice(n, min(n, 32), replace=False).astype(np.int32)

    def nearest(self, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(indices, similarities), best first, of k centroids for each row of x."""
        n, rows = len(self.points), len(x)
        beam = max(BEAM, k)
        at = np.arange(rows)[:, None]
        seen = np.zeros((rows, n), bool)
        s = x @ self.points[self.entries].T
        keep = min(beam, s.shape[1])
        top = np.argpartition(-s, keep - 1, axis=1)[:, :keep]
        ids, sims = self.entries[top].astype(np.int64), np.take_along_axis(s, top, 1)
        seen[at, ids] = True
        done = np.zeros(ids.shape, bool)
        while self.graph.shape[1] and not done.all():
            pick = np.where(done, -9.0, sims).argmax(1)  # the best candidate that was not expanded yet
            rest = ~np.take_along_axis(done, pick[:, None], 1)[:, 0]
            active = np.flatnonzero(rest)
            if not len(active):
                break
            done[active, pick[active]] = True
            new = self.graph[ids[active, pick[active]]]
            fresh = ~seen[active[:, None], new]
            seen[active[:, None], new] = True
            found = np.where(fresh, np.einsum("rd,rkd->rk", x[active], self.points[new]), -9.0)
            all_ids = np.concatenate([ids[active], new], 1)
            all_sims = np.concatenate([sims[active], found], 1)
            all_done = np.concatenate([done[active], ~fresh], 1)
            if all_ids.shape[1] > beam:
                top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
                all_ids, all_sims, all_done = (np.take_along_axis(v, top, 1) for v in (all_ids, all_sims, all_done))
            if all_ids.shape[1] > ids.shape[1]:
                grow = all_ids.shape[1] - ids.shape[1]
                ids = np.pad(ids, ((0, 0), (0, grow)))
                sims = np.pad(sims, ((0, 0), (0, grow)), constant_values=-9.0)
                done = np.pad(done, ((0, 0), (0, grow)), constant_values=True)
            ids[active], sims[active], done[active] = all_ids, all_sims, all_done
        order = np.argsort(-sims, axis=1)[:, :k]
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def lists(self, x: np.ndarray, ratio: float = RATIO, copies: int = COPIES, least: int = 1) -> list[np.ndarray]:
        """The lists of each row of x: the nearest, and those within the ratio of its distance; never fewer than least if there are as many."""
        ids, sims = self.nearest(x, min(copies, len(self.points)))
        distance = np.sqrt(np.maximum(0, 2 - 2 * sims))
        keep = (distance <= (1 + ratio) * distance[:, :1] + 1e-6) & (sims > -2)
        keep[:, :least] |= sims[:, :least] > -2
        return [i[k] for i, k in zip(ids, keep, strict=True)]


def parts_of(centroids: Centroids, sample: np.ndarray, n: int, copies: int) -> np.ndarray:
    """Into how many blocks each list is parted, by the share of the sample that is nearest to it."""
    if not len(sample):
        return np.ones(len(centroids.points), np.int32)
    nearest = np.concatenate([centroids.nearest(sample[a : a + 4096], 1)[0][:, 0] for a in range(0, len(sample), 4096)])
    expected = np.bincount(nearest, minlength=len(centroids.points)) * (n / len(sample)) * copies
    return np.maximum(1, np.ceil(2 * expected / MOST_IN_GROUP)).astype(np.int32) * (expected > MOST_IN_GROUP) + (expected <= MOST_IN_GROUP)


def groups_of(lists: np.ndarray, classes: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, pair): the pairs of blocks in which each row of (list, class) meets others; pair 0 alone where a list is whole."""
    p = parts[lists]
    if (p == 1).all():
        return np.arange(len(lists)), np.zeros(len(lists), np.int32)
    rows = np.repeat(np.arange(len(lists)), p)
    other = np.concatenate([np.arange(k) for k in p])
    own = (classes.astype(np.uint64) % p.astype(np.uint64)).astype(np.int64)[rows]
    return rows, (np.minimum(own, other) * p[rows] + np.maximum(own, other)).astype(np.int32)


def fit(sample: np.ndarray, lists: int) -> Centroids:
    if not len(sample):
        return Centroids(np.eye(1, DIM, dtype=np.float32))
    rng = np.random.default_rng(SEED)
    points = np.stack(split(sample, max(2, len(sample) // max(1, lists)), rng))
    unequal = np.unique((points / np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-12)).round(5), axis=0, return_index=True)[1]
    return Centroids(points[np.sort(unequal)])


def cutoffs(s: np.ndarray, k: int) -> np.ndarray:
    """A similarity for each row of s that at least its k best columns reach, and few others: the k-th best of 64 groups' bests."""
    n = s.shape[1]
    if n < 64 * 2 or k > 32:
        return np.full((len(s), 1), -np.inf, np.float32) if n <= k else -np.partition(-s, k - 1, axis=1)[:, k - 1 : k]
    width = n // 64
    best = s[:, : 64 * width].reshape(len(s), 64, width).max(2)
    return -np.partition(-best, k - 1, axis=1)[:, k - 1 : k]


def within(ids: np.ndarray, x: np.ndarray, floor: float, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, neighbour, similarity) of the k best other vectors of a list for each of its vectors, none below the floor."""
    n = len(x)
    for a in range(0, n, BLOCK_ROWS):
        best_s = best_i = None
        q = x[a : a + BLOCK_ROWS]
        for b in range(0, n, 4 * BLOCK_ROWS):
            s = q @ x[b : b + 4 * BLOCK_ROWS].T
            own = np.arange(a, a + len(q)) - b
            inside = (own >= 0) & (own < s.shape[1])
            s[np.flatnonzero(inside), own[inside]] = -9
            r, c = np.nonzero(s >= (floor if floor > -1 else np.maximum(cutoffs(s, k), -2)))
            part_s, part_i = (s[r, c], np.stack([r, c + b], 1)) if len(r) else (np.empty(0, np.float32), np.empty((0, 2), int))
            if best_s is None:
                best_s, best_i = part_s, part_i
            else:
                best_s, best_i = np.concatenate([best_s, part_s]), np.concatenate([best_i, part_i])
            if len(best_s):  # only the k best of each row stay
                order = np.lexsort((ids[best_i[:, 1]], -best_s, best_i[:, 0]))
                best_s, best_i = best_s[order], best_i[order]
                row = best_i[:, 0]
                first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
                rank = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
                best_s, best_i = best_s[rank < k], best_i[rank < k]
        if best_s is not None and len(best_s):
            yield ids[a + best_i[:, 0]], ids[best_i[:, 1]], best_s


def unit(column: pa.Array) -> np.ndarray:
    x = np.asarray(column.flatten(), np.float32).reshape(-1, DIM)
    return x / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True).astype(np.float32)


def usable(chunks: DataFrame) -> DataFrame:
    """(id, embedding) of rows whose embedding is given, DIM long, finite and not all zero."""
    e = F.col("embedding")
    return chunks.select("id", "embedding").filter(F.col("id").isNotNull() & e.isNotNull() & (F.size(e) == DIM) & F.exists(e, lambda v: v != 0) & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < 1e30)))


def directions(chunks: DataFrame) -> DataFrame:
    """(id, class, vector) of usable(): the vector at length 1 as bytes, and the class of its direction."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = unit(b.column(1))
            cells = np.rint(x * UNITS).astype(np.int16)
            classes = [xxhash.xxh3_64_intdigest(c.tobytes()) for c in cells]
            packed = pa.Array.from_buffers(pa.binary(DIM * 4), len(x), [None, pa.py_buffer(np.ascontiguousarray(x).tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(classes, np.uint64).view(np.int64)), packed], ["id", "class", "vector"])

    return usable(chunks).mapInArrow(run, "id string, class bigint, vector binary")


def unpacked(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, DIM)


def similar(chunks: DataFrame, k: int = NEAREST, floor: float = -1.0) -> DataFrame:
    """(id, neighbour, similarity, rank): the k most similar other ids of every id, cosine at least floor; ties go to the smaller id.

    A floor of -1 is none: every id gets its k neighbours, however far, and the lists are WIDE.

    Copies of a vector, of whatever length, a third of all rows if need be, are one class in the lists; no group of them
    is ever held in one task. Directions that differ by less than a unit of UNITS count as one, at similarity 1. Of a class only the k + 1 smallest ids can be neighbours of anything, and a window with a limit per key
    finds them, which the map side cuts already. Repeated rows of an id count once. The lists are an approximation
    (recall is measured in the tests); similarities are computed exactly for all that meet.
    """
    spark = chunks.sparkSession
    rows = directions(chunks)
    classes = rows.groupBy("class").agg(F.min("vector").alias("vector"))
    large = max(HEAVY, chunks.count() // 1000)
    n, heavy = rows.groupBy("class").count().agg(F.count("*"), F.collect_list(F.when(F.col("count") > large, F.col("class")))).first()
    list_size, ratio, copies = (LIST_SIZE, RATIO, COPIES) if floor > -1 else WIDE
    lists = int(min(MOST_LISTS, max(1, n // list_size)))
    want = lists * SAMPLED
    picked = classes if n <= want else classes.filter(F.pmod(F.xxhash64("class", F.lit(SEED)), F.lit(1_000_000)) < int(1_000_000 * want / n) + 1)
    sample = unpacked(picked.select("vector").limit(2 * want + 16).toArrow().column(0).combine_chunks())
    fitted = fit(sample, lists)
    centroids = spark.sparkContext.broadcast((fitted, parts_of(fitted, sample, n, copies)))  # at most MOST_LISTS

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, parts = centroids.value
        for b in batches:
            for a in range(0, b.num_rows, 4096):
                part = b.slice(a, 4096)
                if not part.num_rows:
                    continue
                x = unpacked(part.column(1))
                found = c.lists(x, ratio, copies, 1 if floor > -1 else LEAST)
                rows = np.repeat(np.arange(len(x)), [len(f) for f in found])
                lists = np.concatenate(found).astype(np.int32)
                again, pair = groups_of(lists, part.column(0).to_numpy()[rows], parts)
                taken = pa.array(rows[again])
                yield pa.RecordBatch.from_arrays([pa.array(lists[again]), pa.array(pair), part.column(0).take(taken), part.column(1).take(taken)], ["list", "pair", "class", "vector"])

    placed = classes.mapInArrow(place, "list int, pair int, class bigint, vector binary")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_ids: list[np.ndarray] = []
        kept: list[np.ndarray] = []
        current = None

        def out() -> Iterator[pa.RecordBatch]:
            if kept:
                for q, o, s in within(np.concatenate(kept_ids), np.concatenate(kept), floor, k):
                    yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(o), pa.array(s.astype(np.float64))], ["class", "other", "similarity"])

        for b in batches:
            if not b.num_rows:
                continue
            where = b.column(0).to_numpy().astype(np.int64) << 32 | b.column(1).to_numpy()
            ids = b.column(2).to_numpy()
            x = unpacked(b.column(3))
            edges = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1])))
            for a, z in zip(edges, np.append(edges[1:], len(where)), strict=True):
                if current is not None and where[a] != current:
                    yield from out()
                    kept_ids, kept = [], []
                current = where[a]
                kept_ids.append(ids[a:z])
                kept.append(x[a:z])
        yield from out()

    met = placed.repartition("list", "pair").sortWithinPartitions("list", "pair").mapInArrow(meet, "class bigint, other bigint, similarity double")
    links = met.repartition("class").groupBy("class", "other").agg(F.max("similarity").alias("similarity"))
    # as many other classes as could be needed: each holds an id, which is the own one where an id has two vectors
    links = links.withColumn("n", F.rank().over(Window.partitionBy("class").orderBy(F.desc("similarity")))).filter(F.col("n") <= k + 1).drop("n")

    members = rows.select("class", "id").distinct()
    small = Window.partitionBy("class").orderBy("id")
    heads = members.withColumn("n", F.row_number().over(small)).filter(F.col("n") <= k + 1).select("class", F.col("id").alias("neighbour"))
    own = heads.join(heads.groupBy("class").count().filter("count > 1").select("class"), "class")
    known = own.withColumn("similarity", F.lit(1.0)).unionByName(links.join(heads.withColumnRenamed("class", "other"), "other").select("class", "neighbour", "similarity"))
    met_by = members.join(known, "class")
    if heavy:  # one key each in a shuffle, so they are joined where they lie
        few = F.broadcast(known.filter(F.col("class").isin(*heavy)))
        met_by = members.filter(~F.col("class").isin(*heavy)).join(known, "class").unionByName(members.join(few, "class"))
    pairs = met_by.filter("id <> neighbour").repartition("id").groupBy("id", "neighbour").agg(F.max("similarity").alias("similarity"))
    w = Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbour")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def similar_pairs(chunks: DataFrame) -> DataFrame:
    """(id_a, id_b): pairs of ids of which one is among the most similar of the other, with at least FLOOR; id_a < id_b."""
    return similar(chunks, floor=FLOOR).select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
