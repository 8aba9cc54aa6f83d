"""Evaluation items that documents carry, whole or in large part.

The items make a BM25 inverted index with the highest impact of each term in each block of items. Every passage of every
document is a query; block-max WAND retrieves all items above the item's threshold, which is no higher than the least
score that half of the item can have. Blocks are ranges of item numbers, the same for all terms, so WAND's test, whether
the highest impacts add up to the threshold, runs for all blocks at once, and only items of blocks that pass are scored.
An alignment of words then decides.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.session import spread

MARKUP = re.compile(r"</?[A-Za-z][^<>\n]{0,80}>|&(?:nbsp|lt|gt|amp|quot);")
SIGNS = re.compile(r"[\W_]+")
K1, B = 1.2, 0.75
BLOCK = 4
SHARE = 0.5
REPLACED = 0.1
GRID = 300
#: The index is broadcast; more text than this is refused.
MOST_CHARS = 64_000_000


def words(text: str) -> list[str]:
    """What stands between white space, in lower case and without punctuation; markup and comment signs leave nothing."""
    if "<" in text or "&" in text:
        text = MARKUP.sub(" ", text)
    return [w for x in text.lower().split() if (w := x if x.isalnum() else SIGNS.sub("", x))]


class Index:
    """Postings of the items, scaled so that an item is retrieved at a score of 1."""

    def __init__(self, items: dict[int, str]):
        self.ids = sorted(items)
        self.words = [words(items[i]) for i in self.ids]
        lengths = [len(w) for w in self.words]
        n, mean = len(self.ids), (sum(lengths) / len(lengths) if lengths else 0.0)
        self.longest = max(lengths, default=0)
        frequency = Counter(t for w in self.words for t in set(w))
        idf = {t: math.log(1 + (n - f + 0.5) / (f + 0.5)) for t, f in frequency.items()}
        lists: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for d, w in enumerate(self.words):
            tf = Counter(w)
            impact = {t: idf[t] * c * (K1 + 1) / (c + K1 * (1 - B + B * len(w) / mean)) for t, c in tf.items()}
            least = self.threshold(w, impact)
            for t, x in impact.items():
                lists[t].append((d, x / least if least > 0 else 1.0))
        #: term: (items, impacts, highest impact, blocks that have it, highest impact in each of these)
        self.lists = {}
        for t, p in lists.items():
            docs, x = np.array([d for d, _ in p]), np.array([v for _, v in p])
            blocks, first = np.unique(docs // BLOCK, return_index=True)
            self.lists[t] = (docs, x, float(x.max()), blocks, np.maximum.reduceat(x, first))
        self.blocks = -(-n // BLOCK)

    @staticmethod
    def threshold(w: list[str], impact: dict[str, float]) -> float:
        """A score that no run of at least half of the item's words falls below, one word in ten replaced.

        A longer run only loses another word with every ten it gains, so the lengths at which that happens suffice. Of
        items of more than GRID words only every n-th run is looked at, shortened by as much, which lowers the bound
        and loses nothing.
        """
        n = len(w)
        half = max(1, math.ceil(n * SHARE))
        stride = max(1, n // GRID)
        best = math.inf
        for size in sorted({half, *range(10 * (half // 10 + 1), n + 1, 10 * stride)}):
            lost = int((size + 10 * (stride - 1)) * REPLACED)
            for a in range(0, n - size + 1, stride):
                run = sorted((impact[t] for t in set(w[a : a + max(1, size - stride + 1)])), reverse=True)
                best = min(best, sum(run[lost:]))
        return best

    def search(self, terms: set[str]) -> list[int]:
        """Block-max WAND: all items whose score over the terms is at least 1."""
        found = [p for t in terms if (p := self.lists.get(t))]
        if sum(p[2] for p in found) < 1 - 1e-9:
            return []
        bound = np.bincount(np.concatenate([p[3] for p in found]), np.concatenate([p[4] for p in found]), self.blocks)
        alive = bound >= 1 - 1e-9
        if not alive.any():
            return []
        docs, impacts = np.concatenate([p[0] for p in found]), np.concatenate([p[1] for p in found])
        kept = alive[docs // BLOCK]
        scores = np.bincount(docs[kept], impacts[kept], len(self.ids))
        return np.flatnonzero(scores >= 1 - 1e-9).tolist()

    def holds(self, item: int, text: list[str]) -> bool:
        """Whether a text holds at least half of the item's words as one passage, in order, at most one in ten replaced.

        Words of both that are equal lie on diagonals; on each, every run that is long enough is counted.
        """
        a = self.words[item]
        n = len(a)
        need = math.ceil(n * SHARE)
        places: dict[str, list[int]] = defaultdict(list)
        for k, t in enumerate(a):
            places[t].append(k)
        diagonals: dict[int, list[int]] = defaultdict(list)
        for k, t in enumerate(text):
            for q in places.get(t, ()):
                diagonals[k - q].append(q)
        for hits in diagonals.values():
            if len(hits) < need - int(need * REPLACED):
                continue
            upto = np.zeros(n + 1, int)
            upto[np.array(hits) + 1] = 1
            upto = upto.cumsum()
            if any((upto[size:] - upto[:-size]).max() >= size - int(size * REPLACED) for size in range(need, n + 1)):
                return True
        return False


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) of every document that holds an item, duplicates of documents included.

    Passages are windows of twice the longest item, half of which the next one shares, so each possible passage lies
    within one window whole. Null texts and items hold nothing; an empty item is held by none. The items, a fixed
    held-out set, are broadcast; more than MOST_CHARS of them are refused.
    """
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    if size > MOST_CHARS:
        raise ValueError(f"the items have {size} characters, more than {MOST_CHARS}")
    index = Index({r.item_id: r.text for r in items.select("item_id", "text").filter("item_id is not null and trim(text) <> ''").collect()})
    shared = documents.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        step = max(1, ix.longest)
        for b in batches:
            docs, found = [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = words(text)
                hits: set[int] = set()
                for at in range(0, max(1, len(w) - step), step):
                    part = w[at : at + 2 * step]
                    for item in ix.search(set(part)):
                        if item not in hits and ix.holds(item, part):
                            hits.add(item)
                for item in sorted(hits):
                    docs.append(doc)
                    found.append(ix.ids[item])
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(found, pa.int64())], ["doc_id", "item_id"])

    rows = documents.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text")
    return spread(rows, "doc_id").mapInArrow(run, "doc_id bigint, item_id bigint").distinct()
