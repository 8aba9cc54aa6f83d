"""Subjects of documents, from linear classifiers over hashed word n-grams.

Readers label whole documents, and the list of subjects names two typical words for each; both are weak labels for
sentences. One-versus-rest logistic classifiers are trained on sentences, twice again on what they themselves hold
for about the subject within labelled documents. A document treats a subject if one of its paragraphs has at least two
sentences above the subject's threshold; thresholds are set on labelled documents kept from training.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.session import spread

BITS = 17
LEAST_SENTENCES = 2
LEAST_WORDS = 4
#: Documents whose sentences are scored at a time.
BATCH = 512
#: At most so many labelled documents, by a seeded hash of the id, are used to train and calibrate.
MOST_LABELLED = 6_000
HELD_OUT = 0.3
ROUNDS, STEPS, RATE, DECAY = 3, 45, 0.4, 3e-6

COMMENT = re.compile(r"^\s*(?:#+|//+|\*+(?!\*)|--|;+|>+)\s?")
COMMENTED = re.compile(r"^\s*(?:#(?!\s*\w+\s*$|#)|//|\*\s)")
CODE_SPAN = re.compile(r"`[^`]*`|\b\w*_\w*\b|\b\w+\(\)?|\b[\w.-]+/[\w./-]+(?::\d+)?")
SENTENCE = re.compile(r"(?<=[.!?。])[\"')\]]*\s+(?=[^\sa-zß-ÿ])")
WORD = re.compile(r"[^\W\d_]+")
CODE_LINE = re.compile(r"^\s*(?:def |class |async def |@\w|import \w|from [\w.]+ import |return\b(?!.*[.]$)|raise |assert |[\w.]+\s*=\s|[\w.]+\(.*\)\s*$|\|.*\|\s*$|```)|[:;{]\s*$")


def paragraphs(text: str) -> list[list[str]]:
    """The sentences of each paragraph: a block between blank lines, or a block of comment lines within one."""
    out = []
    for block in re.split(r"\n[ \t]*(?:(?:#|//|\*|>)?[ \t]*\n)+", text):
        lines = block.split("\n")
        commented = sum(bool(COMMENTED.match(x)) for x in lines)
        runs: list[list[str]] = [[]]
        if commented and commented < len(lines):
            last = None
            for x in lines:
                kind = bool(COMMENTED.match(x))
                if kind != last and runs[-1]:
                    runs.append([])
                last = kind
                runs[-1].append(x)
        else:
            runs = [lines]
        for run in runs:
            prose = " ".join(COMMENT.sub("", x).strip() for x in run if not CODE_LINE.search(x) or COMMENTED.match(x))
            prose = re.sub(r"^\s*(?:[rRuU]?(?:\"\"\"|''')|/\*+)|(?:\"\"\"|'''|\*/)\s*$", "", prose.strip())
            found = [s for s in SENTENCE.split(prose) if s]
            if found:
                out.append(found)
    return out


@lru_cache(maxsize=1 << 18)
def hashed(gram: str) -> int:
    return zlib.crc32(gram.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)


def grams(sentence: str) -> list[int]:
    """Hashed single words and pairs of a sentence, code left out; empty for what is too short to be a sentence."""
    w = WORD.findall(CODE_SPAN.sub(" ", sentence).lower())
    if len(w) < LEAST_WORDS:
        return []
    out = {hashed(x) for x in w}
    out.update(hashed(f"{a} {b}") for a, b in zip(w, w[1:], strict=False))
    return list(out)


class Model:
    """Weights (2 ** BITS, subjects), biases and thresholds."""

    def __init__(self, subjects: list[str], weights: np.ndarray, bias: np.ndarray, thresholds: np.ndarray):
        self.subjects, self.weights, self.bias, self.thresholds = subjects, weights, bias, thresholds

    def best(self, texts: Sequence[str]) -> np.ndarray:
        """(texts, subjects): the LEAST_SENTENCES-th highest score within a paragraph, of the best paragraph of each text.

        The sentences of all texts are scored by one sparse product.
        """
        top = np.full((len(texts), len(self.subjects)), -np.inf)
        rows: list[list[int]] = []
        spans: list[tuple[int, int, int]] = []
        for d, text in enumerate(texts):
            for p in paragraphs(text):
                start = len(rows)
                rows += [g for g in map(grams, p) if g] if len(p) >= LEAST_SENTENCES else []
                if len(rows) - start >= LEAST_SENTENCES:
                    spans.append((d, start, len(rows)))
                else:
                    del rows[start:]
        if not rows:
            return top
        lengths = np.array([len(r) for r in rows])
        starts = np.concatenate(([0], lengths.cumsum()[:-1]))
        scores = np.add.reduceat(self.weights[np.concatenate([np.array(r) for r in rows])], starts, 0) / np.sqrt(lengths)[:, None] + self.bias
        for d, a, z in spans:
            top[d] = np.maximum(top[d], np.partition(scores[a:z], z - a - LEAST_SENTENCES, 0)[z - a - LEAST_SENTENCES])
        return top


def fit_sentences(rows: list[list[int]], target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One-versus-rest logistic regression by full-batch Adam; target is (sentences, subjects)."""
    n, k = target.shape
    lengths = np.array([len(r) for r in rows])
    flat = np.concatenate([np.array(r) for r in rows])
    used, index = np.unique(flat, return_inverse=True)
    owner = np.repeat(np.arange(n), lengths)
    scale = 1 / np.sqrt(lengths)
    starts = np.concatenate(([0], lengths.cumsum()[:-1]))
    w, b = np.zeros((len(used), k)), np.full(k, -2.0)
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros(k), np.zeros(k)
    for t in range(1, STEPS + 1):
        z = np.add.reduceat(w[index], starts, 0) * scale[:, None] + b
        error = target - 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        g = np.stack([np.bincount(index, (error[:, j] * scale)[owner], len(used)) for j in range(k)], 1) / n - DECAY * w
        gb = error.mean(0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.999**t
        w += RATE * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        b += RATE * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    full = np.zeros((1 << BITS, k), np.float32)
    full[used] = w
    return full, b


def fit(labelled: list[tuple[int, str, set[str]]], seeds: dict[str, list[str]]) -> Model:
    """Train and calibrate on (doc_id, text, subjects). seeds: the words by which the list of subjects describes each.

    Without labelled documents nothing is ever found.
    """
    names = sorted(seeds)
    k = len(names)
    column = {s: j for j, s in enumerate(names)}
    part = [zlib.crc32(f"part {d}".encode()) % 1000 < HELD_OUT * 1000 for d, _, _ in labelled]
    rows, target, held = [], [], []
    for (_, text, subjects), out in zip(labelled, part, strict=True):
        y = np.zeros(k)
        y[[column[s] for s in subjects if s in column]] = 1
        if out:
            held.append((text, y))
            continue
        for p in paragraphs(text):
            for s in p:
                if g := grams(s):
                    rows.append(g)
                    target.append(y)
    for s, seed in seeds.items():  # the description of a subject is a sentence about it
        y = np.zeros(k)
        y[column[s]] = 1
        for x in seed:
            rows.append([hashed(x)])
            target.append(y)
    if not labelled or not rows:
        return Model(names, np.zeros((1 << BITS, k), np.float32), np.zeros(k), np.full(k, np.inf))
    whole = np.array(target)
    soft = whole.copy()
    lengths, flat = np.array([len(r) for r in rows]), np.concatenate([np.array(r) for r in rows])
    starts = np.concatenate(([0], lengths.cumsum()[:-1]))
    for _ in range(ROUNDS):
        w, b = fit_sentences(rows, soft)
        z = np.add.reduceat(w[flat], starts, 0) / np.sqrt(lengths)[:, None] + b
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        #: Within a labelled document only the sentences that look like the subject count for it.
        soft = whole * (p > 0.3)
    model = Model(names, w, b, np.zeros(k))
    if held:
        best = model.best([t for t, _ in held])
        truth = np.stack([y for _, y in held])
        for j in range(k):
            order = np.unique(best[:, j][np.isfinite(best[:, j]) & (best[:, j] > -3)])
            cuts = np.concatenate(([0.0], (order[1:] + order[:-1]) / 2)) if len(order) > 1 else np.array([0.0])
            good = np.array([2 * ((best[:, j] >= c) & (truth[:, j] > 0)).sum() / max(1, (best[:, j] >= c).sum() + truth[:, j].sum()) for c in cuts])
            near = cuts[good >= good.max() - 1e-9]
            model.thresholds[j] = near[np.abs(near).argmin()]
    return model


def trained(documents: DataFrame, labels: DataFrame, subjects: DataFrame) -> Model:
    """The model of a corpus; what is collected is bounded by MOST_LABELLED documents and the list of subjects."""
    seeds = {r.subject: re.findall(r"\w+", (r.description or "").partition("instance")[2].lower().replace(" or ", " ")) for r in subjects.select("subject", "description").filter("subject is not null").limit(10_000).collect()}
    per = labels.filter("doc_id is not null and subject is not null").groupBy("doc_id").agg(F.collect_set("subject").alias("subjects"))
    n = per.count()
    if n > MOST_LABELLED:
        per = per.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * MOST_LABELLED / n))
    rows = documents.select("doc_id", "text").filter("text is not null").join(per, "doc_id").collect()
    return fit(sorted(((r.doc_id, r.text, set(r.subjects)) for r in rows), key=lambda r: r[0]), seeds)


def document_subjects(documents: DataFrame, labels: DataFrame, subjects: DataFrame) -> DataFrame:
    """(doc_id, subject) of every document; documents without a subject, null and empty texts give no row."""
    model = documents.sparkSession.sparkContext.broadcast(trained(documents, labels, subjects))  # 2 ** BITS rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        names = pa.array(m.subjects, pa.string())
        for b in batches:
            for a in range(0, b.num_rows, BATCH):
                part = b.slice(a, BATCH)
                doc, subject = np.nonzero(m.best(part.column(1).to_pylist()) >= m.thresholds)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()).take(pa.array(doc)), names.take(pa.array(subject))], ["doc_id", "subject"])

    return spread(documents.filter("doc_id is not null and text is not null").select("doc_id", "text"), "doc_id").mapInArrow(run, "doc_id bigint, subject string").distinct()


def composition(documents: DataFrame, labels: DataFrame, subjects: DataFrame) -> DataFrame:
    """(subject, documents, share): how many documents treat each subject, and that as a share of all; subjects of none count 0."""
    found = document_subjects(documents, labels, subjects).groupBy("subject").agg(F.count("*").alias("documents"))
    n = max(1, documents.count())
    return subjects.select("subject").join(F.broadcast(found), "subject", "left").select("subject", F.coalesce("documents", F.lit(0)).alias("documents"), F.round(F.coalesce("documents", F.lit(0)) / F.lit(n), 6).alias("share"))
