"""A linear-chain conditional random field over sparse hashed features, in numpy: training, and Viterbi labelling."""

from __future__ import annotations

import zlib
from collections.abc import Sequence
from functools import lru_cache

import numpy as np

BITS = 16


@lru_cache(maxsize=1 << 17)
def hashed(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)


class Chain:
    """Two labels: 0 outside, 1 inside. emit is (features,), what each adds to label 1 over label 0; step is (2, 2)."""

    def __init__(self, emit: np.ndarray, step: np.ndarray):
        self.emit, self.step = emit, step
        self.steps = [float(x) for x in step.ravel()]

    def best(self, scores: Sequence[float]) -> list[int]:
        """Viterbi: the best labels of a sequence whose tokens have these scores of label 1 over label 0."""
        if not scores:
            return []
        s00, s01, s10, s11 = self.steps
        back: list[tuple[int, int]] = []
        a0, a1 = 0.0, scores[0]
        for x in scores[1:]:
            from0, from1 = int(a1 + s10 > a0 + s00), int(a1 + s11 > a0 + s01)
            back.append((from0, from1))
            a0, a1 = (a1 + s10 if from0 else a0 + s00), (a1 + s11 if from1 else a0 + s01) + x
        out = [int(a1 > a0)]
        for p in reversed(back):
            out.append(p[out[-1]])
        return out[::-1]

    def label(self, features: list[list[int]]) -> list[int]:
        """The best labels of a sequence of tokens, each given by its features."""
        return self.best([float(self.emit[f].sum()) for f in features])


def train(sequences: list[list[list[int]]], labels: list[list[int]], rounds: int = 60, rate: float = 0.1, decay: float = 1e-4) -> Chain:
    """Maximise the conditional log-likelihood by full-batch Adam; forward and backward run over all sequences at once."""
    n, longest = len(sequences), max(map(len, sequences))
    lengths = np.array([len(s) for s in sequences])
    row, column = np.repeat(np.arange(n), lengths), np.concatenate([np.arange(k) for k in lengths])
    sizes = np.array([len(f) for s in sequences for f in s])
    starts = np.concatenate(([0], sizes.cumsum()[:-1]))
    used, flat = np.unique(np.concatenate([np.array(f) for s in sequences for f in s]), return_inverse=True)
    y = np.zeros((n, longest), np.int64)
    y[row, column] = np.concatenate([np.array(l) for l in labels])
    mask = np.zeros((n, longest), bool)
    mask[row, column] = True
    both = (mask[:, 1:])[..., None, None]
    pair = both * (np.eye(2)[y[:, :-1]][..., :, None] * np.eye(2)[y[:, 1:]][..., None, :])
    w, step = np.zeros(len(used)), np.zeros((2, 2))
    m, v = [np.zeros_like(w), np.zeros_like(step)], [np.zeros_like(w), np.zeros_like(step)]
    for r in range(1, rounds + 1):
        e = np.zeros((n, longest, 2))
        e[row, column, 1] = np.add.reduceat(w[flat], starts)
        alpha, beta = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        alpha[:, 0] = e[:, 0]
        for t in range(1, longest):
            new = np.logaddexp(alpha[:, t - 1, 0, None] + step[0], alpha[:, t - 1, 1, None] + step[1]) + e[:, t]
            alpha[:, t] = np.where(mask[:, t, None], new, alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            z = e[:, t + 1] + beta[:, t + 1]
            new = np.logaddexp(step[:, 0] + z[:, 0, None], step[:, 1] + z[:, 1, None])
            beta[:, t] = np.where(mask[:, t + 1, None], new, 0.0)
        norm = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        p = np.exp(alpha[..., 1] + beta[..., 1] - norm[:, None])[row, column]
        q = np.exp(alpha[:, :-1, :, None] + step + (e[:, 1:] + beta[:, 1:])[..., None, :] - norm[:, None, None, None]) * both
        g_w = np.bincount(flat, np.repeat(y[row, column] - p, sizes), len(used)) / n - decay * w
        g_s = (pair - q).sum((0, 1)) / n - decay * step
        for j, (param, grad) in enumerate(((w, g_w), (step, g_s))):
            m[j] = 0.9 * m[j] + 0.1 * grad
            v[j] = 0.999 * v[j] + 0.001 * grad**2
            param += rate * (m[j] / (1 - 0.9**r)) / (np.sqrt(v[j] / (1 - 0.999**r)) + 1e-8)
    emit = np.zeros(1 << BITS)
    emit[used] = w
    return Chain(emit, step)
