"""Linear-chain conditional random field over dense features, batched over sequences.

Forward, backward and Viterbi passes step through positions once for all sequences
of a batch (longest first), so the Python cost is that of the longest sequence.
Everything is deterministic: fitting is full-batch with a fixed schedule.
"""

from __future__ import annotations

import numpy as np


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


class _Layout:
    """Which rows are the t-th of their sequences, longest sequences first."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = np.asarray(lengths, dtype=np.int64)
        starts = np.cumsum(self.lengths) - self.lengths
        order = np.argsort(-self.lengths, kind="stable")
        self.starts, self.sorted = starts[order], self.lengths[order]
        self.steps = int(self.sorted[0]) if len(self.sorted) else 0

    def at(self, t: int) -> np.ndarray:
        return self.starts[: np.searchsorted(-self.sorted, -t, side="left")] + t


class ChainCRF:
    """Labels 0..k-1 for every position of sequences of feature rows."""

    def __init__(self, labels: int, l2: float = 1e-3, steps: int = 150, rate: float = 0.1):
        self.labels, self.l2, self.steps, self.rate = labels, l2, steps, rate

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([(x - self.mean) / self.scale, np.ones((len(x), 1))])

    def _passes(self, e: np.ndarray, lay: _Layout) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        first = lay.at(0)
        alpha[first] = e[first] + self.start
        for t in range(1, lay.steps):
            i = lay.at(t)
            alpha[i] = e[i] + _logsumexp(alpha[i - 1][:, :, None] + self.move[None], 1)
        for t in range(lay.steps - 1, 0, -1):
            i = lay.at(t)
            beta[i - 1] = _logsumexp(self.move[None] + (e[i] + beta[i])[:, None, :], 2)
        total = np.repeat(_logsumexp(alpha[np.cumsum(lay.lengths) - 1], 1), lay.lengths)
        return alpha, beta, total

    def fit(self, x: np.ndarray, y: np.ndarray, lengths: np.ndarray, weights: np.ndarray | None = None) -> ChainCRF:
        """Maximum penalised likelihood; ``weights``, if given, is one per row and constant in a sequence."""
        k, n = self.labels, len(x)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        self.emit, self.move, self.start = np.zeros((x.shape[1] + 1, k)), np.zeros((k, k)), np.zeros(k)
        z, lay, one = self._scaled(x), _Layout(lengths), np.eye(k)[y]
        w = np.ones(n) if weights is None else weights
        first = np.cumsum(lay.lengths) - lay.lengths
        follows = np.ones(n, dtype=bool)
        follows[first] = False
        to = np.flatnonzero(follows)
        seen_move = np.einsum("n,ni,nj->ij", w[to], one[to - 1], one[to])
        moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (self.emit, self.move, self.start)]
        for step in range(1, self.steps + 1):
            e = z @ self.emit
            alpha, beta, total = self._passes(e, lay)
            p = np.exp(alpha + beta - total[:, None])
            pair = np.exp(alpha[to - 1][:, :, None] + self.move[None] + (e[to] + beta[to])[:, None, :] - total[to][:, None, None])
            grads = (
                z.T @ (w[:, None] * (one - p)) / n - self.l2 * self.emit,
                (seen_move - np.einsum("n,nij->ij", w[to], pair)) / n - self.l2 * self.move,
                (w[first, None] * (one[first] - p[first])).sum(axis=0) / n - self.l2 * self.start,
            )
            for value, grad, (m, v) in zip((self.emit, self.move, self.start), grads, moments, strict=True):
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                value += self.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return self

    def marginals(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Probability of each label at every position (forward-backward)."""
        if not len(x):
            return np.zeros((0, self.labels))
        alpha, beta, total = self._passes(self._scaled(x) @ self.emit, _Layout(lengths))
        return np.exp(alpha + beta - total[:, None])

    def decode(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The most likely label sequence (Viterbi); the lower label wins a tie."""
        if not len(x):
            return np.zeros(0, dtype=np.int64)
        e, lay = self._scaled(x) @ self.emit, _Layout(lengths)
        back = np.zeros(e.shape, dtype=np.int64)
        score = e.copy()
        first = lay.at(0)
        score[first] += self.start
        for t in range(1, lay.steps):
            i = lay.at(t)
            come = score[i - 1][:, :, None] + self.move[None]
            back[i] = come.argmax(axis=1)
            score[i] = e[i] + come.max(axis=1)
        out = np.zeros(len(x), dtype=np.int64)
        last = np.cumsum(lay.lengths) - 1
        out[last] = score[last].argmax(axis=1)
        for t in range(lay.steps - 1, 0, -1):
            i = lay.at(t)
            out[i - 1] = back[i, out[i]]
        return out
