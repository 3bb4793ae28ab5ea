"""Gradient-boosted trees with logistic loss, in numpy; small models that are sent to executors whole."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Trees of depth 2 over the quantiles of each feature, with Newton steps in the leaves.

    Features are put into bins once; a node's best cut comes from sums of gradients over the bins of all features."""

    def __init__(self, rounds: int = 60, rate: float = 0.3, ridge: float = 1.0, bins: int = 24):
        self.rounds, self.rate, self.ridge, self.bins, self.trees, self.base = rounds, rate, ridge, bins, [], 0.0

    def _binned(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bin of each value, numbered over all features, and the values that end bins (infinite for none)."""
        cuts = np.full((x.shape[1], self.bins), np.inf)
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            some = values if len(values) <= self.bins else np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:]))
            cuts[f, : len(some)] = some
        at = np.stack([np.searchsorted(cuts[f], x[:, f]) for f in range(x.shape[1])], 1)
        return at + self.bins * np.arange(x.shape[1]), cuts

    def _split(self, sums: np.ndarray) -> tuple[int, int] | None:
        """Feature and bin of the cut with the most gain. sums: gradients, their curvatures and rows for each feature and bin."""
        low, all_ = np.cumsum(sums, axis=2), sums.sum(2)[:, :1, None]
        high = all_ - low
        of = lambda s: s[0] ** 2 / (s[1] + self.ridge)
        gain = np.where((low[2] > 0) & (high[2] > 0), of(low) + of(high) - of(all_), 0)
        best = np.unravel_index(np.argmax(gain), gain.shape)
        return (int(best[0]), int(best[1])) if gain[best] > 1e-9 else None

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base, z = float(np.log(p / (1 - p))), np.zeros(len(y))
        at, cuts = self._binned(x)
        shape, size = (x.shape[1], self.bins), x.shape[1] * self.bins
        first = self.bins * np.arange(x.shape[1])

        def sums(rows, g, h):
            flat, m = at[rows].ravel(), x.shape[1]
            return np.stack([np.bincount(flat, w, size).reshape(shape) for w in (np.repeat(g[rows], m), np.repeat(h[rows], m), None)])

        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-(self.base + z)))
            g, h, tree = y - q, q * (1 - q) + 1e-6, []
            whole = sums(slice(None), g, h)
            if (root := self._split(whole)) is None:
                break
            f, b = root
            low = at[:, f] - first[f] <= b
            left = sums(np.flatnonzero(low), g, h)
            for rows, own in ((np.flatnonzero(low), left), (np.flatnonzero(~low), whole - left)):
                f2, b2 = self._split(np.round(own, 9)) or (0, self.bins - 1)
                under = at[rows, f2] - first[f2] <= b2
                step = [float(self.rate * g[r].sum() / (h[r].sum() + self.ridge)) for r in (rows[under], rows[~under])]
                tree.append((f2, float(cuts[f2, b2]), *step))
                z[rows] += np.where(under, *step)
            self.trees.append((f, float(cuts[f, b]), *tree))
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for f, cut, low, high in self.trees:
            a, b = (np.where(x[:, t[0]] <= t[1], t[2], t[3]) for t in (low, high))
            out += np.where(x[:, f] <= cut, a, b)
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))
