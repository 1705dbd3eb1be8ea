"""Leaf-wise histogram gradient boosting for squared error, in numpy.

A back-test fits a few thousand rows a fold (territories by months, which more years and
not more data make longer), so that a fold is one task and the folds run side by side
(``ml.boosted_predictions``). Values are cut into at most 255 bins; missing values have a
bin of their own and go to the better side of each split. The leaf of the highest gain is
split next, up to ``leaves``.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np

MISSING = 255
#: Gains up to this are rounding.
LEAST = 1e-12


def edges(values: np.ndarray, bins: int = MISSING) -> np.ndarray:
    """Upper bounds of the bins but the last: midpoints of distinct values, or of quantiles."""
    known = values[~np.isnan(values)]
    distinct = np.unique(known)
    if len(distinct) <= bins:
        return (distinct[1:] + distinct[:-1]) / 2
    return np.unique(np.percentile(known, np.linspace(0, 100, bins + 1)[1:-1], method="midpoint"))


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    out = np.stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(cuts)], axis=1).astype(np.uint8)
    out[np.isnan(x)] = MISSING
    return out


@dataclass
class Split:
    gain: float
    feature: int = 0
    bin: int = 0
    missing_left: bool = False


@dataclass
class Boosting:
    iterations: int = 300
    rate: float = 0.05
    leaves: int = 31
    min_leaf: int = 20
    l2: float = 1.0
    trees: list = field(default_factory=list)

    def _best(self, codes: np.ndarray, g: np.ndarray, rows: np.ndarray) -> Split:
        """The split of the highest gain, the first of equal ones."""
        n, f = len(rows), codes.shape[1]
        if n < 2 * self.min_leaf:
            return Split(0.0)
        at = (codes[rows].astype(np.int64) + np.arange(f) * 256).ravel()
        counts = np.bincount(at, minlength=f * 256).reshape(f, 256)
        sums = np.bincount(at, weights=np.repeat(g[rows], f), minlength=f * 256).reshape(f, 256)
        total = g[rows].sum()
        best = Split(LEAST)
        for left in (False, True):
            nl = np.cumsum(counts[:, :MISSING], axis=1) + (counts[:, MISSING:] if left else 0)
            gl = np.cumsum(sums[:, :MISSING], axis=1) + (sums[:, MISSING:] if left else 0)
            nr, gr = n - nl, total - gl
            gain = gl**2 / (nl + self.l2) + gr**2 / (nr + self.l2) - total**2 / (n + self.l2)
            gain[(nl < self.min_leaf) | (nr < self.min_leaf)] = -np.inf
            k = int(gain.argmax())
            if gain.flat[k] > best.gain:
                best = Split(float(gain.flat[k]), *divmod(k, MISSING), left)
        return best

    def _goes_left(self, codes: np.ndarray, s: Split) -> np.ndarray:
        c = codes[:, s.feature]
        return np.where(c == MISSING, s.missing_left, c <= s.bin)

    def _grow(self, codes: np.ndarray, g: np.ndarray) -> tuple[list, np.ndarray]:
        """(nodes, the step of each row): a node is (split, left, right) or a value."""
        nodes: list = [None]
        rows = {0: np.arange(len(g))}
        heap, n_leaves = [], 1

        def offer(node):
            s = self._best(codes, g, rows[node])
            if s.gain > LEAST:
                heapq.heappush(heap, (-s.gain, node, s))

        offer(0)
        while heap and n_leaves < self.leaves:
            _, node, s = heapq.heappop(heap)
            own = rows.pop(node)
            left = self._goes_left(codes[own], s)
            a = len(nodes)
            nodes[node] = (s, a, a + 1)
            nodes += [None, None]
            rows[a], rows[a + 1] = own[left], own[~left]
            n_leaves += 1
            if n_leaves < self.leaves:
                offer(a)
                offer(a + 1)
        step = np.zeros(len(g))
        for node, own in rows.items():
            nodes[node] = -self.rate * g[own].sum() / (len(own) + self.l2)
            step[own] = nodes[node]
        return nodes, step

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosting:
        self.cuts = [edges(x[:, k]) for k in range(x.shape[1])]
        codes = binned(x, self.cuts)
        self.start, self.trees = float(y.mean()), []
        now = np.full(len(y), self.start)
        for _ in range(self.iterations):
            nodes, step = self._grow(codes, now - y)
            self.trees.append(nodes)
            now += step
            if len(nodes) == 1:
                break
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        codes, out = binned(x, self.cuts), np.full(len(x), self.start)
        for nodes in self.trees:
            todo = [(0, np.arange(len(x)))]
            while todo:
                node, rows = todo.pop()
                if isinstance(nodes[node], tuple):
                    s, a, b = nodes[node]
                    left = self._goes_left(codes[rows], s)
                    todo += [(a, rows[left]), (b, rows[~left])]
                else:
                    out[rows] += nodes[node]
        return out
