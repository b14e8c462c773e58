"""Gradient-boosted decision trees for 0/1 labels: trained in numpy on bounded samples, scored in numpy or as SQL."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Tree:
    """Nodes in arrays; a node with feature -1 is a leaf. Left is value <= threshold."""

    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self, value: float) -> int:
        for at, x in ((self.feature, -1), (self.threshold, 0.0), (self.left, -1), (self.right, -1), (self.value, value)):
            at.append(x)
        return len(self.feature) - 1


@dataclass
class Boosted:
    trees: list[Tree]
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of label 1 for each row of features."""
        total = np.full(len(x), self.base)
        for t in self.trees:
            feature, threshold = np.array(t.feature), np.array(t.threshold)
            left, right, value = np.array(t.left), np.array(t.right), np.array(t.value)
            node = np.zeros(len(x), np.int64)
            while True:
                inner = np.flatnonzero(feature[node] >= 0)
                if not len(inner):
                    break
                at = node[inner]
                node[inner] = np.where(x[inner, feature[at]] <= threshold[at], left[at], right[at])
            total += value[node]
        return total

    def column(self, features: list[Column]) -> Column:
        """The same log odds as one expression of CASE WHENs."""

        def walk(t: Tree, at: int) -> Column:
            if t.feature[at] < 0:
                return F.lit(float(t.value[at]))
            return F.when(features[t.feature[at]] <= F.lit(float(t.threshold[at])), walk(t, t.left[at])).otherwise(walk(t, t.right[at]))

        total = F.lit(float(self.base))
        for t in self.trees:
            total = total + walk(t, 0)
        return total


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.2, bins: int = 32, least: float = 5.0, ridge: float = 1.0, weight: np.ndarray | None = None,
        share: float = 1.0, seed: int = 1) -> Boosted:
    """Newton boosting of the logistic loss on quantile bins; each tree may use a random ``share`` of the features. A single label gives that label's prior alone, no rows a low one."""
    weight = np.ones(len(y)) if weight is None else weight
    p = np.clip((weight @ y + 0.5) / (weight.sum() + 1), 0.01, 0.99) if len(y) else 0.01
    model = Boosted([], float(np.log(p / (1 - p))))
    if not len(y) or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    width = max(len(e) for e in edges) + 1
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], 1)
    real = np.arange(width - 1)[None, :] < np.array([len(e) for e in edges])[:, None]
    margin, draw = np.full(len(y), model.base), np.random.default_rng(seed)
    for _ in range(trees):
        chosen = np.arange(x.shape[1]) if share >= 1 else np.sort(draw.permutation(x.shape[1])[: max(1, int(share * x.shape[1]))])
        slots = binned[:, chosen] + np.arange(len(chosen)) * width  # of each feature's bin in one histogram of all features
        cut = real[chosen]
        q = 1 / (1 + np.exp(-margin))
        g, h = weight * (y - q), weight * q * (1 - q)
        tree = Tree()

        def grow(rows: np.ndarray, level: int, g: np.ndarray = g, h: np.ndarray = h, tree: Tree = tree, slots: np.ndarray = slots, cut: np.ndarray = cut, chosen: np.ndarray = chosen) -> int:
            gs, hs = g[rows].sum(), h[rows].sum()
            at = tree.add(float(rate * gs / (hs + ridge)))
            best = (1e-6, -1, -1)
            if level < depth and len(rows) >= 2 * least:
                held = slots[rows].ravel()
                below = lambda w: np.cumsum(np.bincount(held, None if w is None else np.repeat(w[rows], len(chosen)), len(chosen) * width).reshape(-1, width), axis=1)[:, :-1]
                gl, hl, n = below(g), below(h), below(None)
                gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                gain[(n < least) | (len(rows) - n < least) | ~cut] = -1
                j, k = divmod(int(gain.argmax()), width - 1)
                if gain[j, k] > best[0]:
                    best = (float(gain[j, k]), j, k)
            if best[1] >= 0:
                low = slots[rows, best[1]] <= best[2] + best[1] * width
                tree.feature[at], tree.threshold[at] = int(chosen[best[1]]), float(edges[chosen[best[1]]][best[2]])
                tree.left[at] = grow(rows[low], level + 1)
                tree.right[at] = grow(rows[~low], level + 1)
            else:
                margin[rows] += tree.value[at]
            return at

        grow(np.arange(len(y)), 0)
        model.trees.append(tree)
    return model
