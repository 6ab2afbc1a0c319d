"""Histogram gradient-boosted trees for a yes/no label, in numpy.

Values are put in quantile bins once; a level of a tree is grown from one
histogram of gradients over (node, feature, bin). A fitted model is four flat
arrays, so rows are scored by walking all trees at once with array indexing.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Trees(NamedTuple):
    feature: np.ndarray  # (trees, inner nodes), -1 where a node does not split
    threshold: np.ndarray  # (trees, inner nodes), go right if greater
    value: np.ndarray  # (trees, leaves)
    start: float  # log odds before the first tree

    def log_odds(self, rows: np.ndarray) -> np.ndarray:
        out = np.full(len(rows), self.start)
        if not len(self.feature):
            return out
        depth = int(np.log2(self.value.shape[1]))
        tree = np.arange(len(self.feature))[None, :]
        at = np.arange(len(rows))[:, None]
        node = np.zeros((len(rows), len(self.feature)), dtype=np.int64)
        for _ in range(depth):
            feature = self.feature[tree, node]
            right = (rows[at, np.maximum(feature, 0)] > self.threshold[tree, node]) & (feature >= 0)
            node = 2 * node + 1 + right
        return out + self.value[tree, node - (self.value.shape[1] - 1)].sum(axis=1)

    def probability(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(rows), -30, 30)))


def fit(
    rows: np.ndarray, label: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 48,
    penalty: float = 1.0, least_weight: float = 2.0,
) -> Trees:
    """Fit to 0/1 labels. Without rows the score is one half; with one class it is close to that class."""
    inner, leaves = 2**depth - 1, 2**depth
    share = (label.sum() + 0.5) / (len(label) + 1)
    start = float(np.log(share / (1 - share)))
    empty = Trees(np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, leaves)), start)
    if len(label) == 0 or label.min() == label.max():
        return empty
    n, width = rows.shape
    edges = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(edges[f], rows[:, f], "left") for f in range(width)], axis=1)
    cuts = np.full((width, bins), np.inf)
    for f, e in enumerate(edges):
        cuts[f, : len(e)] = e
    flat = binned + np.arange(width) * bins
    odds = np.full(n, start)
    out = []
    for _ in range(trees):
        chance = 1 / (1 + np.exp(-odds))
        slope, curve = chance - label, chance * (1 - chance)
        feature, threshold = np.full(inner, -1), np.zeros(inner)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            base, nodes = 2**level - 1, 2**level
            key = ((node - base)[:, None] * (width * bins) + flat).ravel()
            shape = (nodes, width, bins)
            g = np.bincount(key, np.repeat(slope, width), nodes * width * bins).reshape(shape).cumsum(axis=2)
            h = np.bincount(key, np.repeat(curve, width), nodes * width * bins).reshape(shape).cumsum(axis=2)
            all_g, all_h = g[:, :1, -1:], h[:, :1, -1:]
            gain = g**2 / (h + penalty) + (all_g - g) ** 2 / (all_h - h + penalty) - all_g**2 / (all_h + penalty)
            gain[(h < least_weight) | (all_h - h < least_weight) | ~np.isfinite(cuts)[None]] = 0
            best = gain.reshape(nodes, -1).argmax(axis=1)
            for k in range(nodes):
                if gain[k].flat[best[k]] > 1e-9:
                    feature[base + k] = best[k] // bins
                    threshold[base + k] = cuts[best[k] // bins, best[k] % bins]
            f = feature[node]
            node = 2 * node + 1 + ((rows[np.arange(n), np.maximum(f, 0)] > threshold[node]) & (f >= 0))
        leaf = node - inner
        value = -rate * np.bincount(leaf, slope, leaves) / (np.bincount(leaf, curve, leaves) + penalty)
        odds += value[leaf]
        out.append((feature, threshold, value))
    return Trees(*(np.stack(x) for x in zip(*out)), start)
