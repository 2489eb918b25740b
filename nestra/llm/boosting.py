"""Gradient-boosted trees for a yes or no, on bounded samples; trees are plain arrays that score in bulk."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    prior: float
    features: np.ndarray  # tree, node: feature
    edges: np.ndarray  # tree, node: go right above this value
    leaves: np.ndarray  # tree, leaf: what is added to the log odds

    def probability(self, x: np.ndarray) -> np.ndarray:
        odds = np.full(len(x), self.prior)
        rows = np.arange(len(x))
        depth = int(np.log2(self.leaves.shape[1]))
        for features, edges, leaves in zip(self.features, self.edges, self.leaves, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, features[node]] > edges[node])
            odds += leaves[node - (len(leaves) - 1)]
        return 1 / (1 + np.exp(-odds))


def fit(x: np.ndarray, y: np.ndarray, n_trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32, penalty: float = 1.0) -> Trees:
    """Trees of one depth by Newton steps on the log loss, with split values at quantiles; the same input gives the same trees."""
    n, f = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(f)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)  # above cut b: bin > b
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    prior = float(np.log(mean / (1 - mean)))
    odds = np.full(n, prior)
    n_nodes, n_leaves = 2**depth - 1, 2**depth
    features, edges, leaves = np.zeros((n_trees, n_nodes), np.int64), np.full((n_trees, n_nodes), np.inf), np.zeros((n_trees, n_leaves))
    for t in range(n_trees):
        p = 1 / (1 + np.exp(-odds))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, np.int64)
        for _ in range(depth):
            for k in np.unique(node):
                own = node == k
                total_g, total_h = g[own].sum(), h[own].sum()
                gain, choice = 1e-6, None
                for j in range(f):
                    if len(cuts[j]) == 0:
                        continue
                    left_g = np.cumsum(np.bincount(binned[own, j], g[own], len(cuts[j]) + 1))[:-1]
                    left_h = np.cumsum(np.bincount(binned[own, j], h[own], len(cuts[j]) + 1))[:-1]
                    value = left_g**2 / (left_h + penalty) + (total_g - left_g) ** 2 / (total_h - left_h + penalty) - total_g**2 / (total_h + penalty)
                    if value.max() > gain:
                        gain, choice = value.max(), (j, int(value.argmax()))
                if choice:
                    features[t, k], edges[t, k] = choice[0], cuts[choice[0]][choice[1]]
            node = 2 * node + 1 + (x[np.arange(n), features[t, node]] > edges[t, node])
        leaf = node - n_nodes
        leaves[t] = rate * np.bincount(leaf, g, n_leaves) / (np.bincount(leaf, h, n_leaves) + penalty)
        odds += leaves[t, leaf]
    return Trees(prior, features, edges, leaves)


def calibrated_threshold(p: np.ndarray, y: np.ndarray, precision: float, least: int, floor: float = 0.0) -> float:
    """The least threshold, not under `floor`, from which at least `least` held-out candidates have that precision; above 1, so that none is chosen, if there is no such."""
    order = np.argsort(-p, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(p) + 1)
    last = np.r_[p[order][1:] != p[order][:-1], True] if len(p) else np.zeros(0, bool)  # candidates of one probability are chosen together
    good = np.flatnonzero((right >= precision) & last & (np.arange(1, len(p) + 1) >= least))
    return max(floor, float(p[order][good[-1]])) if len(good) else 2.0
