"""Histogram gradient-boosted trees for two classes, as flat arrays.

Trees are complete binary trees: node ``n`` has the children ``2n+1`` and ``2n+2``. A model is a set of
arrays (trees x nodes), so scoring a batch is one vectorised step per level and tree.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass
class Trees:
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    start: float

    def margins(self, rows: np.ndarray) -> np.ndarray:
        """Log-odds of class 1 for each row of features."""
        total = np.full(len(rows), self.start)
        every = np.arange(len(rows))
        depth = int(np.log2(self.value.shape[1] + 1)) - 1
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(rows), dtype=np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (rows[every, feature[node]] > threshold[node])
            total += value[node]
        return total

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.margins(rows)))


def fit(
    rows: np.ndarray,
    labels: np.ndarray,
    trees: int = 60,
    depth: int = 4,
    rate: float = 0.2,
    penalty: float = 1.0,
    least_weight: float = 2.0,
) -> Trees:
    """Newton boosting of the logistic loss over feature histograms.

    With one class only, or no rows, the model is a constant near that class.
    """
    labels = np.asarray(labels, dtype=np.float64)
    width = rows.shape[1]
    nodes = 2 ** (depth + 1) - 1
    positive = (labels.sum() + 0.5) / (len(labels) + 1.0)
    model = Trees(
        np.zeros((trees, nodes), dtype=np.int64),
        np.full((trees, nodes), np.inf),
        np.zeros((trees, nodes)),
        float(np.log(positive / (1 - positive))),
    )
    if len(labels) < 2 or labels.min() == labels.max():
        return model
    edges = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(edges[f], rows[:, f], side="left") for f in range(width)], axis=1)
    margin = np.full(len(labels), model.start)
    for tree in range(trees):
        chance = 1.0 / (1.0 + np.exp(-margin))
        gradient, weight = labels - chance, np.maximum(chance * (1 - chance), 1e-9)
        node = np.zeros(len(labels), dtype=np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            _split(model, tree, binned, edges, node - first, count, first, gradient, weight, penalty, least_weight)
            node = 2 * node + 1 + (rows[np.arange(len(rows)), model.feature[tree][node]] > model.threshold[tree][node])
        size = nodes
        g = np.bincount(node, gradient, size)
        h = np.bincount(node, weight, size)
        model.value[tree] = rate * g / (h + penalty)
        margin += model.value[tree][node]
    return model


def _split(model, tree, binned, edges, local, count, first, gradient, weight, penalty, least_weight) -> None:
    """Best split of each node of a level; a node without a good one sends all rows to its left child."""
    best = np.full(count, 1e-6)
    for f in range(binned.shape[1]):
        if not len(edges[f]):
            continue
        size = len(edges[f]) + 1
        cell = local * size + binned[:, f]
        g = np.bincount(cell, gradient, count * size).reshape(count, size)
        h = np.bincount(cell, weight, count * size).reshape(count, size)
        left_g, left_h = g.cumsum(axis=1)[:, :-1], h.cumsum(axis=1)[:, :-1]
        all_g, all_h = g.sum(axis=1, keepdims=True), h.sum(axis=1, keepdims=True)
        right_g, right_h = all_g - left_g, all_h - left_h
        gain = left_g**2 / (left_h + penalty) + right_g**2 / (right_h + penalty) - all_g**2 / (all_h + penalty)
        gain[(left_h < least_weight) | (right_h < least_weight)] = 0
        at = gain.argmax(axis=1)
        top = gain[np.arange(count), at]
        better = top > best
        best[better] = top[better]
        places = first + np.flatnonzero(better)
        model.feature[tree, places] = f
        model.threshold[tree, places] = edges[f][at[better]]
