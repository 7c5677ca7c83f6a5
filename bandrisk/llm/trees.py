"""Gradient-boosted decision trees for a yes or no, on binned features, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32
DEPTH = 5
TREES = 60
RATE = 0.25
RIDGE = 1.0
MIN_WEIGHT = 2.0


@dataclass
class Forest:
    """Complete trees of one depth: a feature and a threshold per inner node, a value per leaf."""

    features: np.ndarray
    thresholds: np.ndarray
    values: np.ndarray
    start: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        inner = self.features.shape[1]
        for features, thresholds, values in zip(self.features, self.thresholds, self.values):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, features[node]] > thresholds[node])
            total += values[node - inner] if len(node) else 0
        return total


def _best_splits(binned: np.ndarray, slot: np.ndarray, slots: int, gradient: np.ndarray, weight: np.ndarray):
    """For every node of a level the feature and bin that gain most; bin BINS - 1 means no split."""
    count, width = binned.shape
    best_gain = np.full(slots, 1e-6)
    best_feature, best_bin = np.zeros(slots, np.int64), np.full(slots, BINS - 1)
    for feature in range(width):
        cell = slot * BINS + binned[:, feature]
        g = np.bincount(cell, gradient, slots * BINS).reshape(slots, BINS).cumsum(axis=1)
        h = np.bincount(cell, weight, slots * BINS).reshape(slots, BINS).cumsum(axis=1)
        g_all, h_all = g[:, -1:], h[:, -1:]
        g_left, h_left = g[:, :-1], h[:, :-1]
        g_right, h_right = g_all - g_left, h_all - h_left
        gain = g_left**2 / (h_left + RIDGE) + g_right**2 / (h_right + RIDGE) - g_all**2 / (h_all + RIDGE)
        gain = np.where((h_left >= MIN_WEIGHT) & (h_right >= MIN_WEIGHT), gain, 0)
        at = gain.argmax(axis=1)
        top = gain[np.arange(slots), at]
        better = top > best_gain
        best_gain[better], best_feature[better], best_bin[better] = top[better], feature, at[better]
    return best_feature, best_bin


def boost(x: np.ndarray, labels: np.ndarray) -> Forest:
    """A forest for 0 and 1 labels, by second-order boosting of the logistic loss."""
    count, width = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS)[1:-1])) for f in range(width)]
    binned = np.column_stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])
    rate = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(rate / (1 - rate)))
    score = np.full(count, start)
    inner, leaves = (1 << DEPTH) - 1, 1 << DEPTH
    features = np.zeros((TREES, inner), np.int64)
    thresholds = np.full((TREES, inner), np.inf)
    values = np.zeros((TREES, leaves))
    for tree in range(TREES):
        p = 1 / (1 + np.exp(-score))
        gradient, weight = labels - p, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(count, np.int64)
        for level in range(DEPTH):
            first, slots = (1 << level) - 1, 1 << level
            feature, bin_ = _best_splits(binned, node - first, slots, gradient, weight)
            for n in range(slots):
                if bin_[n] < len(edges[feature[n]]):
                    features[tree, first + n] = feature[n]
                    thresholds[tree, first + n] = edges[feature[n]][bin_[n]]
            node = 2 * node + 1 + (x[np.arange(count), features[tree, node]] > thresholds[tree, node])
        leaf = node - inner
        g, h = np.bincount(leaf, gradient, leaves), np.bincount(leaf, weight, leaves)
        values[tree] = RATE * g / (h + RIDGE)
        score += values[tree][leaf]
    return Forest(features, thresholds, values, start)
