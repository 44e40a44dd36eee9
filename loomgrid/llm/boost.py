"""Histogram gradient-boosted trees for two classes, trained in numpy on a bounded sample and flattened for scoring.

Trees are complete and of one depth. A model is four arrays, so scoring a batch walks every tree for all rows at once.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Trees(NamedTuple):
    """feature and threshold: (trees, inner nodes); leaf: (trees, leaves); base: the log-odds that all rows start from."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of label 1 for each row of x."""
        rows, total = np.arange(len(x)), np.full(len(x), self.base)
        inner = self.feature.shape[1]
        depth = int(np.log2(inner + 1))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - inner]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def bin_edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """For each feature, the inner edges of at most `bins` bins of about equal rows; a value lies right of an edge if greater."""
    steps = np.linspace(0, 1, bins + 1)[1:-1]
    return [np.unique(np.quantile(column, steps, method="lower")) for column in x.T]


def fit_trees(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, ridge: float = 1.0, least: float = 5.0) -> Trees:
    """Boosted trees for labels y (0 or 1) by second-order gain over feature histograms, level by level.

    A row counts `weight` times (once, if not given) in the base, the gradients and the hessians. `least` is the least hessian sum of a child. Without rows, or with one label only, the model is the smoothed rate of label 1.
    """
    x = np.asarray(x, np.float64)
    y = np.asarray(y, np.float64)
    weight = np.ones(len(y)) if weight is None else np.asarray(weight, np.float64)
    share = ((weight * y).sum() + 0.5) / (weight.sum() + 1.0)
    base = float(np.log(share / (1 - share)))
    inner, leaves = 2**depth - 1, 2**depth
    if len(y) == 0 or y.min() == y.max():
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), base)
    edges = bin_edges(x, bins)
    width = max(len(e) for e in edges) + 1
    n, k = x.shape
    codes = np.stack([np.searchsorted(e, column, side="left") for e, column in zip(edges, x.T, strict=True)], axis=1)
    offset = codes + np.arange(k) * width  # cell of each value in a node's flat histogram
    values = np.full((k, width), np.inf)
    for f, e in enumerate(edges):
        values[f, : len(e)] = e
    margin = np.full(n, base)
    all_feature, all_threshold, all_leaf = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = weight * (p - y), weight * np.maximum(p * (1 - p), 1e-6)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            cell = ((node - first)[:, None] * (k * width) + offset).ravel()
            shape = (count, k, width)
            g = np.bincount(cell, np.repeat(grad, k), count * k * width).reshape(shape).cumsum(axis=2)
            h = np.bincount(cell, np.repeat(hess, k), count * k * width).reshape(shape).cumsum(axis=2)
            g_all, h_all = g[:, :1, -1:], h[:, :1, -1:]
            gain = g**2 / (h + ridge) + (g_all - g) ** 2 / (h_all - h + ridge) - g_all**2 / (h_all + ridge)
            gain = np.where((h >= least) & (h_all - h >= least) & np.isfinite(values)[None], gain, 0.0).reshape(count, -1)
            best = gain.argmax(axis=1)
            split = gain[np.arange(count), best] > 1e-9
            feature[first : first + count] = best // width
            threshold[first : first + count] = np.where(split, values.ravel()[best], np.inf)
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        at = node - inner
        leaf = -rate * np.bincount(at, grad, leaves) / (np.bincount(at, hess, leaves) + ridge)
        margin += leaf[at]
        all_feature.append(feature)
        all_threshold.append(threshold)
        all_leaf.append(leaf)
    return Trees(np.array(all_feature), np.array(all_threshold), np.array(all_leaf), base)


class Isotonic(NamedTuple):
    """A rising step function through (at, value), interpolated between the steps."""

    at: np.ndarray
    value: np.ndarray

    def __call__(self, margin: np.ndarray) -> np.ndarray:
        return np.interp(margin, self.at, self.value)


def fit_isotonic(margin: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Isotonic:
    """Pool adjacent violators over (margin, label), a row counting `weight` times (once, if not given), with half a row of either label at the ends so that no score is exactly 0 or 1."""
    order = np.argsort(margin, kind="stable")
    at, label = np.asarray(margin, float)[order], np.asarray(y, float)[order]
    counted = np.ones(len(at)) if weight is None else np.asarray(weight, float)[order]
    places, first = np.unique(at, return_index=True)
    size = np.add.reduceat(counted, first) if len(at) else np.zeros(0)
    total = np.add.reduceat(counted * label, first) if len(at) else np.zeros(0)
    blocks: list[list[float]] = []  # total, weight, first place, last place
    for t, w, x in zip(total, size, places, strict=True):
        blocks.append([t, w, x, x])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            t2, w2, _, x2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + t2, blocks[-1][1] + w2, blocks[-1][2], x2]
    if not blocks:
        return Isotonic(np.zeros(1), np.full(1, 0.5))
    xs, vs = [], []
    for t, w, low, high in blocks:
        value = (t + 0.5) / (w + 1.0)
        xs += [low, high] if high > low else [low]
        vs += [value] * (2 if high > low else 1)
    return Isotonic(np.array(xs), np.maximum.accumulate(vs))
