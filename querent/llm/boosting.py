"""Small gradient-boosted trees for a few thousand rows, with calibrated scores."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Tree:
    """A full binary tree: node k has children 2k + 1 and 2k + 2; leaves have feature -1."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        for _ in range(int(np.log2(len(self.feature) + 1)) - 1):
            own = self.feature[at]
            inner = own >= 0
            right = x[np.arange(len(x)), np.maximum(own, 0)] > self.cut[at]
            at = np.where(inner, 2 * at + 1 + right, at)
        return self.value[at]


def grown(binned: list[np.ndarray], cuts: list[np.ndarray], gradient: np.ndarray, curvature: np.ndarray, depth: int, ridge: float, least: float) -> Tree:
    """A tree on features whose values are given as the number of the bin between ``cuts``."""
    size = 2 ** (depth + 1) - 1
    tree = Tree(np.full(size, -1), np.zeros(size), np.zeros(size))
    at = np.zeros(len(gradient), np.int64)
    for node in range(size):
        rows = np.flatnonzero(at == node)
        g, h = gradient[rows].sum(), curvature[rows].sum()
        tree.value[node] = g / (h + ridge)
        if node >= 2**depth - 1 or h < 2 * least:
            continue
        best = (1e-6, -1, 0.0)
        for f, own in enumerate(cuts):
            if not len(own):
                continue
            bins = binned[f][rows]
            gl = np.bincount(bins, gradient[rows], len(own) + 1).cumsum()[:-1]
            hl = np.bincount(bins, curvature[rows], len(own) + 1).cumsum()[:-1]
            gain = gl**2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g**2 / (h + ridge)
            gain[(hl < least) | (h - hl < least)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), f, float(own[k]))
        if best[1] >= 0:
            tree.feature[node], tree.cut[node] = best[1:]
            at[rows] = 2 * node + 1 + (binned[best[1]][rows] > np.searchsorted(cuts[best[1]], best[2]))
    return tree


@dataclass
class Boosted:
    """Trees on the logistic loss; ``slope`` and ``shift`` calibrate their sum to a chance."""

    trees: list[Tree] = field(default_factory=list)
    start: float = 0.0
    rate: float = 0.2
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.start + self.rate * sum((t(x) for t in self.trees), np.zeros(len(x)))

    def chance(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.shift, -30, 30)))


def boosted(x: np.ndarray, y: np.ndarray, held: np.ndarray, rounds: int = 60, depth: int = 3, ridge: float = 1.0, least: float = 2.0, bins: int = 32) -> Boosted:
    """Trees fitted on the rows that aren't ``held``, calibrated on those that are."""
    fit, labels = x[~held], y[~held].astype(float)
    share = np.clip(labels.mean() if len(labels) else 0.5, 1e-3, 1 - 1e-3)
    model = Boosted(start=float(np.log(share / (1 - share))))
    cuts = [np.unique(np.quantile(fit[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if len(fit) else np.empty(0) for f in range(x.shape[1])]
    binned = [np.searchsorted(own, fit[:, f], side="left") for f, own in enumerate(cuts)]
    margin = np.full(len(fit), model.start)
    for _ in range(rounds if 0 < labels.sum() < len(labels) else 0):
        p = 1 / (1 + np.exp(-margin))
        tree = grown(binned, cuts, labels - p, p * (1 - p), depth, ridge, least)
        model.trees.append(tree)
        margin += model.rate * tree(fit)
    own, labels = model.margin(x[held]), y[held].astype(float)
    if 0 < labels.sum() < len(labels):  # two-parameter logistic calibration by Newton's method, with a weak prior at 1 and 0
        w, prior = np.array([1.0, 0.0]), np.array([1.0, 0.0])
        z = np.stack([own, np.ones_like(own)], axis=1)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + np.eye(2), z.T @ (labels - p) - (w - prior))
            w += step
            if np.abs(step).max() < 1e-9:
                break
        model.slope, model.shift = float(max(w[0], 0.05)), float(w[1])
    return model


def threshold(chance: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest chance from which on the share of true rows is ``precision`` at least; above 1 if there is none."""
    order = np.argsort(-chance, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    last = np.r_[chance[order][1:] != chance[order][:-1], True] if len(y) else np.empty(0, bool)
    good = np.flatnonzero((right >= precision) & last)
    return float(chance[order][good[-1]]) if len(good) else 1.1
