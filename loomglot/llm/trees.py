"""Small regression trees on numpy, fitted on the driver over bounded samples and compiled to Spark expressions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Leaf:
    value: float


@dataclass(frozen=True)
class Split:
    feature: int
    threshold: float  # left takes x <= threshold
    left: "Split | Leaf"
    right: "Split | Leaf"


def thresholds(x: np.ndarray, most: int) -> np.ndarray:
    """Midpoints between neighbouring distinct values, thinned to ``most`` by quantile."""
    values = np.unique(x)
    if len(values) > most + 1:
        values = np.unique(np.quantile(x, np.linspace(0, 1, most + 1), method="nearest"))
    return (values[:-1] + values[1:]) / 2


def fit_tree(x: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, depth: int, ridge: float = 1.0, least: int = 5, bins: int = 32) -> Split | Leaf:
    """Greedy second-order tree: splits by gain in ``G^2 / (H + ridge)``; a leaf holds ``-G / (H + ridge)``."""
    g, h = gradient.sum(), hessian.sum()
    leaf = Leaf(float(-g / (h + ridge)))
    if depth == 0 or len(x) < 2 * least:
        return leaf
    best, at = 1e-9, None
    for f in range(x.shape[1]):
        for t in thresholds(x[:, f], bins):
            left = x[:, f] <= t
            n = int(left.sum())
            if n < least or len(x) - n < least:
                continue
            gl, hl = gradient[left].sum(), hessian[left].sum()
            gain = gl * gl / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g * g / (h + ridge)
            if gain > best:
                best, at = gain, (f, float(t))
    if at is None:
        return leaf
    left = x[:, at[0]] <= at[1]
    below = [fit_tree(x[s], gradient[s], hessian[s], depth - 1, ridge, least, bins) for s in (left, ~left)]
    return Split(*at, *below)


def predict_tree(tree: Split | Leaf, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, Leaf):
        return np.full(len(x), tree.value)
    return np.where(x[:, tree.feature] <= tree.threshold, predict_tree(tree.left, x), predict_tree(tree.right, x))


def tree_column(tree: Split | Leaf, features: list[Column]) -> Column:
    if isinstance(tree, Leaf):
        return F.lit(tree.value)
    return F.when(features[tree.feature] <= F.lit(tree.threshold), tree_column(tree.left, features)).otherwise(tree_column(tree.right, features))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def boost(x: np.ndarray, y: np.ndarray, rounds: int, depth: int, rate: float, least: int = 5) -> tuple[float, list[Split | Leaf]]:
    """Logistic gradient boosting: the base log-odds and the trees, their leaves already scaled by ``rate``."""
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    score, trees = np.full(len(y), base), []
    for _ in range(rounds):
        p = sigmoid(score)
        tree = scaled(fit_tree(x, p - y, p * (1 - p), depth, least=least), rate)
        trees.append(tree)
        score = score + predict_tree(tree, x)
    return base, trees


def scaled(tree: Split | Leaf, rate: float) -> Split | Leaf:
    if isinstance(tree, Leaf):
        return Leaf(tree.value * rate)
    return Split(tree.feature, tree.threshold, scaled(tree.left, rate), scaled(tree.right, rate))


def paths(tree: Split | Leaf, so_far: tuple = ()) -> list[tuple[tuple[int, float, bool], ...]]:
    """Every node below the root as a conjunction of ``(feature, threshold, at_most)``."""
    out = [so_far] if so_far else []
    if isinstance(tree, Split):
        out += paths(tree.left, (*so_far, (tree.feature, tree.threshold, True)))
        out += paths(tree.right, (*so_far, (tree.feature, tree.threshold, False)))
    return out
