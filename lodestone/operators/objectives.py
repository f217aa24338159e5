"""Gradients of per-question objectives, over the flattened rows of whole questions.

Each function gets labels y, weights w and scores s of all rows and the place
`starts` of each question's first row, and returns gradients and Hessians.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

FLOOR = 1e-6
# Gain of an outcome tier, and the depth to which ranks count.
TIER_GAINS, TRUNCATION = (0.0, 1.0, 4.0), 4

Objective = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.where(x >= 0, 1 / (1 + np.exp(-np.abs(x))), np.exp(-np.abs(x)) / (1 + np.exp(-np.abs(x))))


def logistic(y, w, s, starts):
    p = sigmoid(s)
    return w * (p - y), w * np.maximum(p * (1 - p), FLOOR)


def squared(y, w, s, starts):
    return w * (s - y), w


def pinball(alpha: float) -> Objective:
    """Loss alpha (y - s) above, (1 - alpha) (s - y) below; leaves are refitted by quantiles."""

    def objective(y, w, s, starts):
        return w * np.where(y > s, -alpha, 1 - alpha), w

    objective.quantile = alpha
    return objective


def probabilities(s: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Softmax of the scores within each question."""
    sizes = np.diff(np.append(starts, len(s)))
    e = np.exp(s - np.repeat(np.maximum.reduceat(s, starts), sizes)) if len(s) else s
    return e / np.repeat(np.add.reduceat(e, starts), sizes) if len(s) else s


def softmax(y, w, s, starts):
    """Cross-entropy of each question's softmax against its target distribution y; a question weighs the sum of w."""
    if not len(s):
        return s, s
    p = probabilities(s, starts)
    group = np.repeat(np.add.reduceat(w, starts), np.diff(np.append(starts, len(s))))
    return group * (p - y), group * np.maximum(p * (1 - p), FLOOR)


def lambdas(tier: np.ndarray, s: np.ndarray, gains=TIER_GAINS, truncation: int = TRUNCATION) -> tuple[np.ndarray, np.ndarray]:
    """Lambda gradients of one question: pairs of unequal tiers of which one ranks within the truncation.

    A pair weighs the change of nDCG that its exchange makes, over 0.01 plus the
    distance of the scores; the sums are then normed by log2(1 + sum) / sum.
    """
    n = len(s)
    gain = np.asarray(gains)[tier.astype(int)]
    order = np.argsort(-s, kind="stable")
    rank = np.empty(n, int)
    rank[order] = np.arange(n)
    discount = 1 / np.log2(rank + 2)
    ideal = (np.sort(gain)[::-1][:truncation] / np.log2(np.arange(min(n, truncation)) + 2)).sum()
    g, h = np.zeros(n), np.zeros(n)
    if ideal <= 0 or n < 2:
        return g, h
    top = order[:truncation]  # each pair is met from its member with the better rank
    d = s[top][:, None] - s[None, :]
    sign = np.sign(tier[top][:, None] - tier[None, :])
    met = (sign != 0) & (rank[None, :] > rank[top][:, None])
    delta = np.abs(gain[top][:, None] - gain[None, :]) * np.abs(discount[top][:, None] - discount[None, :]) / ideal
    if s.max() != s.min():
        delta = delta / (0.01 + np.abs(d))
    p = sigmoid(-sign * d)
    push = np.where(met, p * delta, 0.0)
    curve = np.where(met, p * (1 - p) * delta, 0.0)
    np.add.at(g, top, (-sign * push).sum(axis=1))
    g += (sign * push).sum(axis=0)
    np.add.at(h, top, curve.sum(axis=1))
    h += curve.sum(axis=0)
    total = 2 * push.sum()
    norm = np.log2(1 + total) / total if total > 0 else 1.0
    return g * norm, h * norm


def lambdarank(y, w, s, starts):
    g, h = np.zeros(len(s)), np.zeros(len(s))
    for a, b in zip(starts, np.append(starts[1:], len(s))):
        g[a:b], h[a:b] = lambdas(y[a:b], s[a:b])
    return w * g, w * np.maximum(h, FLOOR)
