"""A generative model of overlapping labellers, and a linear model on its posterior labels."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

ROUNDS = 30
PASSES = 5
VOTES = (-1, 0, 1)


class LabelModel(NamedTuple):
    """Class prior, P(vote | class) as (labellers, 3 votes, 2 classes), and the weight left to each labeller by its correlations."""

    prior: float
    tables: np.ndarray
    weights: np.ndarray
    correlations: np.ndarray


def posterior(votes: np.ndarray, prior: float, tables: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """P(class 1) of each row of votes (-1, 0 abstains, 1)."""
    logs = np.log(tables)
    odds = np.full(len(votes), np.log(prior / (1 - prior)))
    for j in range(votes.shape[1]):
        odds += weights[j] * (logs[j, :, 1] - logs[j, :, 0])[votes[:, j] + 1]
    return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def _maximise(votes: np.ndarray, p: np.ndarray, counts: np.ndarray) -> np.ndarray:
    tables = np.empty((votes.shape[1], 3, 2))
    for k, v in enumerate(VOTES):
        hit = votes == v
        tables[:, k, 1] = hit.T @ (p * counts)
        tables[:, k, 0] = hit.T @ ((1 - p) * counts)
    tables += 1.0
    return tables / tables.sum(1, keepdims=True)


def fit_labels(votes: np.ndarray, prior: float, correlated: bool = True, start: np.ndarray | None = None,
               counts: np.ndarray | None = None) -> tuple[LabelModel, np.ndarray]:
    """Expectation-maximisation over the labellers' vote tables, started from ``start`` or the sign of the summed votes.

    A row of votes stands for ``counts`` documents, one if not given.

    With ``correlated``, what labellers share beyond the class (the correlation of their votes' residuals) shrinks their
    weights, so that several that say the same thing count about once; the estimation then starts again from the weighted
    votes, ``PASSES`` times in all.
    """
    m = votes.shape[1]
    counts = np.ones(len(votes)) if counts is None else np.asarray(counts, float)
    n = counts.sum()
    prior = float(np.clip(prior, 1e-3, 1 - 1e-3))
    weights, share = np.ones(m), np.eye(m)
    for outer in range(PASSES if correlated else 1):
        lean = np.sign(votes @ weights + 1e-9 * (prior - 0.5))
        p = np.clip(0.5 + 0.4 * lean, 0.02, 0.98) if start is None else start
        tables = _maximise(votes, p, counts)
        for _ in range(ROUNDS):
            p = posterior(votes, prior, tables, weights)
            tables = _maximise(votes, p, counts)
            prior = float(np.clip(p @ counts / n, 1e-3, 1 - 1e-3))
        if correlated:
            mean = np.einsum("jvc,v->jc", tables, np.array(VOTES))
            residual = votes - (p[:, None] * mean[:, 1] + (1 - p[:, None]) * mean[:, 0])
            centre = counts @ residual / n
            spread = np.sqrt(counts @ (residual - centre) ** 2 / n)
            spread[spread < 1e-9] = 1
            share = (residual * counts[:, None]).T @ residual / n / np.outer(spread, spread)
            np.fill_diagonal(share, 1)
            if outer < PASSES - 1:
                weights = 1 / np.where(share > 0.1, share, 0).sum(1)
    return LabelModel(prior, tables, weights, share), p


class Linear(NamedTuple):
    weights: np.ndarray
    bias: float


def sums(row: np.ndarray, column: np.ndarray, value: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(row, value * weights[column], n)


def fit_linear(row: np.ndarray, column: np.ndarray, value: np.ndarray, target: np.ndarray, width: int, steps: int = 300,
               penalty: float = 1e-4, rate: float = 0.1, share: np.ndarray | None = None) -> Linear:
    """Logistic regression on soft targets over sparse features (row, column, value); ``share`` is each row's part of the loss."""
    w, n = np.zeros(width + 1), len(target)
    m, v = np.zeros_like(w), np.zeros_like(w)
    share = np.full(n, 1 / max(n, 1)) if share is None else share
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(sums(row, column, value, w, n) + w[-1], -50, 50)))
        d = (p - target) * share
        g = np.append(np.bincount(column, value * d[row], width), d.sum())
        g[:-1] += penalty * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-9)
    return Linear(w[:-1], float(w[-1]))


def logistic(linear: Linear, row: np.ndarray, column: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    z = sums(row, column, value, linear.weights, n) + linear.bias
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))
