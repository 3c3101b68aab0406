"""Weak labels: reliabilities of labellers by expectation-maximisation, and a hashed
linear scorer trained on the posteriors."""

from __future__ import annotations

import numpy as np


def reliabilities(patterns: list[tuple[list[int], int]], rounds: int = 100) -> tuple[np.ndarray, list[float]]:
    """Two-class expectation-maximisation over (votes, documents).  Returns the
    probability of each vote given class (labeller, class, vote + 1) and the
    posterior of good for each pattern."""
    v = np.array([p for p, _ in patterns]) + 1
    n = np.array([c for _, c in patterns], float)
    k = v.shape[1]
    # a defect that one labeller sees begins as heavier than what others don't see
    post = 1 / (1 + np.exp(3.0 * (v == 0).sum(1) - (v == 2).sum(1)))
    table = np.zeros((k, 2, 3))
    for _ in range(rounds):
        prior = np.clip((n * post).sum() / n.sum(), 0.01, 0.99)
        for c, weight in enumerate((n * (1 - post), n * post)):
            for j in range(k):
                table[j, c] = np.bincount(v[:, j], weight, 3) + 1.0
                table[j, c, 1] = 0  # an abstention says nothing
                table[j, c] /= table[j, c].sum()
        table[:, :, 1] = 1.0
        logs = np.log(table)
        good = np.log(prior) + sum(logs[j, 1, v[:, j]] for j in range(k))
        bad = np.log(1 - prior) + sum(logs[j, 0, v[:, j]] for j in range(k))
        post = 1 / (1 + np.exp(np.clip(bad - good, -50, 50)))
    return table, post.tolist()


def train(rows: list, posterior: dict[tuple, float], dims: int, steps: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression towards the posteriors; each class weighs the same."""
    x = np.zeros((len(rows), dims), np.float32)
    for i, r in enumerate(rows):
        x[i, r["at"]] = r["value"]
    y = np.array([posterior[tuple(r["votes"])] for r in rows], np.float32)
    weight = np.where(y >= 0.5, 0.5 / max(1, (y >= 0.5).sum()), 0.5 / max(1, (y < 0.5).sum())).astype(np.float32)
    w, b = np.zeros(dims, np.float32), 0.0
    m, s = np.zeros(dims + 1), np.zeros(dims + 1)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-(x @ w + b)))
        e = (p - y) * weight
        g = np.append(x.T @ e + 1e-5 * w, e.sum())
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-9)
        w, b = (w - step[:-1]).astype(np.float32), b - float(step[-1])
    return w, b
