"""Logistic regression on a bounded number of sparse rows, fitted in numpy."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def fit_sparse(
    rows: np.ndarray, columns: np.ndarray, values: np.ndarray, labels: np.ndarray, width: int, *, penalty: float = 1.0, steps: int = 300
) -> tuple[np.ndarray, float]:
    """Weights and bias by accelerated gradient descent on the mean logistic loss plus ``penalty / n`` times |w|^2 / 2.

    Entry k of the matrix is ``values[k]`` at ``(rows[k], columns[k])``. Without rows the weights are zero.
    """
    count = len(labels)
    weights, bias = np.zeros(width), 0.0
    if not count:
        return weights, bias
    share = (labels.sum() + 0.5) / (count + 1)
    bias = float(np.log(share / (1 - share)))
    norms = np.bincount(rows, values**2, count)
    rate = 4.0 / (1.0 + (np.sort(norms)[-max(1, count // 20)] if len(values) else 0.0) + 4 * penalty / count)
    moved, moved_bias, momentum = weights.copy(), bias, 1.0
    for _ in range(steps):
        error = sigmoid(np.bincount(rows, moved[columns] * values, count) + moved_bias) - labels
        slope = np.bincount(columns, error[rows] * values, width) / count + penalty / count * moved
        new, new_bias = moved - rate * slope, moved_bias - rate * error.mean()
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        moved = new + (momentum - 1) / following * (new - weights)
        moved_bias = new_bias + (momentum - 1) / following * (new_bias - bias)
        weights, bias, momentum = new, float(new_bias), following
    return weights, bias
