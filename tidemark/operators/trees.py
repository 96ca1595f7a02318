"""Boosted regression trees on binned features: what one month end of a walk-forward needs, in numpy."""

from __future__ import annotations

import numpy as np


def binned(train: np.ndarray, test: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Each feature by quantiles of the training rows."""
    edges = [np.unique(np.quantile(column, np.arange(1, bins) / bins)) for column in train.T]
    return tuple(np.column_stack([np.searchsorted(e, column, "right") for e, column in zip(edges, rows.T)]) for rows in (train, test))


def boosted(train: np.ndarray, y: np.ndarray, test: np.ndarray, trees: int, depth: int, least: int, rate: float, bins: int) -> np.ndarray:
    """Predictions for ``test``: least squares, trees of ``depth`` levels, a split's sides of ``least`` rows at least."""
    train, test = binned(train, test, bins)
    fitted, out = np.full(len(train), y.mean()), np.full(len(test), y.mean())
    for _ in range(trees):
        residual = y - fitted
        node, place = np.zeros(len(train), np.int64), np.zeros(len(test), np.int64)
        for level in range(depth):
            nodes, best = 1 << level, None
            for f in range(train.shape[1]):
                at = node * bins + train[:, f]
                n = np.bincount(at, minlength=nodes * bins).reshape(nodes, bins).cumsum(1)
                s = np.bincount(at, residual, nodes * bins).reshape(nodes, bins).cumsum(1)
                rest, total = n[:, -1:] - n, s[:, -1:]
                gain = s**2 / np.maximum(n, 1) + (total - s) ** 2 / np.maximum(rest, 1) - total**2 / np.maximum(n[:, -1:], 1)
                gain = np.where((n >= least) & (rest >= least), gain, 0.0)
                cut = gain.argmax(1)
                found = np.column_stack([gain[np.arange(nodes), cut], np.full(nodes, f), cut])
                best = found if best is None else np.where(found[:, :1] > best[:, :1], found, best)
            feature, cut = best[:, 1].astype(int), np.where(best[:, 0] > 0, best[:, 2], bins)  # no gain: all go left
            node = 2 * node + (train[np.arange(len(train)), feature[node]] > cut[node])
            place = 2 * place + (test[np.arange(len(test)), feature[place]] > cut[place])
        n = np.bincount(node, minlength=1 << depth)
        leaf = rate * np.bincount(node, residual, 1 << depth) / np.maximum(n, 1)
        fitted, out = fitted + leaf[node], out + leaf[place]
    return out
