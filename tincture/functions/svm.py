"""A support-vector classifier on a precomputed kernel: sequential minimal optimisation, one against one.

Equal rows of equal class are one variable whose bound is the cost times how many they are, so that a fit is as large as there are
different rows. Kernels may be matrices or rows that are made when asked for (``KernelRows``).
"""

from __future__ import annotations

import warnings
from collections import OrderedDict
from collections.abc import Callable

import numpy as np

#: Up to so many rows a kernel is kept whole; beyond it rows are made one by one and so many bytes of them kept.
DENSE_ROWS, CACHE_BYTES = 4_000, 256 << 20


class KernelRows:
    """Rows of a symmetric kernel over ``n`` rows, made by ``make(places)`` and kept while they fit."""

    def __init__(self, n: int, make: Callable[[np.ndarray], np.ndarray], diagonal: np.ndarray, most_bytes: int = CACHE_BYTES):
        self.n, self.make, self._diagonal = n, make, diagonal
        self.most = max(2, most_bytes // (8 * max(1, n)))
        self.kept: OrderedDict[int, np.ndarray] = OrderedDict()
        self.made = 0

    def diagonal(self) -> np.ndarray:
        return self._diagonal

    def row(self, i: int) -> np.ndarray:
        if i in self.kept:
            self.kept.move_to_end(i)
        else:
            self.kept[i] = self.make(np.array([i]))[0]
            self.made += 1
            if len(self.kept) > self.most:
                self.kept.popitem(last=False)
        return self.kept[i]


class _Matrix:
    def __init__(self, kernel: np.ndarray):
        self.kernel, self.row = kernel, kernel.__getitem__

    def diagonal(self) -> np.ndarray:
        return np.diag(self.kernel)


class _Part:
    """The kernel of some of the rows."""

    def __init__(self, kernel, places: np.ndarray):
        self.kernel, self.places = kernel, places

    def diagonal(self) -> np.ndarray:
        return self.kernel.diagonal()[self.places]

    def row(self, i: int) -> np.ndarray:
        return self.kernel.row(int(self.places[i]))[self.places]


class BinarySvm:
    """Maximises the dual with the working set of the two variables that violate optimality most, until none violates it by more than
    ``tolerance``. ``most`` updates (default: ten million, or a hundred for each row if that is more) end it with a warning."""

    def __init__(self, cost: float, tolerance: float = 1e-3, most: int | None = None):
        self.cost, self.tolerance, self.most, self.converged = cost, tolerance, most, False

    def fit(self, kernel, signs: np.ndarray, weights: np.ndarray | None = None) -> BinarySvm:
        """``weights``: how many rows each row stands for."""
        kernel = _Matrix(kernel) if isinstance(kernel, np.ndarray) else kernel
        n, y, diagonal = len(signs), signs.astype(float), kernel.diagonal()
        bound = np.full(n, float(self.cost)) if weights is None else self.cost * weights.astype(float)
        alpha, gradient = np.zeros(n), -np.ones(n)
        positive = y > 0
        upper = lower = 0.0
        for _ in range(self.most or max(10_000_000, 100 * n)):
            below, above = alpha < bound, alpha > 0
            up = np.where(positive, below, above)
            low = np.where(positive, above, below)
            pull = -y * gradient
            i = int(np.where(up, pull, -np.inf).argmax())
            upper, lower = pull[i], np.where(low, pull, np.inf).min()
            if upper - lower < self.tolerance:
                self.converged = True
                break
            gap, row = upper - pull, kernel.row(i)
            curve = np.maximum(diagonal[i] + diagonal - 2 * row, 1e-12)
            j = int(np.where(low & (gap > 0), gap * gap / curve, -np.inf).argmax())
            step = (upper - pull[j]) / curve[j]
            room_i = bound[i] - alpha[i] if y[i] > 0 else alpha[i]
            room_j = alpha[j] if y[j] > 0 else bound[j] - alpha[j]
            step = min(step, room_i, room_j)
            alpha[i] = min(max(alpha[i] + y[i] * step, 0.0), bound[i])
            alpha[j] = min(max(alpha[j] - y[j] * step, 0.0), bound[j])
            gradient += y * step * (row - kernel.row(j))
        if not self.converged:
            warnings.warn(f"a classifier stopped {upper - lower:.3g} away from its optimum", RuntimeWarning, stacklevel=2)
        free = (alpha > 1e-12) & (alpha < bound - 1e-12)
        self.bias = float((-y * gradient)[free].mean()) if free.any() else float((upper + lower) / 2)
        self.weights = alpha * y
        return self

    def decide(self, kernel: np.ndarray) -> np.ndarray:
        return kernel @ self.weights + self.bias


def _vote(classes: np.ndarray, pairs) -> np.ndarray:
    """The class with most votes for each row; ties go to the class that sorts first. ``pairs``: (a, b, whether a wins, by row)."""
    votes = None
    for a, b, first in pairs:
        votes = np.zeros((len(first), len(classes))) if votes is None else votes
        votes[first, a] += 1
        votes[~first, b] += 1
    return classes[votes.argmax(axis=1)]


def fit_predict(train: np.ndarray, labels: np.ndarray, test: np.ndarray, cost: float) -> np.ndarray:
    """Predictions for the rows of ``test`` (test by train kernel). Pairs of classes vote."""
    classes = np.unique(labels)
    if len(classes) < 2:
        return np.repeat(classes[:1], len(test))

    def pairs():
        for a in range(len(classes)):
            for b in range(a + 1, len(classes)):
                own = np.flatnonzero((labels == classes[a]) | (labels == classes[b]))
                model = BinarySvm(cost).fit(train[np.ix_(own, own)], np.where(labels[own] == classes[a], 1, -1))
                yield a, b, model.decide(test[:, own]) > 0

    return _vote(classes, pairs())


def fit_predict_weighted(kernel, places: np.ndarray, labels: np.ndarray, weights: np.ndarray, test: np.ndarray, cost: float) -> np.ndarray:
    """As ``fit_predict``, for training rows given as (place in the kernel, label, how many) and test rows as places in the kernel."""
    kernel = _Matrix(kernel) if isinstance(kernel, np.ndarray) else kernel
    classes = np.unique(labels)
    if len(classes) < 2:
        return np.repeat(classes[:1], len(test))

    def pairs():
        for a in range(len(classes)):
            for b in range(a + 1, len(classes)):
                own = np.flatnonzero((labels == classes[a]) | (labels == classes[b]))
                at = places[own]
                model = BinarySvm(cost).fit(_Part(kernel, at), np.where(labels[own] == classes[a], 1, -1), weights[own])
                scores = np.full(len(test), model.bias)
                for place, weight in zip(at[model.weights != 0], model.weights[model.weights != 0], strict=True):
                    scores += weight * kernel.row(int(place))[test]
                yield a, b, scores > 0

    return _vote(classes, pairs())
