"""A generalised additive model with pairwise interactions, for two classes.

Features are cut into bins at quantiles. Rounds go over the features in turn: a tree of three
leaves at most, fitted to the residuals of the logistic loss, adds a little to the feature's table of one value
a bin. Pairs whose residuals still differ between the cells of a coarse grid then get tables of
their own, by trees that cut once along one feature and once along the other on each side. A score is the
sum of one table entry for each feature and pair.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np

BINS, PAIR_BINS, GRID, RIDGE = 48, 16, 8, 1.0


@dataclass
class Model:
    intercept: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_cuts: list[np.ndarray] = field(default_factory=list)  # by feature
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1 of each row."""
        total = np.full(len(x), self.intercept)
        for column, cuts, values in zip(x.T, self.cuts, self.tables, strict=True):
            total += values[np.searchsorted(cuts, column, "right")]
        for (i, j), values in zip(self.pairs, self.pair_tables, strict=True):
            total += values[np.searchsorted(self.pair_cuts[i], x[:, i], "right"), np.searchsorted(self.pair_cuts[j], x[:, j], "right")]
        return 1 / (1 + np.exp(-total))


def _cuts(column: np.ndarray, bins: int) -> np.ndarray:
    """Places between different values, about equally many rows apart."""
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1], method="higher"))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + RIDGE)


def _split(g: np.ndarray, h: np.ndarray, least: float) -> tuple[float, int]:
    """The gain of the best cut of a run of bins, and the first bin after it; 0 if none is good."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(left_g):
        return 0.0, 0
    right_g, right_h = g.sum() - left_g, h.sum() - left_h
    gains = _gain(left_g, left_h) + _gain(right_g, right_h) - _gain(g.sum(), h.sum())
    gains[(left_h < least) | (right_h < least)] = 0
    best = int(np.argmax(gains))
    return float(gains[best]), best + 1 if gains[best] > 0 else 0


def _tree(g: np.ndarray, h: np.ndarray, least: float, leaves: int = 3) -> np.ndarray:
    """Values by bin of a tree that cuts the best leaf until there are enough."""
    edges = [0, len(g)]
    while len(edges) <= leaves:
        found = [(*_split(g[a:b], h[a:b], least), a) for a, b in zip(edges, edges[1:])]
        gain, at, a = max(found)
        if gain <= 0:
            break
        edges = sorted([*edges, a + at])
    values = [g[a:b].sum() / (h[a:b].sum() + RIDGE) for a, b in zip(edges, edges[1:])]
    return np.repeat(values, np.diff(edges))


def _pair_tree(g: np.ndarray, h: np.ndarray, least: float) -> np.ndarray:
    """Values by cell: one cut along an axis, then one along the other on each side."""
    best, out = -1.0, np.zeros_like(g)
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        gain, at = _split(a.sum(axis=1), b.sum(axis=1), least)
        if not at:
            continue
        values = np.concatenate([np.tile(_tree(a[s].sum(axis=0), b[s].sum(axis=0), least, 2), (len(a[s]), 1)) for s in (slice(0, at), slice(at, None))])
        gain = float((values * a).sum() * 2 - (values * values * b).sum())
        if gain > best:
            best, out = gain, values.T if turned else values
    return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 200, pair_rounds: int = 60, pairs: int = 8, rate: float = 0.1, least: float = 2.0) -> Model:
    """The model of ``x`` (rows by features) and ``y`` (0 or 1). Without rows, scores are one half."""
    y = np.asarray(y, float)
    model = Model()
    rate_of_one = (y.sum() + 1) / (len(y) + 2)
    model.intercept = float(np.log(rate_of_one / (1 - rate_of_one)))
    if not len(y):
        model.cuts, model.tables = [np.zeros(0)] * x.shape[1], [np.zeros(1)] * x.shape[1]
        return model
    model.cuts = [_cuts(c, BINS) for c in x.T]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    bins = [np.searchsorted(c, v, "right") for c, v in zip(model.cuts, x.T, strict=True)]
    total = np.full(len(y), model.intercept)

    def sums(cell: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return np.bincount(cell, y - p, n), np.bincount(cell, p * (1 - p), n)

    for _ in range(rounds):
        for cell, values in zip(bins, model.tables, strict=True):
            step = rate * _tree(*sums(cell, len(values)), least)
            values += step
            total += step[cell]

    coarse = [np.searchsorted(_cuts(v, GRID), v, "right") for v in x.T]
    model.pair_cuts = [_cuts(v, PAIR_BINS) for v in x.T]
    fine = [np.searchsorted(c, v, "right") for c, v in zip(model.pair_cuts, x.T, strict=True)]

    def left(i: int, j: int) -> float:
        g, h = sums(coarse[i] * (GRID + 1) + coarse[j], (GRID + 1) ** 2)
        g, h = g.reshape(GRID + 1, -1), h.reshape(GRID + 1, -1)
        return float(_gain(g, h).sum() - max(_gain(g.sum(axis=a), h.sum(axis=a)).sum() for a in (0, 1)))

    ranked = sorted(combinations(range(x.shape[1]), 2), key=lambda ij: -left(*ij))
    model.pairs = ranked[:pairs]
    shapes = [(len(model.pair_cuts[i]) + 1, len(model.pair_cuts[j]) + 1) for i, j in model.pairs]
    model.pair_tables = [np.zeros(s) for s in shapes]
    cells = [fine[i] * s[1] + fine[j] for (i, j), s in zip(model.pairs, shapes, strict=True)]
    for _ in range(pair_rounds):
        for cell, values in zip(cells, model.pair_tables, strict=True):
            g, h = sums(cell, values.size)
            step = rate * _pair_tree(g.reshape(values.shape), h.reshape(values.shape), least)
            values += step
            total += step.reshape(-1)[cell]
    return model
