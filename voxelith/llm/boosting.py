"""Small gradient-boosted trees for spans: fitted on a bounded sample on the driver, evaluated in tasks."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Boosted:
    """Sum of regression trees on the log odds, with Platt's calibration and a threshold on the calibrated probability."""

    trees: list = field(default_factory=list)
    start: float = 0.0
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 1.1

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for tree in self.trees:
            out += _evaluate(tree, x)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.margin(x) + self.shift)))


def _evaluate(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    column, cut, low, high = tree
    left = x[:, column] <= cut
    out = np.empty(len(x))
    out[left], out[~left] = _evaluate(low, x[left]), _evaluate(high, x[~left])
    return out


def _grow(x, g, h, depth, rate, ridge=1.0, least=5):
    """A tree by second-order gains over at most 32 cuts for each column."""
    value = -rate * g.sum() / (h.sum() + ridge)
    if depth == 0 or len(g) < 2 * least:
        return value
    best, base = (1e-6, None, None), g.sum() ** 2 / (h.sum() + ridge)
    for c in range(x.shape[1]):
        cuts = np.unique(np.quantile(x[:, c], np.linspace(0, 1, 33)[:-1]))
        if len(cuts) == 1 and x[:, c].max() == cuts[0]:
            continue
        slot = np.searchsorted(cuts, x[:, c])
        n, gs, hs = (np.cumsum(np.bincount(slot, w, len(cuts) + 1))[:-1] for w in (np.ones(len(g)), g, h))
        gain = gs**2 / (hs + ridge) + (g.sum() - gs) ** 2 / (h.sum() - hs + ridge) - base
        gain[(n < least) | (len(g) - n < least)] = 0
        k = int(np.argmax(gain))
        if gain[k] > best[0]:
            best = (gain[k], c, cuts[k])
    if best[1] is None:
        return value
    left = x[:, best[1]] <= best[2]
    return best[1], best[2], _grow(x[left], g[left], h[left], depth - 1, rate, ridge, least), _grow(x[~left], g[~left], h[~left], depth - 1, rate, ridge, least)


def fit(x: np.ndarray, y: np.ndarray, held: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3, precision: float = 0.98) -> Boosted:
    """Trees on the rows outside `held`; calibration and the lowest threshold of at least `precision` on the others. Without rows of both
    classes on both sides, a model that selects nothing."""
    if min((y[held] == c).sum() for c in (0, 1)) < 5 or min((y[~held] == c).sum() for c in (0, 1)) < 10:
        return Boosted()
    xt, yt, xv, yv = x[~held], y[~held].astype(float), x[held], y[held].astype(float)
    model = Boosted(start=float(np.log(yt.mean() / (1 - yt.mean()))))
    f = np.full(len(yt), model.start)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-f))
        tree = _grow(xt, p - yt, p * (1 - p), depth, rate)
        model.trees.append(tree)
        f += _evaluate(tree, xt)
    m = model.margin(xv)
    a, b = 1.0, 0.0
    for _ in range(30):  # Newton steps of a logistic fit, with a ridge
        p = 1 / (1 + np.exp(-(a * m + b)))
        w = p * (1 - p) + 1e-9
        grad = np.array([((p - yv) * m).sum() + 0.1 * (a - 1), (p - yv).sum() + 0.1 * b])
        hess = np.array([[(w * m * m).sum() + 0.1, (w * m).sum()], [(w * m).sum(), w.sum() + 0.1]])
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
    model.slope, model.shift = float(a), float(b)
    p = model.probability(xv)
    for cut in np.unique(p):
        if yv[p >= cut].mean() >= precision:
            model.threshold = max(0.5, float(cut))
            break
    return model
