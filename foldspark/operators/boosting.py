"""Gradient-boosted trees for two classes, on histograms, in numpy.

Logistic loss with second-order gains.  Features are cut into at most
``BINS`` bins at quantiles; a level of a tree is grown at once from one
histogram a feature.  A model is a list of trees as flat arrays.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass
class Tree:
    """Node k has the children 2k + 1 and 2k + 2; a leaf has feature -1."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while True:
            f = self.feature[at]
            inner = np.flatnonzero(f >= 0)
            if not len(inner):
                return self.value[at]
            own = at[inner]
            at[inner] = 2 * own + 1 + (x[inner, f[inner]] >= self.threshold[own])


@dataclass
class Trees:
    base: float
    trees: list[Tree]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.trees:
            out += tree.scores(x)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.margin(x)))

    def importances(self, n: int) -> np.ndarray:
        total = np.zeros(n)
        for tree in self.trees:
            inner = tree.feature >= 0
            np.add.at(total, tree.feature[inner], tree.gain[inner])
        return total / total.sum() if total.sum() > 0 else total


def auroc(truth: np.ndarray, score: np.ndarray, times: np.ndarray | None = None) -> float:
    """Pairs won, ties half; 0.5 for a single class.  ``times``: how often a row counts."""
    values, at = np.unique(score, return_inverse=True)
    times = np.ones(len(score)) if times is None else times
    pos, neg = (np.bincount(at, weights=(truth == t) * times, minlength=len(values)) for t in (1, 0))
    pairs = pos.sum() * neg.sum()
    return float((pos * (np.cumsum(neg) - neg / 2)).sum() / pairs) if pairs else 0.5


def average_precision(truth: np.ndarray, score: np.ndarray, times: np.ndarray | None = None) -> float:
    """The step-wise area; 0 without positives.  ``times``: how often a row counts."""
    values, at = np.unique(-score, return_inverse=True)
    times = np.ones(len(score)) if times is None else times
    pos, n = np.bincount(at, weights=truth * times, minlength=len(values)), np.bincount(at, weights=times, minlength=len(values))
    return float((pos * np.cumsum(pos) / np.cumsum(n)).sum() / pos.sum()) if pos.sum() else 0.0


def edges_of(column: np.ndarray) -> np.ndarray:
    """Lower edges of the bins above the first."""
    values = np.unique(column)
    if len(values) > BINS:
        values = np.unique(np.quantile(column, np.arange(1, BINS) / BINS, method="higher"))
        return values
    return values[1:]


def distinct(x: np.ndarray, truth: np.ndarray, edges: list[np.ndarray], times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows that no tree tells apart, once each: their bins, one of their rows,
    truth, and how many they are.  ``times``: how often a given row counts."""
    bins = np.column_stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(edges)]).astype(np.int64)
    key = truth.astype(np.int64)
    for f in range(bins.shape[1]):  # named anew for each feature, so that no key overflows
        key = np.unique(key * (BINS + 1) + bins[:, f], return_inverse=True)[1]
    _, first, at, counts = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    if times is not None:
        counts = np.bincount(at, weights=times, minlength=len(first)).astype(np.int64)
    return bins[first], x[first], truth[first], counts


def standing(bins: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """A row of each of the bins: the lower edges."""
    columns = [np.append(np.float32(-np.inf), e)[bins[:, f]] for f, e in enumerate(edges)]
    return np.column_stack(columns).astype(np.float32) if columns else np.zeros((len(bins), 0), np.float32)


def drawn(rng: np.random.Generator, times: np.ndarray, n: int) -> np.ndarray:
    """How many of each kind a draw of ``n`` rows without replacement has.  From
    10^9 rows on, where numpy has no such draw, each row is drawn for itself."""
    if n >= (rows := times.sum()):
        return times
    return rng.multivariate_hypergeometric(times, n, method="marginals") if rows < 10**9 else rng.binomial(times, n / rows)


def soft(g: np.ndarray, alpha: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0.0)


def grown(bins: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, rows: np.ndarray, columns: np.ndarray, depth: int, rate: float, min_child: float, gamma: float, alpha: float, lam: float) -> Tree:
    size = 2 ** (depth + 1) - 1
    feature, threshold, value, gain_of = np.full(size, -1), np.zeros(size), np.zeros(size), np.zeros(size)
    node, own, gg, hh = np.zeros(len(rows), np.int64), rows, g[rows], h[rows]
    value[0] = -rate * soft(gg.sum(), alpha) / (hh.sum() + lam)
    for level in range(depth):
        first, n = 2**level - 1, 2**level
        local = node - first
        best, split_f, split_b = np.full(n, gamma + 1e-12), np.full(n, -1), np.zeros(n, np.int64)
        left = np.zeros((n, 2))
        whole = np.column_stack([np.bincount(local, weights=w, minlength=n) for w in (gg, hh)])
        parent = soft(whole[:, 0], alpha) ** 2 / (whole[:, 1] + lam)
        for f in columns.tolist():
            k = len(edges[f]) + 1
            if k < 2:
                continue
            key = local * k + bins[own, f]
            below = [np.cumsum(np.bincount(key, weights=w, minlength=n * k).reshape(n, k), axis=1)[:, :-1] for w in (gg, hh)]
            gl, hl = below
            gr, hr = whole[:, :1] - gl, whole[:, 1:] - hl
            gains = 0.5 * (soft(gl, alpha) ** 2 / (hl + lam) + soft(gr, alpha) ** 2 / (hr + lam) - parent[:, None])
            gains[(hl < min_child) | (hr < min_child)] = -np.inf
            at = gains.argmax(axis=1)
            top = gains[np.arange(n), at]
            better = top > best
            best[better], split_f[better], split_b[better] = top[better], f, at[better]
            left[better] = np.column_stack([gl[np.arange(n), at], hl[np.arange(n), at]])[better]
        for k in np.flatnonzero(split_f >= 0).tolist():
            here = first + k
            feature[here], threshold[here], gain_of[here] = split_f[k], edges[split_f[k]][split_b[k]], best[k]
            for child, (a, b) in ((2 * here + 1, left[k]), (2 * here + 2, whole[k] - left[k])):
                value[child] = -rate * soft(a, alpha) / (b + lam)
        moving = split_f[local] >= 0
        if not moving.any():
            break
        own, node, local, gg, hh = own[moving], node[moving], local[moving], gg[moving], hh[moving]
        node = 2 * node + 1 + (bins[own, split_f[local]] > split_b[local])
    return Tree(feature, threshold.astype(np.float32), value, gain_of)


def fit(
    x: np.ndarray,
    truth: np.ndarray,
    x_held: np.ndarray,
    truth_held: np.ndarray,
    *,
    rounds: int = 1000,
    depth: int = 5,
    rate: float = 0.05,
    subsample: float = 0.8,
    columns: float = 0.8,
    min_child: float = 20.0,
    gamma: float = 0.2,
    alpha: float = 0.0,
    lam: float = 1.0,
    weight: float = 1.0,
    patience: int = 30,
    seed: int = 42,
    edges: list[np.ndarray] | None = None,
    times: np.ndarray | None = None,
    times_held: np.ndarray | None = None,
) -> Trees:
    """Up to ``rounds`` trees, cut to the prefix of greatest average precision
    on the held rows (all of them, if none are held) before ``patience`` rounds
    without gain.  ``min_child`` bounds the sum of second derivatives.

    Trees see bins only, so rows of equal bins and truth are one row that
    counts several times; a round's cost follows the distinct ones.  Rows may be
    given so, with the ``edges`` of all and how many each is."""
    base = 0.0
    model = Trees(base, [])
    if not len(x):
        return model
    rng = np.random.default_rng(seed)
    edges = [edges_of(x[:, f]) for f in range(x.shape[1])] if edges is None else edges
    bins, x, truth, times = distinct(x, truth, edges, times)
    n_rows = max(1, int(subsample * int(times.sum())))
    _, x_held, truth_held, times_held = distinct(x_held, truth_held, edges, times_held)
    w = np.where(truth == 1, weight, 1.0)
    margin, margin_held = np.full(len(x), base), np.full(len(x_held), base)
    best, best_at = -1.0, 0
    n_columns = max(1, int(columns * x.shape[1]))
    for k in range(rounds):
        p = 1.0 / (1.0 + np.exp(-margin))
        taken = drawn(rng, times, n_rows)
        g, h = taken * w * (p - truth), taken * w * p * (1 - p)
        rows = np.flatnonzero(taken)
        chosen = np.sort(rng.permutation(x.shape[1])[:n_columns])
        tree = grown(bins, edges, g, h, rows, chosen, depth, rate, min_child, gamma, alpha, lam)
        model.trees.append(tree)
        margin += tree.scores(x)
        if len(x_held):
            margin_held += tree.scores(x_held)
            ap = average_precision(truth_held, margin_held, times_held)
            if ap > best + 1e-12:
                best, best_at = ap, k + 1
            elif k + 1 - best_at >= patience:
                break
    if len(x_held):
        model.trees = model.trees[:best_at]
    return model
