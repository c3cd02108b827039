"""Small gradient-boosted trees over a few dense columns, grown from histograms in numpy and held in flat node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass
class Trees:
    """All nodes of all trees. A leaf has feature -1; `left` of a node holds values at most its threshold."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    bias: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        """The sum over the trees for each row; all rows go down one level of one tree at a time."""
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[at]
                goes_left = x[rows, np.maximum(f, 0)] <= self.threshold[at]
                at = np.where(f < 0, at, np.where(goes_left, self.left[at], self.right[at]))
            out += self.value[at]
        return out

    def paths(self) -> list[list[tuple[int, bool, float]]]:
        """Each way from a root to a node below, as (feature, whether at most, threshold)."""
        out = []
        for root in self.roots:
            todo = [(int(root), [])]
            while todo:
                node, path = todo.pop()
                if path:
                    out.append(path)
                if (f := int(self.feature[node])) >= 0:
                    t = float(self.threshold[node])
                    todo += [(int(self.left[node]), [*path, (f, True, t)]), (int(self.right[node]), [*path, (f, False, t)])]
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _binned(x: np.ndarray, bins: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The cut points of each column, and each value's bin: the number of cut points below it."""
    cuts = []
    for column in x.T:
        values = np.unique(column)
        if len(values) > bins:
            values = np.unique(np.quantile(column, np.linspace(0, 1, bins + 1), method="lower"))
        cuts.append((values[:-1] + values[1:]) / 2)
    return cuts, np.stack([np.searchsorted(c, column, "left") for c, column in zip(cuts, x.T, strict=True)], axis=1) if len(cuts) else np.zeros(x.shape, int)


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.15, l2: float = 2.0, least_rows: float = 5.0, monotone: dict[int, int] | None = None, share: float = 1.0, seed: int = 0, weight: np.ndarray | None = None) -> Trees:
    """Fit logistic loss. monotone: for a column, 1 if the score may only rise with it and -1 if it may only fall. share: of the rows, for each tree."""
    monotone, rng = monotone or {}, np.random.default_rng(seed)
    weight = np.ones(len(y)) if weight is None else weight
    mean = float(np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    bias = float(np.log(mean / (1 - mean)))
    cuts, bins = _binned(x, BINS) if len(y) else ([np.zeros(0)] * x.shape[1], np.zeros(x.shape, int))
    nodes: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    roots, margin = [], np.full(len(y), bias)

    def leaf(value: float) -> int:
        for k, v in (("feature", -1), ("threshold", 0.0), ("left", 0), ("right", 0), ("value", value)):
            nodes[k].append(v)
        return len(nodes["value"]) - 1

    def best_split(rows, g, h, low, high):
        total_g, total_h = g[rows].sum(), h[rows].sum()
        clip = lambda a, b: np.clip(-a / (b + l2), low, high)
        gain_of = lambda a, b, w: -(a * w + 0.5 * (b + l2) * w * w)
        whole = gain_of(total_g, total_h, clip(total_g, total_h))
        best = (1e-6, None)
        for f, c in enumerate(cuts):
            if not len(c):
                continue
            n = len(c) + 1
            gs, hs = (np.cumsum(np.bincount(bins[rows, f], v[rows], n))[:-1] for v in (g, h))
            count = np.cumsum(np.bincount(bins[rows, f], weight[rows], n))[:-1]
            wl, wr = clip(gs, hs), clip(total_g - gs, total_h - hs)
            gain = gain_of(gs, hs, wl) + gain_of(total_g - gs, total_h - hs, wr) - whole
            bad = (count < least_rows) | (weight[rows].sum() - count < least_rows)
            if way := monotone.get(f):
                bad |= way * (wr - wl) < 0
            gain[bad] = -1
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], (f, k, float(wl[k]), float(wr[k])))
        return best[1]

    def grow(rows, g, h, low, high, left_depth) -> int:
        me = leaf(float(rate * np.clip(-g[rows].sum() / (h[rows].sum() + l2), low, high)))
        if left_depth and len(rows) and (split := best_split(rows, g, h, low, high)):
            f, k, wl, wr = split
            mid = (wl + wr) / 2
            bounds = {1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid))}.get(monotone.get(f, 0), ((low, high), (low, high)))
            goes = bins[rows, f] <= k
            nodes["left"][me] = grow(rows[goes], g, h, *bounds[0], left_depth - 1)
            nodes["right"][me] = grow(rows[~goes], g, h, *bounds[1], left_depth - 1)
            nodes["feature"][me], nodes["threshold"][me] = f, float(cuts[f][k])
        return me

    made = lambda: Trees(np.array(roots, int), *(np.array(nodes[k]) for k in nodes), bias, depth)
    for _ in range(trees if len(np.unique(y)) > 1 else 0):
        p = sigmoid(margin)
        g, h = (p - y) * weight, p * (1 - p) * weight
        rows = np.arange(len(y)) if share >= 1 else np.flatnonzero(rng.random(len(y)) < share)
        start = len(nodes["value"])
        roots.append(grow(rows, g, h, -np.inf, np.inf, depth))
        one = made()
        one.roots, one.bias = np.array([start]), 0.0
        margin += one.margin(x)
    return made()
