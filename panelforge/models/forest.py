"""Regression trees grown level by level with array operations, for forests that are fitted many at a time, one task each."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Tree:
    """Nodes as arrays; ``feature`` is -1 for a leaf, children of node i are ``child[i]`` (x <= threshold) and the one after."""

    feature: np.ndarray
    threshold: np.ndarray
    child: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at, inner = np.zeros(len(x), np.int64), np.arange(len(x))
        while True:
            inner = inner[self.feature[at[inner]] >= 0]
            if not len(inner):
                return self.value[at]
            node = at[inner]
            at[inner] = self.child[node] + (x[inner, self.feature[node]] > self.threshold[node])


def presort(x: np.ndarray) -> np.ndarray:
    """The rows by each feature (features, rows): what trees on draws of the same rows share."""
    return np.argsort(x, axis=0, kind="stable").T.astype(np.int32)


#: Numbers up to which all features are weighed at once; beyond it one after the other, for less memory.
CELLS_AT_ONCE = 100_000


def _best_splits(v: np.ndarray, wy: np.ndarray, w: np.ndarray, counts: np.ndarray, mass: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every node the feature and place of the split that lowers the squared error most, and its gain; gain 0 where none does, the first feature on ties.

    ``v``, ``wy`` and ``w`` (features, rows) have values, weighted responses and weights by node and, within a node, by the feature. Responses are
    centred within their node, so that running sums over all rows are those of each node and every split of every node is weighed at once.
    """
    start, mean = np.cumsum(counts) - counts, total / mass
    all_mass, centre, before = np.repeat(mass, counts), np.repeat(mean, counts), np.repeat(np.cumsum(mass) - mass, counts)
    gain, step = np.empty(v.shape), len(v) if v.size <= CELLS_AT_ONCE else 1
    for f in range(0, len(v), step):
        own = slice(f, f + step)
        left_w = np.cumsum(w[own], axis=1)
        left_w -= before
        top = w[own] * centre
        np.subtract(wy[own], top, out=top)
        np.cumsum(top, axis=1, out=top)
        top -= np.repeat(np.concatenate([np.zeros((len(top), 1)), top[:, start[1:] - 1]], axis=1), counts, axis=1)  # what rounding left of the nodes before
        top *= top
        top *= all_mass
        rest = all_mass - left_w
        rest *= left_w
        np.copyto(rest[:, :-1], np.inf, where=v[own, 1:] <= v[own, :-1])
        rest[:, start + counts - 1] = np.inf
        np.divide(top, rest, out=gain[own])
    tops = np.maximum.reduceat(gain, start, axis=1)
    floor = 1e-12 * np.maximum(total * mean, 1e-300)
    best, most = np.full(len(counts), -1), np.zeros(len(counts))
    for f, top in enumerate(tops):
        better = top > most + np.maximum(floor, 1e-12 * most)
        best, most = np.where(better, f, best), np.where(better, top, most)
    own = gain.ravel().take(np.repeat(best * v.shape[1], counts) + np.arange(v.shape[1]))
    ties = np.flatnonzero(own == np.repeat(most, counts))
    at = ties[np.minimum(np.searchsorted(ties, start), len(ties) - 1)] if len(ties) else start  # the first greatest of each node
    return best, np.where(most > 0, at, start), most


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator | None, depth: int, at: np.ndarray | None = None, order: np.ndarray | None = None) -> Tree:
    """A tree on a bootstrap draw (or, without ``rng``, on the rows themselves): all features at every split, leaves of one row allowed.

    With ``at`` only nodes that hold one of these points are split: the tree is whole for them and serves no others. ``order``: presort(x).
    The rows lie sorted by each feature within the nodes of a level. A level's left children come before its right ones, so rows are dealt to
    the next level by picking, and never sorted again.
    """
    drawn = np.ones(len(y)) if rng is None else np.bincount(rng.integers(0, len(y), len(y)), minlength=len(y)).astype(float)
    order = presort(x) if order is None else order
    row = order[(drawn > 0)[order]].reshape(x.shape[1], -1)
    v, w = np.stack([x[r, f] for f, r in enumerate(row)]), drawn[row]
    wy, side = (drawn * y)[row], np.zeros(len(y), np.int8)
    counts, mass, total = np.array([row.shape[1]]), np.array([drawn.sum()]), np.array([drawn @ y])
    feature, threshold, child, value = [np.array([-1])], [np.zeros(1)], [np.zeros(1, np.int64)], [total / mass]
    first, size, growing = 0, 1, np.flatnonzero(counts > 1)  # growing: places in the level of the nodes that may be split, as their rows lie
    held = None if at is None else np.zeros(len(at), np.int64)
    for _ in range(depth):
        if not len(growing) or (held is not None and not len(held)):
            break
        f, place, gain = _best_splits(v, wy, w, counts, mass, total)
        split = np.flatnonzero(gain > 0)
        if not len(split):
            break
        width, start = v.shape[1], np.cumsum(counts) - counts
        own = np.repeat(f * width, counts) + np.arange(width)  # every node's rows by its own feature
        low, high = v.ravel()[f * width + place], v.ravel()[f * width + np.minimum(place + 1, width - 1)]
        middle = (low + high) / 2
        cut = np.where(middle < high, middle, low)
        feature[-1][growing[split]], threshold[-1][growing[split]] = f[split], cut[split]
        child[-1][growing[split]] = first + size + 2 * np.arange(len(split))
        first, size = first + size, 2 * len(split)
        ends = np.stack([start, place + 1], 1).ravel()
        masses, totals = (np.add.reduceat(a.ravel().take(own), ends).reshape(-1, 2)[split] for a in (w, wy))
        sizes = np.stack([place - start + 1, counts - (place - start + 1)], 1)[split]
        feature.append(np.full(size, -1))
        threshold.append(np.zeros(size))
        child.append(np.zeros(size, np.int64))
        value.append((totals / masses).ravel())
        more = sizes > 1
        if at is not None:
            below = np.full(len(growing), -1)
            below[split] = np.arange(len(split))
            at, held = at[below[held] >= 0], held[below[held] >= 0]
            right = at[np.arange(len(at)), f[held]] > cut[held]
            held = 2 * below[held] + right
            more &= (np.bincount(held, minlength=size) > 0).reshape(-1, 2)
        growing = np.concatenate([2 * np.flatnonzero(more[:, 0]), 2 * np.flatnonzero(more[:, 1]) + 1])
        if at is not None:
            number = np.full(size, -1)
            number[growing] = np.arange(len(growing))
            at, held = at[number[held] >= 0], number[held][number[held] >= 0]
        counts, mass, total = (a.T[more.T] for a in (sizes, masses, totals))
        code = np.zeros((len(f), 2), np.int8)  # 1 for rows that go on in a left child, 2 in a right one, 0 for those of finished leaves
        code[split] = more * np.array([1, 2], np.int8)
        side[row.ravel().take(own)] = np.repeat(code.ravel(), np.diff(ends, append=width))
        goes = side.take(row)
        picked = [np.flatnonzero(goes == k) for k in (1, 2)]
        row, v, w, wy = (np.concatenate([a.ravel().take(p).reshape(len(a), -1) for p in picked], axis=1) for a in (row, v, w, wy))
    return Tree(np.concatenate(feature), np.concatenate(threshold), np.concatenate(child), np.concatenate(value))
