"""Rounds of boosting from sums over binned rows, wherever the sums are made: on the driver from those of all tasks, or in one task
that holds all rows.

The module is sent to the tasks by value, so executors need numpy and pyarrow but not this package.
"""

from __future__ import annotations

import json
import math
import random
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

from propensa.functions.trees import Node, blocks, histograms, kept_rows, leaves, margins, masses

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Gains are compared after rounding to so many digits, so that equal ones tie on any machine.
DIGITS = 10


class Rows:
    """Bins of the rows; ``sums`` and ``add`` come from where the rows are."""

    def __init__(self, edges: list[list[float]]):
        self.edges, self.width = edges, len(edges)
        self.bins = 1 + max((len(e) for e in edges), default=0)
        self.starts = np.cumsum([0] + [1 + len(e) for e in edges])
        self.kind = "u1" if self.bins <= 256 else "u2"

    def placed(self, total: np.ndarray) -> np.ndarray:
        """(measure, node, feature, bin) sums from those by (measure, node, bin there is)."""
        out = np.zeros((2, total.shape[1], self.width, self.bins))
        out[:, :, np.arange(self.bins) < np.diff(self.starts)[:, None]] = total
        return out

    def in_features(self, tree: list[Node]) -> list[Node]:
        """The tree with cuts in terms of the features instead of bin codes."""
        return [
            (f, self.edges[f][int(c) - 1] if f >= 0 else 0.0, left, right, value) for f, c, left, right, value in tree
        ]

    def valid(self) -> np.ndarray:
        """Cuts there are: (feature, code) for codes from 1 on."""
        counts = np.array([len(e) for e in self.edges])
        return np.arange(1, self.bins)[None, :] <= counts[:, None]


class Held(Rows):
    """Rows that one task holds, each with its margin."""

    def __init__(self, edges: list[list[float]], batches: Iterator[pa.RecordBatch]):
        super().__init__(edges)
        x, self.y, self.w, u, _ = (np.concatenate(a) for a in zip(*blocks(batches, self.width, self.kind)))
        # One order on any cluster, so that sums agree to the last digit.
        order = np.argsort(u, kind="stable")
        self.x, self.y, self.w, self.u = x[order], self.y[order], self.w[order], u[order]
        self.columns = np.ascontiguousarray(self.x.T).astype(np.int64)
        self.m = np.zeros(len(x))

    def sums(self, measures: Callable, growing: list[Node], open_: list[int], round_: int = 0, share: float = 1.0) -> np.ndarray:
        slot = np.full(len(growing), -1)
        slot[open_] = np.arange(len(open_))
        node = slot[leaves(self.x, growing)]
        wanted = np.flatnonzero((node >= 0) & kept_rows(self.u, round_, share))
        a, b = measures(self.y[wanted], self.w[wanted], self.m[wanted])
        columns = self.columns if len(wanted) == len(self.x) else self.columns[:, wanted]
        return self.placed(histograms(columns, self.starts, node[wanted], len(open_), a, b))

    def add(self, tree: list[Node]) -> None:
        self.m += margins(self.x, [tree])


def whole_task(edges: list[list[float]], rounds: Callable, given: tuple):
    """What ``rounds`` makes of all rows, as JSON."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps(rounds(Held(edges, batches), *given))])], ["found"])

    return run


def _below(sums: np.ndarray) -> np.ndarray:
    """(feature, cut) sums of the rows below each cut."""
    return np.cumsum(sums, axis=1)[:, :-1]


def _best(gains: np.ndarray) -> tuple[int, int, float] | None:
    """(feature, code, gain) of the highest gain, the first feature and cut on ties."""
    if not gains.size or not np.isfinite(gains).any():
        return None
    with np.errstate(divide="ignore", invalid="ignore"):
        scale = 10.0 ** (DIGITS - np.ceil(np.log10(np.nanmax(np.abs(np.where(np.isfinite(gains), gains, 0))) or 1.0)))
    j, c = np.unravel_index(np.argmax(np.round(gains * scale)), gains.shape)
    return int(j), int(c) + 1, float(gains[j, c])


def shrunk(g, alpha: float):
    """The gradient sum after the L1 penalty."""
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0)


def strength(g, h, l1: float, l2: float):
    """What a leaf takes off the loss, doubled."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(h + l2 > 0, shrunk(g, l1) ** 2 / (h + l2), 0.0)


def split_gains(g: np.ndarray, h: np.ndarray, valid: np.ndarray, l1: float, l2: float, child_weight: float) -> np.ndarray:
    """(feature, cut) gain of each cut of a node from its sums by (feature, bin); -inf where it is not allowed."""
    gl, hl = _below(g), _below(h)
    whole_g, whole_h = g.sum(axis=1, keepdims=True), h.sum(axis=1, keepdims=True)
    gr, hr = whole_g - gl, whole_h - hl
    gain = strength(gl, hl, l1, l2) + strength(gr, hr, l1, l2) - strength(whole_g, whole_h, l1, l2)
    # Sums of equal weights may differ in their last digits: a trace is not weight, and a limit just met is met.
    least = max(child_weight - 1e-9, 1e-9)
    return np.where(valid & (hl >= least) & (hr >= least), gain, -np.inf)


def grown(
    data: Rows, measures: Callable, rounds: int, rate: float, first_rate: float, depth: int, l1: float, l2: float,
    min_gain: float, child_weight: float, rows: float, columns: float, seed: int,
) -> tuple[list[list[Node]], list[float]]:
    """(trees, share of each feature in the gain) of boosting by two measures of the rows, the numerators and denominators of leaves."""
    draw = random.Random(seed)
    valid = data.valid()
    fitted, importance = [], np.zeros(data.width)
    for t in range(rounds):
        step = rate if t else first_rate
        allowed = np.zeros(data.width, dtype=bool)
        allowed[draw.sample(range(data.width), max(1, round(columns * data.width)))] = True
        tree: list[Node] = [(-1, 0.0, -1, -1, 0.0)]
        open_ = [0]
        for level in range(depth):
            gs, hs = data.sums(measures, tree, open_, t, rows)
            nodes, open_ = open_, []
            for n, g, h in zip(nodes, gs, hs):
                def leaf(a: float, b: float) -> Node:
                    return (-1, 0.0, -1, -1, float(-shrunk(a, l1) / (b + l2) * step) if b + l2 > 0 else 0.0)

                whole_g, whole_h = g[0].sum(), h[0].sum()
                if level == 0:
                    tree[n] = leaf(whole_g, whole_h)
                best = _best(split_gains(g, h, valid & allowed[:, None], l1, l2, child_weight))
                if best is None or best[2] <= max(min_gain, 1e-9):
                    continue
                j, c, gain = best
                importance[j] += gain
                left, right = len(tree), len(tree) + 1
                gl, hl = g[j, :c].sum(), h[j, :c].sum()
                tree[n] = (j, float(c), left, right, 0.0)
                tree += [leaf(gl, hl), leaf(whole_g - gl, whole_h - hl)]
                open_ += [left, right]
            if not open_:
                break
        fitted.append(data.in_features(tree))
        data.add(tree)
    return fitted, [float(i / (importance.sum() or 1.0)) for i in importance]


def purities(positive: np.ndarray, mass: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """(feature, cut) weight that a cut leaves unmixed (Gini), from the weights by (feature, bin)."""
    p, m = _below(positive), _below(mass)
    all_p, all_m = positive.sum(axis=1, keepdims=True), mass.sum(axis=1, keepdims=True)

    def pure(a, b):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(b > 1e-12, (a**2 + (b - a) ** 2) / b, 0.0)

    two_sided = (m > 1e-12) & (all_m - m > 1e-12)
    return np.where(valid & two_sided, pure(p, m) + pure(all_p - p, all_m - m), -np.inf)


def stumped(data: Rows, rounds: int, rate: float) -> tuple[list[list[Node]], list[tuple[int, float, float, float]], list[float]]:
    """(trees, what is said of each stump, the say of each feature) of AdaBoost; see ``stumps`` of the operators."""
    valid = data.valid()
    fitted, said, importance = [], [], np.zeros(data.width)
    for _ in range(rounds):
        (p,), (m,) = data.sums(masses, [(-1, 0.0, -1, -1, 0.0)], [0])
        best = _best(purities(p, m, valid))
        if best is None:
            break
        j, c, _ = best
        total, positive = m[0].sum(), p[0].sum()
        pl, ml = p[j, :c].sum(), m[j, :c].sum()
        votes = [2 * pl > ml, 2 * (positive - pl) > total - ml]
        wrong = (ml - pl if votes[0] else pl) + ((total - ml) - (positive - pl) if votes[1] else positive - pl)
        error = max(0.0, float(wrong / total))
        if error >= 0.5:
            break
        alpha = 1.0 if error <= 1e-12 else rate * math.log((1 - error) / error)
        tree: list[Node] = [
            (j, float(c), 1, 2, 0.0), *[(-1, 0.0, -1, -1, alpha if v else -alpha) for v in votes]
        ]
        fitted.append(data.in_features(tree))
        said.append((j, fitted[-1][0][1], error, alpha))
        importance[j] += alpha
        if error <= 1e-12:
            break
        data.add(tree)
    return fitted, said, [float(i) for i in importance]
