"""Trees over binned features inside tasks: histograms of sums, and scores of fitted trees.

The module is sent to the tasks by value, so executors need numpy and pyarrow but not this package.

A tree is a list of nodes (feature, cut, left, right, value): rows whose feature is below the cut go left;
a leaf has feature -1. Over binned rows the cut is a bin code, over feature vectors a number.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

Node = tuple[int, float, int, int, float]
BLOCK = ["n", "codes", "y", "w", "u", "m"]


def leaves(x: np.ndarray, nodes: list[Node]) -> np.ndarray:
    """Number of the node in which each row of ``x`` ends."""
    feature = np.array([n[0] for n in nodes])
    cut = np.array([n[1] for n in nodes], dtype=float)
    ways = np.array([[n[3], n[2]] for n in nodes])
    if feature[0] < 0:
        return np.zeros(len(x), dtype=int)
    # All rows take the first cut, most end some levels below.
    rows = np.arange(len(x))
    at = ways[0, (x[:, feature[0]] < cut[0]).astype(int)]
    while len(rows):
        inner = feature[at[rows]] >= 0
        rows = rows[inner]
        if not len(rows):
            break
        here = at[rows]
        below = x[rows, feature[here]] < cut[here]
        at[rows] = ways[here, below.astype(int)]
    return at


def margins(x: np.ndarray, trees: list[list[Node]]) -> np.ndarray:
    """Sum of the values of all trees for each row."""
    total = np.zeros(len(x))
    for nodes in trees:
        total += np.array([n[4] for n in nodes])[leaves(x, nodes)]
    return total


def codes_task(edges: list[list[float]]):
    """Bin codes of the feature arrays: the number of edges at or below the value."""
    kind = np.uint8 if max((len(e) for e in edges), default=0) < 256 else np.uint16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("x"), len(edges))
            codes = np.empty(x.shape, kind)
            for j, e in enumerate(edges):
                codes[:, j] = np.searchsorted(np.array(e, dtype=float), x[:, j], "right")
            packed = [row.tobytes() for row in codes]
            yield pa.RecordBatch.from_arrays(
                [pa.array(packed, pa.binary()), *[batch.column(c) for c in ("y", "w", "u", "m")]],
                ["codes", "y", "w", "u", "m"],
            )

    return run


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def blocks_task(edges: list[list[float]]):
    """One row per batch of binned rows, so that a round moves a few arrays instead of many rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in codes_task(edges)(batches):
            if batch.num_rows:
                numbers = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "w", "u", "m")]
                yield packed(b"".join(batch.column("codes").to_pylist()), *numbers)

    return run


def packed(codes: bytes, y: np.ndarray, w: np.ndarray, u: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
    """A block: codes of all rows one after the other, then label, weight, hash and margin of each."""
    given = [pa.array([a.tobytes()], pa.binary()) for a in (y, w, u, m)]
    return pa.RecordBatch.from_arrays([pa.array([len(y)], pa.int32()), pa.array([codes], pa.binary()), *given], BLOCK)


def blocks(batches: Iterator[pa.RecordBatch], width: int, kind: str) -> Iterator[tuple[np.ndarray, ...]]:
    """(codes by row and feature, label, weight, hash, margin) of each block."""
    for batch in batches:
        for i in range(batch.num_rows):
            n, codes, y, w, u, m = (batch.column(c)[i].as_py() for c in BLOCK)
            floats = [np.frombuffer(a) for a in (y, w, m)]
            yield np.frombuffer(codes, kind).reshape(n, width), floats[0], floats[1], np.frombuffer(u, np.int64), floats[2]


def cells(rows: Iterator) -> Iterator[tuple]:
    """Blocks as plain tuples."""
    for n, *arrays in rows:
        yield n, *map(bytes, arrays)


def in_cells(task, names: list[str]):
    """Task code over plain tuples of numbers and bytes from that over batches with these columns."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        batches = (pa.RecordBatch.from_arrays([pa.array([v]) for v in row], names) for row in rows)
        for out in task(batches):
            yield from zip(*(c.to_pylist() for c in out.columns))

    return run


def kept_rows(u: np.ndarray, round_: int, share: float) -> np.ndarray:
    """A fresh share of the rows in every round, drawn from each row's own hash."""
    if share >= 1:
        return np.ones(len(u), dtype=bool)
    with np.errstate(over="ignore"):
        z = u.astype(np.uint64) + np.uint64(round_ + 1) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z >> np.uint64(11)).astype(float) / 2**53 < share


def histograms(codes: np.ndarray, starts: np.ndarray, node: np.ndarray, nodes: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(measure, node, bin) sums of two measures from (feature, row) codes; the bins of feature j start at ``starts[j]``."""
    out = np.zeros((2, nodes, int(starts[-1])))
    for j, n in enumerate(np.diff(starts).tolist()):
        at = node * n + codes[j]
        for total, measure in zip(out, (a, b)):
            total[:, starts[j] : starts[j + 1]] = np.bincount(at, measure, nodes * n).reshape(nodes, n)
    return out


def histogram_task(starts: np.ndarray, kind: str, trees: list, growing: list[Node], open_: list[int], sums,
                   round_: int = 0, share: float = 1.0):
    """Per task one row: sums of two measures by open node, feature and bin as binary; the bins of feature j start at ``starts[j]``.

    ``sums`` gives the two measures of each row from its label, weight and margin. The margin stored with a row
    is that before ``trees``; ``growing`` is the tree at hand, of whose nodes those in ``open_`` are wanted.
    """
    slot = {n: i for i, n in enumerate(open_)}
    width, bins = len(starts) - 1, int(starts[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(open_) * bins
        total = np.zeros((2, size))
        any_rows = False
        for x, y, w, u, m in blocks(batches, width, kind):
            any_rows = True
            m = m + margins(x, trees)
            node = np.array([slot.get(i, -1) for i in range(len(growing))])[leaves(x, growing)]
            wanted = (node >= 0) & kept_rows(u, round_, share)
            a, b = sums(y[wanted], w[wanted], m[wanted])
            total += histograms(np.ascontiguousarray(x[wanted].T), starts, node[wanted], len(open_), a, b).reshape(2, size)
        if any_rows:
            yield _written(total)

    return run


def _written(total) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([t.tobytes()], pa.binary()) for t in total], ["a", "b"])


def added_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of all rows, element by element."""
    total = None
    for batch in batches:
        for a, b in zip(*(batch.column(c).to_pylist() for c in ("a", "b"))):
            row = np.stack([np.frombuffer(a), np.frombuffer(b)])
            total = row if total is None else total + row
    if total is not None:
        yield _written(total)


def margin_task(width: int, kind: str, trees: list):
    """Blocks with their margins carried on by ``trees``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, y, w, u, m in blocks(batches, width, kind):
            yield packed(x.tobytes(), y, w, u, m + margins(x, trees))

    return run


def gradients(y: np.ndarray, w: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivative of the logistic loss."""
    p = 1 / (1 + np.exp(-m))
    return w * (p - y), w * p * (1 - p)


def residuals(y: np.ndarray, w: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the loss 2·log(1 + exp(-2·y·m)) for labels -1 and 1, and the weight, so that a leaf is a mean."""
    sign = 2 * y - 1
    return -4 * w * sign / (1 + np.exp(2 * sign * m)), w


def masses(y: np.ndarray, w: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Boosted weight of the positives and of all rows.

    The margin is the sum of ±α of all votes, so a wrong vote has raised a weight by the factor exp(α) against a right one.
    """
    boosted = w * np.exp((0.5 - y) * m)
    return boosted * y, boosted


def margins_udf(trees: list, width: int):
    """Series of feature arrays → sum of all trees."""

    def run(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=float)
        return pd.Series(margins(np.vstack(vectors.to_numpy()).reshape(len(vectors), width), trees))

    return run
