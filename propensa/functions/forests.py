"""Random forests over binned features inside tasks: bootstrap counts, sums of the top nodes, whole subtrees, scores.

The module is sent to the tasks by value, so executors need numpy, pandas and pyarrow but not this package.

A tree is four arrays (feature, code, left, value): rows whose bin code is below ``code`` go to node ``left``, the
others to the node after it. A leaf has feature -1. The key of a node, derived from its tree and the way to it, draws its features, so a
tree is the same whether a node is split from sums of all tasks or inside one.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

Tree = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
#: Types of the four arrays.
KINDS = (np.int16, np.uint8, np.int32, np.float32)
#: Code of a leaf, above that of any bin.
LEAF = 255
#: Shares are added up as whole numbers of this unit, so that the order of the additions does not matter.
UNIT = 2.0**-44
#: Stands for the tree of packed rows; they come after the nodes of their part.
ROWS = 2**31 - 1
#: Nodes whose sums a task holds at a time.
NODES_AT_ONCE = 1_024
#: Gains are compared after rounding to so many digits, so that equal ones tie on any machine.
DIGITS = 10
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(16)])


@dataclass(frozen=True)
class Rules:
    """What all trees of a forest have in common."""

    width: int
    bins: int
    tried: int
    depth: int
    least: int
    bootstrap: bool
    seed: int


def mixed(z: np.ndarray) -> np.ndarray:
    """64 bits that depend on all bits given."""
    with np.errstate(over="ignore"):
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def root_key(rules: Rules, tree: int) -> np.uint64:
    with np.errstate(over="ignore"):
        return mixed(np.array([rules.seed * 1_000_003 + tree + 1], np.uint64) * _GOLD)[0]


def child_keys(keys: np.ndarray) -> np.ndarray:
    """(node, side) keys of both children of each node."""
    with np.errstate(over="ignore"):
        return mixed(keys[:, None] * np.uint64(2) + np.array([1, 2], np.uint64) * _GOLD)


def drawn(u: np.ndarray, rules: Rules, tree: int) -> np.ndarray:
    """How often each row is in the bootstrap sample of the tree, from its own hash."""
    if not rules.bootstrap:
        return np.ones(len(u))
    with np.errstate(over="ignore"):
        z = mixed(u.astype(np.uint64) + root_key(rules, tree))
    return np.searchsorted(_POISSON, (z >> np.uint64(11)).astype(float) / 2**53, "right").astype(float)


def tried_features(keys: np.ndarray, rules: Rules) -> np.ndarray:
    """(node, place) the features that each node may be split by, in ascending order."""
    with np.errstate(over="ignore"):
        z = mixed(keys[:, None] + np.arange(1, rules.width + 1, dtype=np.uint64) * _GOLD)
    return np.sort(np.argsort(z, axis=1, kind="stable")[:, : rules.tried], axis=1)


def sums(x: np.ndarray, rows: np.ndarray, slot: np.ndarray, tried: np.ndarray, measures, bins: int) -> np.ndarray:
    """(measure, node, place, bin) sums over the rows; ``slot`` is the node of each."""
    m, k = tried.shape
    at = ((slot[:, None] * k + np.arange(k)) * bins + x[rows[:, None], tried[slot]]).ravel()
    return np.stack([np.bincount(at, np.repeat(a[rows], k), m * k * bins).reshape(m, k, bins) for a in measures])


def best_splits(total: np.ndarray, rules: Rules) -> tuple[np.ndarray, ...]:
    """(place, code, gain) of each node, from its sums of rows, mass and positive mass by (place, bin); gain 0: none.

    The gain is what a cut takes off the Gini impurity. Both sides have ``least`` rows at least.
    """
    n, mass, pos = total
    nl, ml, pl = (np.cumsum(a, axis=2)[:, :, :-1] for a in (n, mass, pos))
    all_n, all_m, all_p = (a[:, :1].sum(axis=2, keepdims=True) for a in (n, mass, pos))
    with np.errstate(divide="ignore", invalid="ignore"):
        mr, pr = all_m - ml, all_p - pl
        mixture = pl * (ml - pl) / ml + pr * (mr - pr) / mr
        gain = 2 * (all_p * (all_m - all_p) / all_m - mixture) / all_m
    allowed = (nl >= rules.least) & (all_n - nl >= rules.least) & np.isfinite(gain)
    gain = np.where(allowed, np.round(gain, DIGITS), 0.0).reshape(len(n), -1)
    best = gain.argmax(axis=1)
    place, code = np.divmod(best, max(1, total.shape[3] - 1))
    return place, code + 1, np.maximum(gain[np.arange(len(gain)), best], 0.0)


def sums_task(rules: Rules, trees: list[Tree], open_: list[np.ndarray], tried: list[np.ndarray]):
    """Per task one row for every open node of every tree: the sums over its rows, flattened."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros((3, len(o), rules.tried, rules.bins)) for o in open_]
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y, w, u = columns(batch, rules.width)
            for t, tree in enumerate(trees):
                if not len(open_[t]):
                    continue
                n = drawn(u, rules, t)
                slots = np.full(len(tree[0]), -1)
                slots[open_[t]] = np.arange(len(open_[t]))
                slot = slots[ends(x, tree)]
                rows = np.flatnonzero((slot >= 0) & (n > 0))
                totals[t] += sums(x, rows, slot[rows], tried[t], (n, n * w, n * w * y), rules.bins)
        for t, nodes in enumerate(open_):
            if len(nodes):
                packed = [totals[t][:, i].tobytes() for i in range(len(nodes))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([t] * len(nodes), pa.int32()), pa.array(nodes, pa.int32()), pa.array(packed, pa.binary())],
                    ["tree", "node", "sums"],
                )

    return run


def split_group(rules: Rules):
    """The best split of one node from the sums of all tasks, with rows, mass and positive mass below it and in all."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros((3, 1, rules.tried, rules.bins))
        for s in pdf["sums"]:
            total += np.frombuffer(s).reshape(total.shape)
        place, code, gain = best_splits(total, rules)
        below = total[:, 0, place[0], : code[0]].sum(axis=1).tolist()
        whole = total[:, 0, 0].sum(axis=1).tolist()
        return pd.DataFrame({
            "tree": pdf["tree"][:1], "node": pdf["node"][:1], "place": place.astype("int32"), "code": code.astype("int32"),
            "gain": gain, "below": [below], "whole": [whole],
        })

    return run


def dealt_task(rules: Rules, trees: list[Tree], roots: list[np.ndarray]):
    """Rows packed by (tree, root of a subtree), each with the number of times it was drawn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y, w, u = columns(batch, rules.width)
            for t, tree in enumerate(trees):
                if not len(roots[t]):
                    continue
                n = drawn(u, rules, t)
                at = ends(x, tree)
                rows = np.flatnonzero((n > 0) & np.isin(at, roots[t]))
                rows = rows[np.argsort(at[rows], kind="stable")]
                nodes, first = np.unique(at[rows], return_index=True)
                parts = np.split(rows, first[1:]) if len(nodes) else []
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([t] * len(nodes), pa.int32()), pa.array(nodes, pa.int32()),
                        pa.array([x[p].tobytes() for p in parts], pa.binary()),
                        pa.array([np.stack([y[p], w[p], n[p]]).tobytes() for p in parts], pa.binary()),
                        pa.array([u[p].tobytes() for p in parts], pa.binary()),
                    ],
                    ["tree", "node", "codes", "given", "u"],
                )

    return run


def grown(x: np.ndarray, y: np.ndarray, w: np.ndarray, n: np.ndarray, key: np.uint64, depth: int,
          rules: Rules) -> tuple[Tree, np.ndarray]:
    """(tree, importance of each feature) of the rows below one node, level by level."""
    mass, pos = n * w, n * w * y
    size, links = 0, []
    keys, slot, rows = np.array([key], np.uint64), np.zeros(len(x), dtype=np.int64), np.arange(len(x))
    importance = np.zeros(rules.width)
    while len(keys):
        m = len(keys)
        count, all_m, all_p = (np.bincount(slot, a[rows], m) for a in (n, mass, pos))
        feature, code = np.full(m, -1, np.int16), np.full(m, LEAF, np.uint8)
        left, value = np.arange(size, size + m, dtype=np.int32), (all_p / np.maximum(all_m, 1e-300)).astype(np.float32)
        links.append((feature, code, left, value))
        size += m
        wanted = (all_p > 0) & (all_p < all_m) & (count >= 2 * rules.least) & (depth < rules.depth)
        kept = wanted[slot]
        rows, slot = rows[kept], slot[kept]
        order = np.argsort(slot, kind="stable")
        rows, slot = rows[order], slot[order]
        open_ = np.flatnonzero(wanted)
        starts = np.searchsorted(slot, open_)
        for i in range(0, len(open_), NODES_AT_ONCE):
            part = open_[i : i + NODES_AT_ONCE]
            stop = starts[i + NODES_AT_ONCE] if i + NODES_AT_ONCE < len(open_) else len(rows)
            here = rows[starts[i] : stop]
            tried = tried_features(keys[part], rules)
            total = sums(x, here, np.searchsorted(part, slot[starts[i] : stop]), tried, (n, mass, pos), rules.bins)
            place, cut, gain = best_splits(total, rules)
            split = gain > 0
            feature[part[split]] = tried[np.flatnonzero(split), place[split]]
            code[part[split]] = cut[split]
            importance += np.bincount(feature[part[split]], gain[split] * all_m[part[split]], rules.width)
        split = np.flatnonzero(feature >= 0)
        left[split] = size + 2 * np.arange(len(split))
        kept = feature[slot] >= 0
        rows, slot = rows[kept], slot[kept]
        above = x[rows, feature[slot]] >= code[slot]
        slot = 2 * np.searchsorted(split, slot) + above
        keys, depth = child_keys(keys[split]).ravel(), depth + 1
    return tuple(np.concatenate(a) for a in zip(*links)), importance


def subtree_group(rules: Rules, roots: list[dict]):
    """The whole subtree of one group of packed rows; ``roots`` holds (key, depth) of each root by tree."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tree, node = int(pdf["tree"].iloc[0]), int(pdf["node"].iloc[0])
        x = np.frombuffer(b"".join(pdf["codes"]), np.uint8).reshape(-1, rules.width)
        y, w, n = np.concatenate([np.frombuffer(g).reshape(3, -1) for g in pdf["given"]], axis=1)
        # One order on any cluster, so that sums agree to the last digit.
        order = np.argsort(np.frombuffer(b"".join(pdf["u"]), np.int64), kind="stable")
        key, depth = roots[tree][node]
        arrays, importance = grown(x[order], y[order], w[order], n[order], np.uint64(key), depth, rules)
        return pd.DataFrame({
            "tree": [tree], "node": [node], "nodes": [len(arrays[0])], **{c: [a.tobytes()] for c, a in zip("abcd", arrays)},
            "importance": [importance.tolist()],
        })

    return run


def unpacked(arrays) -> Tree:
    return tuple(np.frombuffer(bytes(a), kind) for a, kind in zip(arrays, KINDS))


def columns(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, ...]:
    x = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(batch.num_rows, width)
    return x, *(batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "w", "u"))


def ends(x: np.ndarray, tree: Tree) -> np.ndarray:
    """Number of the leaf in which each row of codes ends."""
    feature, code, left, _ = tree
    at, rows = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
    while len(rows):
        here = at[rows]
        inner = feature[here] >= 0
        rows, here = rows[inner], here[inner]
        at[rows] = left[here] + (x[rows, feature[here]] >= code[here])
    return at


def units(tree: Tree) -> np.ndarray:
    """Share of class 1 at each node as a whole number of units."""
    return np.rint(tree[3].astype(float) / UNIT).astype(np.int64)


def coded(x: np.ndarray, edges: list[list[float]]) -> np.ndarray:
    codes = np.empty(x.shape, np.uint8)
    for j, e in enumerate(edges):
        codes[:, j] = np.searchsorted(np.array(e, dtype=float), x[:, j], "right")
    return codes


def added(codes: np.ndarray, tops: list[Tree], owners: list[np.ndarray], part: int, pieces: dict) -> np.ndarray:
    """Units that the nodes of one part add to each row of codes.

    ``owners`` has the part of each leaf of the tops, -1 at their other nodes. A leaf that is the root of no subtree is a leaf of the tree.
    """
    total = np.zeros(len(codes), np.int64)
    for t, (top, owner) in enumerate(zip(tops, owners)):
        own = np.flatnonzero(owner == part)
        if not len(own):
            continue
        at = ends(codes, top)
        for node in own.tolist():
            rows = np.flatnonzero(at == node) if len(owner) > 1 else np.arange(len(codes))
            if not len(rows):
                continue
            below = pieces.get((t, node))
            if below is None:
                total[rows] += units(top)[node]
            else:
                total[rows] += below[1][ends(codes[rows], below[0])]
    return total


def _pieces(nodes: list) -> dict:
    return {(t, root): (tree, units(tree)) for t, root, tree in nodes}


def share_udf(nodes: list, tops: list[Tree], owners: list[np.ndarray], edges: list[list[float]]):
    """Series of feature arrays → mean of the shares of class 1 in the leaves of all trees, given as (tree, root, arrays)."""
    pieces: dict = {}

    def run(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=float)
        if not pieces:
            pieces.update(_pieces(nodes))
        codes = coded(np.vstack(vectors.to_numpy()).reshape(len(vectors), len(edges)), edges)
        return pd.Series(added(codes, tops, owners, 0, pieces) * UNIT / len(tops))

    return run


def shares_udf(parts: list, tops: list[Tree], owners: list[np.ndarray], edges: list[list[float]], at_once: int):
    """The same from broadcasts of the parts; each is read for ``at_once`` rows and let go of."""

    def shares(held: list[np.ndarray]) -> pd.Series:
        codes = np.concatenate(held)
        total = np.zeros(len(codes), np.int64)
        for i, part in enumerate(parts):
            total += added(codes, tops, owners, i, _pieces(part.value))
            # Its file stays with the task.
            del part._value
        return pd.Series(total * UNIT / len(tops))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        held: list[np.ndarray] = []
        for vectors in batches:
            x = np.vstack(vectors.to_numpy()) if len(vectors) else np.zeros(0)
            held.append(coded(x.reshape(len(vectors), len(edges)), edges))
            if sum(map(len, held)) >= at_once:
                yield shares(held)
                held = []
        if held:
            yield shares(held)

    return run


PIECES = "part int, slice int, tree int, node int, a binary, b binary, c binary, d binary"


def routed_task(edges: list[list[float]], tops: list[Tree], owners: list[np.ndarray], parts: int, slices: int):
    """Rows packed by the parts in which they end: their numbers and their codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            ids = batch.column("row").to_numpy(zero_copy_only=False)
            codes = coded(batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(n, len(edges)), edges)
            wanted = np.zeros((parts, n), dtype=bool)
            for top, owner in zip(tops, owners):
                if len(owner) == 1:
                    wanted[owner[0]] = True
                else:
                    wanted[owner[ends(codes, top)], np.arange(n)] = True
            slice_ = int(mixed(ids[:1].astype(np.uint64))[0] % np.uint64(slices))
            for part in np.flatnonzero(wanted.any(axis=1)).tolist():
                rows = wanted[part]
                packed = [ids[rows].tobytes(), codes[rows].tobytes(), b"", b""]
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array([v], pa.int32()) for v in (part, slice_, ROWS, 0)], *[pa.array([v], pa.binary()) for v in packed]],
                    ["part", "slice", "tree", "node", "a", "b", "c", "d"],
                )

    return run


def parts_task(width: int, tops: list[Tree], owners: list[np.ndarray]):
    """Units of each row in each part, from the subtrees of a part followed by its rows; one part is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, pieces = None, {}
        for batch in batches:
            for i in range(batch.num_rows):
                part, slice_, tree, node, *arrays = (c[i].as_py() for c in batch.columns)
                if held != (part, slice_):
                    held, pieces = (part, slice_), {}
                if tree != ROWS:
                    nodes = unpacked(arrays)
                    pieces[tree, node] = nodes, units(nodes)
                    continue
                codes = np.frombuffer(arrays[1], np.uint8).reshape(-1, width)
                total = added(codes, tops, owners, part, pieces)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(arrays[0], np.int64)), pa.array(total)], ["row", "units"])

    return run
