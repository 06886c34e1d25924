"""N-gram Jaccard join by chosen paths.

A document is the set of its shingles of five words; documents with equal sets are one class, and
one member stands for it. A set is embedded as 64 min-hashes, whose share of equal places estimates
the Jaccard similarity. One run splits all sets recursively: a node draws some of the places, one
over the threshold on average, and sends every set to a child for the value at each of them, so
that sets above the threshold meet in a child about as often as they part. Nodes of up to ``LIMIT``
sets are compared by brute force. A larger node first compares all its sets with one of them, the
pivot, drawn by a hash of its own for every node. Sets nearly as close to it as the threshold need not go on: what
they are linked to is close to the pivot, too, and all sets not far from it are proposed together. An estimate that is too low
for that in one node is made against other pivots in other nodes and runs. The others are split further. So a
crowd of near copies leaves a node within a few splits instead of being copied from level to level. The more splits a pair has to survive, the more seldom one run brings it
together. The first runs are as many as the target recall asks for a pair that agrees in a threshold's share of its
places and is split ``LEVELS`` times; the sets that still stood in a large node then go through runs with new seeds, until
there are as many as the deepest split that was reached asks for. A node of which the pivot ties a tenth or more does not count
for that: if a share f of a node's sets is tied at every split, and a similar pair as often, one run brings it together with a
probability r = f + (1 - f)(1 - exp(-r)) at any depth, which for a tenth is 0.35, more than the first runs are made for.

A row is moved once per run and path of the first two splits, with a byte per place. A task goes through the whole recursion
below its nodes, level by level for many nodes at once, and gives at most one link per row. Only nodes of more than ``HELD``
sets are split by Spark first: they are found by counts of paths in buckets, exact within the few buckets that are full, so
that no task takes in a node of any size.

Runs only propose which sets belong together. Each proposed group is then compared exactly, all
members with all, in cells of two blocks of bounded size; groups of any size are spread over cells,
and a pair is met in one cell only. No link within a group is dropped, and no list of pairs is
collected.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propensa.llm import repeats as rp
from propensa.llm import textarrays as ta
from propensa.llm.components import components
from propensa.llm.shield import restored, shielded
from propensa.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.999
#: Places of the embedding; an estimate is off by 0.05 in one case of three at the threshold.
PLACES = 64
#: Estimate from which a pair is proposed: four such errors below the threshold.
PROPOSED = THRESHOLD - 0.2
#: Estimate from which a set is let go with its pivot. A partner of it is about as close, and proposed with the same
#: pivot or, where the estimate is too low for that, with that of another node or run.
NEAR_PIVOT = THRESHOLD - 0.1
LIMIT = 64
#: Sets of a node up to which one task goes through everything below it.
HELD = 4096
#: Share of a large node's sets that its pivot has to tie for the node not to count as a split.
TIED = 0.1
#: Splits that the first runs are made for.
LEVELS = 4
BLOCK = 256
SEED = 0x5851F42D4C957F2D


def runs_for(recall: float, levels: int = LEVELS) -> int:
    """Runs after which a pair at the threshold has met with that probability, if it takes ``levels`` splits."""
    met = 1.0
    for _ in range(levels):
        met = 1 - math.exp(-met)
    return math.ceil(math.log(1 - recall) / math.log(1 - met))


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every shingle, each once per text, sorted by text and hash.

    A text of fewer words than ``size``, but not none, is one shingle.
    """
    starts, ends, first = ta.slices(data, offsets, ta.ascii_space())
    values = ta.slice_hashes(data, starts, ends)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    grams = ta.window_hashes(values, size)
    inside = ta.within(first, size)
    n = np.diff(first)
    few = np.flatnonzero((n > 0) & (n < size))
    short = ta.slice_hashes(values, first[few], first[few + 1], rp.SECOND_BASE)
    hashes = np.concatenate([grams[inside], short])
    of = np.concatenate([text[: len(inside)][inside], few])
    order = np.lexsort((hashes, of))
    hashes, of = hashes[order], of[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])
    return hashes[new], of[new]


def sketch_task(size: int):
    """Task code: set hash, set size and embedding of every text."""
    rng = np.random.default_rng(SEED)
    factor = rng.integers(1, 1 << 63, PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in ta.pieces(batch, "text"):
                hashes, of = shingles(*ta.flat(rp.field(piece, "text")), size)
                first = np.searchsorted(of, np.arange(piece.num_rows + 1))
                some = np.flatnonzero(np.diff(first) > 0)
                embedded = np.zeros((piece.num_rows, PLACES), dtype=np.uint16)
                if len(some):
                    for j in range(PLACES):
                        turned = hashes * factor[j]
                        # The smallest of many hashes starts with zeros; only mixed are its first bits those of a hash.
                        embedded[some, j] = ta.mix(np.minimum.reduceat(turned, first[some])) >> np.uint64(48)
                whole = ta.slice_hashes(hashes, first[:-1], first[1:])
                yield pa.RecordBatch.from_arrays(
                    [
                        *(rp.field(piece, c) for c in ("row", "t", "ord")), rp.signed(whole),
                        pa.array(np.diff(first), pa.int64()), binaries(embedded),
                    ],
                    names=["row", "t", "ord", "cid", "size", "sig"],
                )

    return run


def binaries(rows: np.ndarray) -> pa.Array:
    """One binary value per row of a matrix."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    places = (np.arange(len(rows) + 1, dtype=np.int32) * width).tobytes()
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(places), pa.py_buffer(rows.tobytes())])


def embeddings(column: pa.Array) -> np.ndarray:
    """The matrix back from the binary values; 16 bits of a hash are equal by chance once in 65,536 places."""
    body = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint16)
    return body[column.offset * PLACES : (column.offset + len(column)) * PLACES].reshape(-1, PLACES)


def short(sig: np.ndarray) -> np.ndarray:
    """The upper byte of every place, eight in a number; two bytes are equal by chance once in 256 places."""
    return np.ascontiguousarray((sig >> np.uint16(8)).astype(np.uint8)).view(np.uint64)


def shorts(column: pa.Array) -> np.ndarray:
    """The rows of numbers back from the binary values."""
    body = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint64)
    width = PLACES // 8
    return body[column.offset * width : (column.offset + len(column)) * width].reshape(-1, width)


def agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places in which the rows of two arrays of :func:`short` agree."""
    x = a ^ b
    for bits in (4, 2, 1):
        x |= x >> np.uint64(bits)
    return PLACES - np.bitwise_count(x & np.uint64(0x0101010101010101)).sum(axis=1, dtype=np.int64)


def drawn(path: np.ndarray, threshold: float) -> np.ndarray:
    """[node, place]: does the node split by the place? One over the threshold of them, on average."""
    places = (np.arange(PLACES, dtype=np.uint64) + np.uint64(1)) * ta.BASE
    return ta.mix(path[:, None] + places) < np.uint64(int(2.0**64 / (threshold * PLACES)))


def child(path: np.ndarray, place: np.ndarray, value: np.ndarray) -> np.ndarray:
    return ta.mix(path ^ ta.mix(value.astype(np.uint64) << np.uint64(8) | place.astype(np.uint64)))


def children(path: np.ndarray, sig: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, path) of what the rows of :func:`short` that stand in these nodes are sent to."""
    row, place = np.nonzero(drawn(path, threshold))
    return row, child(path[row], place, sig.view(np.uint8)[row, place])


def roots(sig: np.ndarray, first: int, runs: int, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, path) after the first two splits of every run from ``first`` to below ``runs``.

    After one split a node still holds all sets that share a passage, which are seldom similar; so no
    node is looked at before the second.
    """
    seeds = ta.mix(np.arange(first + 1, runs + 1, dtype=np.uint64) * np.uint64(SEED))
    for r, j in zip(*np.nonzero(drawn(seeds, threshold)), strict=True):
        path = child(seeds[r], np.array(j), sig[:, j])
        row, second = np.nonzero(drawn(path, threshold))
        yield row, child(path[row], second, sig[row, second])


def root_task(first: int, runs: int, threshold: float):
    """Task code: every set in the nodes of :func:`roots`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig, cid = embeddings(rp.field(batch, "sig")), rp.numbers(batch, "cid")
            few = short(sig)
            for row, path in roots(sig, first, runs, threshold):
                yield pa.RecordBatch.from_arrays([rp.signed(path), pa.array(cid[row]), binaries(few[row])], names=["path", "cid", "sig"])

    return run


def count_task(first: int, runs: int, threshold: float, buckets: int):
    """Task code: rows of :func:`root_task` by the last bits of their path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            found = [path & np.uint64(buckets - 1) for _, path in roots(embeddings(rp.field(batch, "sig")), first, runs, threshold)]
            held += np.bincount(np.concatenate(found).astype(np.int64), minlength=buckets)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], names=["bucket", "n"])

    return run


def together(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest row that each of n rows is tied to, over the links between rows a and b."""
    label = np.arange(n)
    while len(a):
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Runs of whole groups from batches that are sorted by ``key``; the last group of a batch waits for the next."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        same = np.ones(batch.num_rows - 1, dtype=bool)
        for name in key:
            column = rp.numbers(batch, name)
            same &= column[1:] == column[:-1]
        cuts = np.flatnonzero(~same) + 1
        if rest:
            joins = all(rp.field(rest[-1], k)[-1].as_py() == rp.field(batch, k)[0].as_py() for k in key)
            if not joins:
                yield pa.Table.from_batches(rest)
                rest = []
        if len(cuts):
            rest.append(batch.slice(0, int(cuts[-1])))
            yield pa.Table.from_batches(rest)
            rest = [batch.slice(int(cuts[-1]))]
        else:
            rest.append(batch)
    if rest:
        yield pa.Table.from_batches(rest)


def descent_task(level: int, threshold: float):
    """Task code: the whole recursion below nodes of that level; rows come sorted by node.

    Gives (0, a, b) for two sets that are tied, and (level, a, null) for a set that stood in a large node, not tied by
    its pivot, after so many splits, the most in this node.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["path"]):
            for part in pieces_of(table):
                path, cid = (part.column(c).to_numpy() for c in ("path", "cid"))
                a, b, deep = descent(path.view(np.uint64), cid, shorts(part.column("sig").combine_chunks()), level, threshold)
                label = together(len(cid), a, b)
                tied = np.flatnonzero(label != np.arange(len(cid)))
                left = np.flatnonzero(deep)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([np.zeros(len(tied), np.int32), deep[left]])),
                        pa.array(np.concatenate([cid[tied], cid[left]])),
                        pa.array(np.concatenate([cid[label[tied]], cid[left]])),
                    ],
                    names=["level", "a", "b"],
                )

    return run


def descent(path: np.ndarray, cid: np.ndarray, sig: np.ndarray, level: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, deep): pairs of rows that are tied, and the level of the last large node each row was left in, or 0."""
    ties, deep, row = [], np.zeros(len(cid), dtype=np.int32), np.arange(len(cid))
    while len(row):
        order = np.argsort(path, kind="stable")
        path, row = path[order], row[order]
        starts = np.flatnonzero(np.concatenate([[True], path[1:] != path[:-1]]))
        n = np.diff(np.append(starts, len(path)))
        end = np.repeat(starts + n, n)
        i = np.flatnonzero(np.repeat(n <= LIMIT, n))
        for k in range(1, LIMIT):
            i = i[i + k < end[i]]
            if not len(i):
                break
            near = i[agreeing(sig[row[i]], sig[row[i + k]]) >= PROPOSED * PLACES]
            ties.append((row[near], row[near + k]))
        large = np.flatnonzero(n > LIMIT)
        if not len(large):
            break
        stay = np.repeat(n > LIMIT, n)
        path, row, starts, n = path[stay], row[stay], np.cumsum(n[large]) - n[large], n[large]
        lot = ta.mix(path ^ cid[row].view(np.uint64) * ta.BASE)
        pivot = row[np.flatnonzero(lot == np.repeat(np.minimum.reduceat(lot, starts), n))]
        of = np.repeat(pivot, n)
        alike = agreeing(sig[row], sig[of])
        tied = (alike >= PROPOSED * PLACES) & (row != of)
        ties.append((row[tied], of[tied]))
        if level >= LEVELS:
            deep[row[np.repeat(np.add.reduceat(tied, starts, dtype=np.int64) < TIED * n, n)]] = level
        on = (alike < NEAR_PIVOT * PLACES) & (row != of)
        path, row = path[on], row[on]
        own, path = children(path, sig[row], threshold)
        row = row[own]
        level += 1
    a, b = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (list(zip(*ties, strict=True)) or ([], [])))
    return a, b, deep


def pieces_of(table: pa.Table) -> Iterator[pa.Table]:
    """A table of whole nodes in runs of about 20,000 rows, cut between nodes."""
    path = table.column("path").to_numpy()
    starts = np.append(np.flatnonzero(np.concatenate([[True], path[1:] != path[:-1]])), len(path))
    low = 0
    while low < len(starts) - 1:
        high = max(low + 1, int(np.searchsorted(starts, starts[low] + 20_000, side="right")) - 1)
        yield table.slice(starts[low], starts[high] - starts[low]).combine_chunks()
        low = high


def split_task(threshold: float):
    """Task code: members of nodes of more than ``HELD`` sets against the pivot; the others go on to children of the node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig, pivot = shorts(rp.field(batch, "sig")), short(embeddings(rp.field(batch, "pivot_sig")))
            path, cid, of = (rp.numbers(batch, c) for c in ("path", "cid", "pivot"))
            alike = agreeing(sig, pivot)
            near = np.flatnonzero((alike >= PROPOSED * PLACES) & (cid != of))
            on = np.flatnonzero((alike < NEAR_PIVOT * PLACES) & (cid != of))
            row, below = children(path[on].view(np.uint64), sig[on], threshold)
            both = np.concatenate([near, on[row]])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([np.ones(len(near), bool), np.zeros(len(row), bool)])),
                    pa.array(np.concatenate([of[near], below.view(np.int64)])),
                    pa.array(cid[both]), pa.array(path[both]), binaries(sig[both]),
                ],
                names=["link", "path", "cid", "node", "sig"],
            )

    return run


def proposed(reps: DataFrame, threshold: float, recall: float) -> DataFrame:
    """Links (a, b) between class ids that are to be looked at together."""
    links, sets, done, need = [], reps.select("cid", "sig"), 0, runs_for(recall)
    while done < need:
        levels, crowded, found = descended(sets, reps, done, need, threshold)
        links += found
        if not done and crowded:
            # A pair is split more than LEVELS times only while both of its sets stand in large nodes.
            deep = cut_lineage(united(crowded).distinct(), "crowded")
            sets = cut_lineage(reps.select("cid", "sig").join(rp.apart(deep), "cid", "left_semi"), "crowded-sets")
        # One level more than was reached, as new runs may go a little deeper.
        done, need = need, need if runs_for(recall, max(levels, LEVELS)) <= need else runs_for(recall, levels + 1)
    return united(links)


def united(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def large_nodes(rows: DataFrame, reps: DataFrame) -> DataFrame | None:
    """(path, n, pivot, pivot_sig) of the nodes of more than ``HELD`` rows, if there are any."""
    # A lot that its owner can be told from, so that numbers alone are aggregated.
    turn = F.xxhash64("path")
    nodes = (
        rows.groupBy("path").agg(F.count("*").alias("n"), F.min(F.col("cid").bitwiseXOR(turn)).alias("lot"))
        .where(F.col("n") > HELD).select("path", "n", F.col("lot").bitwiseXOR(turn).alias("pivot"))
    )
    sigs = reps.select(F.col("cid").alias("pivot"), F.col("sig").alias("pivot_sig"))
    found = cut_lineage(nodes.join(sigs, "pivot"), "large")
    return None if found.isEmpty() else found


def large_roots(sets: DataFrame, reps: DataFrame, rows: DataFrame, first: int, runs: int, threshold: float) -> DataFrame | None:
    """:func:`large_nodes` of the ``rows`` of :func:`root_task`; only those in full buckets are counted one by one."""
    each = (runs - first) / threshold**2
    buckets = 1 << max(10, math.ceil(math.log2(max(1, sets.count()) * each * 8 / HELD)))
    counts = sets.select("sig").mapInArrow(count_task(first, runs, threshold, buckets), "bucket bigint, n bigint")
    full = cut_lineage(counts.groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") > HELD).select("bucket"), "full")
    if full.isEmpty():
        return None
    bucket = F.col("path").bitwiseAND(F.lit(buckets - 1).cast("bigint"))
    return large_nodes(rows.select("path", "cid", bucket.alias("bucket")).join(rp.apart(full), "bucket", "left_semi"), reps)


def descended(
    sets: DataFrame, reps: DataFrame, first: int, runs: int, threshold: float
) -> tuple[int, list[DataFrame], list[DataFrame]]:
    """(splits of large nodes that their pivot did not tie, the sets in them after ``LEVELS``, links) of the runs ``first`` to below ``runs``."""
    rows = sets.select("cid", "sig").mapInArrow(root_task(first, runs, threshold), "path bigint, cid bigint, sig binary")
    large, level, deepest, links, crowded = large_roots(sets, reps, rows, first, runs, threshold), 2, 2, [], []
    while True:
        held = rows if large is None else rows.join(rp.apart(large.select("path")), "path", "left_anti")
        ordered = held.repartition("path").sortWithinPartitions("path")
        found = cut_lineage(ordered.mapInArrow(descent_task(level, threshold), "level int, a bigint, b bigint"), "links")
        links.append(found.where("level = 0").select("a", "b"))
        deep = found.where("level > 0")
        if (most := deep.agg(F.max("level")).first()[0]) is not None:
            deepest = max(deepest, most)
            crowded.append(deep.select(F.col("a").alias("cid")))
        if large is None:
            return deepest, [united(crowded).distinct()] if crowded else [], links
        split = cut_lineage(
            rows.join(rp.apart(large), "path").select("path", "cid", "sig", "pivot", "pivot_sig")
            .mapInArrow(split_task(threshold), "link boolean, path bigint, cid bigint, node bigint, sig binary"),
            "split",
        )
        links.append(split.where("link").select(F.col("path").alias("a"), F.col("cid").alias("b")))
        if level >= LEVELS:
            tied = split.where("link").groupBy(F.col("node").alias("path")).agg(F.count("*").alias("tied"))
            few = large.join(tied, "path", "left").where(F.coalesce("tied", F.lit(0)) < TIED * F.col("n")).select("path")
            left = cut_lineage(rows.select("path", "cid").join(rp.apart(few), "path", "left_semi").select("cid").distinct(), "crowded")
            if not left.isEmpty():
                deepest = max(deepest, level)
                crowded.append(left)
        rows = split.where("not link").select("path", "cid", "sig")
        large = large_nodes(rows, reps)
        level += 1


def cells_task(size: int, threshold: float):
    """Task code: exact similarity of all pairs of a cell; rows come sorted by cell.

    Gives (cid, root, partners): the ids of the classes linked to this one in the cell, and the
    smallest class it is tied to.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["comp", "low", "high"]):
            comp, low, high = (table.column(c).to_numpy() for c in ("comp", "low", "high"))
            new = np.ones(len(comp), dtype=bool)
            new[1:] = (comp[1:] != comp[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
            starts = np.append(np.flatnonzero(new), len(comp))
            for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                yield cell(table.slice(s, e - s).combine_chunks())

    def cell(part: pa.Table) -> pa.RecordBatch:
        hashes, of = shingles(*ta.flat(part.column("text")), size)
        cid, rep, block = (part.column(c).to_numpy(zero_copy_only=False) for c in ("cid", "rep", "block"))
        low, high = part.column("low")[0].as_py(), part.column("high")[0].as_py()
        n = len(cid)
        count = np.bincount(of, minlength=n)
        # Shingles of one member alone are in no intersection.
        _, which, times = np.unique(hashes, return_inverse=True, return_counts=True)
        shared = times[which] > 1
        number, member = (np.cumsum(times > 1) - 1)[which[shared]], of[shared]
        order = np.argsort(number, kind="stable")
        number, member = number[order], member[order]
        common = np.zeros((n, n), dtype=np.float32)
        width = 4096
        total = int(number[-1]) + 1 if len(number) else 0
        for at in range(0, total, width):
            a, b = np.searchsorted(number, [at, at + width])
            part_of = np.zeros((n, min(width, total - at)), dtype=np.float32)
            part_of[member[a:b], number[a:b] - at] = 1
            common += part_of @ part_of.T
        union = count[:, None] + count[None, :] - common
        # Whole numbers below 2^24, so the comparison is exact up to the product with the threshold.
        linked = common >= threshold * union - 1e-6
        np.fill_diagonal(linked, False)
        if low != high:
            linked &= block[:, None] != block[None, :]
        a, b = np.nonzero(linked)
        label = together(n, a, b)
        places = np.searchsorted(a, np.arange(n + 1)).astype(np.int32)
        partners = pa.ListArray.from_arrays(pa.array(places), pa.array(rep[b], pa.int64(), from_pandas=True))
        return pa.RecordBatch.from_arrays(
            [pa.array(cid, pa.int64()), pa.array(cid[label], pa.int64()), partners], names=["cid", "root", "partners"]
        ).filter(pa.array(np.diff(places) > 0))

    return run


def marked(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``docs`` with what tells its rows apart: row_ (the id, or a hash of the text), t_ (31 bits of that hash), ord_."""
    whole = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    own = F.col(key).cast("bigint")
    return docs.withColumns({
        "t_": whole.bitwiseAND(F.lit(0x7FFFFFFF).cast("bigint")),
        "row_": F.coalesce(own, whole),
        "ord_": F.coalesce(own, F.lit(rp.LAST)),
    })


def classes(docs: DataFrame, key: str, text: str, threshold: float, size: int, recall: float) -> tuple[DataFrame, DataFrame]:
    """(rows, sets): rows with row, t, ord, cid and size; sets with cid, rep, root, least, links and n_links."""
    rows = marked(docs.select(F.col(key).alias("id"), F.col(text).alias("text")), "id", "text").select(
        "text", F.col("t_").alias("t"), F.col("row_").alias("row"), F.col("ord_").alias("ord")
    )
    sketches = cut_lineage(
        rows.select("row", "t", "ord", "text").mapInArrow(
            sketch_task(size), "row bigint, t bigint, ord bigint, cid bigint, size bigint, sig binary"
        ),
        "sketches",
    )
    named = sketches.where("size > 0")
    reps = cut_lineage(
        named.groupBy("cid").agg(F.min("ord").alias("rep"), F.first("sig").alias("sig"), F.min(F.struct("ord", "row", "t")).alias("who")),
        "sets",
    )
    near = components(proposed(reps, threshold, recall))
    near = near.unionByName(near.select(F.col("root").alias("v"), "root").distinct())
    sizes = near.groupBy("root").agg(F.count("*").alias("n")).select("root", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    members = (
        near.join(rp.apart(sizes), "root").join(reps.select("cid", "rep", "who"), F.col("v") == F.col("cid"))
        .select(
            F.col("who.row").alias("row"), F.col("who.t").alias("t"), "cid", F.col("root").alias("comp"),
            F.when(F.col("rep") < rp.LAST, F.col("rep")).alias("rep"), "blocks",
            F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int").alias("block"),
        )
    )
    # Repetitions of a row are one member.
    texts = rows.select("row", "t", "text").join(members.hint("shuffle_hash"), ["row", "t"])
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    cells = (
        texts.select("cid", "comp", "rep", "block", "text", other.alias("other"))
        .select(
            "cid", "comp", "rep", "block", "text", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")
        )
        .repartition("comp", "low", "high").sortWithinPartitions("comp", "low", "high", "cid")
    )
    compared = cut_lineage(
        cells.mapInArrow(unique_members(cells_task(size, threshold)), "cid bigint, root bigint, partners array<bigint>"), "links"
    )
    partners = compared.groupBy("cid").agg(F.sort_array(F.flatten(F.collect_list("partners"))).alias("links"))
    tied = components(compared.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    lowest = (
        reps.select("cid", "rep").join(tied, F.col("cid") == F.col("v"), "left")
        .select("cid", "rep", F.coalesce("root", "cid").alias("root"))
    )
    first = lowest.groupBy("root").agg(F.min("rep").alias("least"))
    sets = lowest.join(rp.apart(first), "root").join(partners, "cid", "left").withColumn(
        "n_links", F.coalesce(F.size("links"), F.lit(0)).cast("bigint")
    )
    return sketches.drop("sig"), sets


def jaccard_join(
    docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, size: int = SHINGLE, recall: float = RECALL
) -> DataFrame:
    """One row per document: key, class_id, copy_of, n_links, links.

    ``copy_of`` is the smallest id with the same set of shingles, ``class_id`` the smallest id of all
    documents tied to this one by links (similarity of ``threshold`` or more) or equal sets. ``n_links``
    counts the other sets that this one is linked to; on the row with the smallest id of its set, ``links``
    lists their smallest ids, and other copies refer to that row. A text of fewer than ``size`` words is one
    shingle; a text without words, or null, is linked to nothing and a class of its own. Rows without id take
    part; among themselves they have no id to name, so theirs are null where no member has one.
    """
    ids, sets = classes(docs, key, text, threshold, size, recall)
    own = F.when(F.col("ord") < rp.LAST, F.col("ord"))
    none = F.array().cast("array<bigint>")

    def name(c: str):
        return F.when(F.col(c) < rp.LAST, F.col(c))

    listed = F.when((F.col("ord") == F.col("rep")) & F.col("links").isNotNull(), F.col("links")).otherwise(none)
    with_words = ids.where("size > 0").join(sets, "cid").select(
        own.alias(key), name("least").alias("class_id"), name("rep").alias("copy_of"), "n_links", listed.alias("links")
    )
    plain = ids.where("size = 0").select(
        own.alias(key), own.alias("class_id"), own.alias("copy_of"), F.lit(0).cast("bigint").alias("n_links"), none.alias("links")
    )
    return with_words.unionByName(plain)


def one_of_each(
    docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, size: int = SHINGLE, recall: float = RECALL
) -> DataFrame:
    """``docs`` with one row of every class: the one with the smallest id, and of repetitions of a row one.

    Texts without words all stay, but for repetitions of the same row.
    """
    given, names = shielded(docs)
    ids, sets = classes(docs, key, text, threshold, size, recall)
    place = F.struct("ord", "row", "t")
    chosen = ids.where("size > 0").join(sets.select("cid", "root"), "cid").groupBy("root").agg(F.min(place).alias("p"))
    kept = chosen.select("p.row", "p.t").unionByName(ids.where("size = 0").select("row", "t").distinct())
    often = ids.groupBy("row", "t").agg(F.count("*").alias("times"))
    kept = kept.join(often, ["row", "t"]).select(
        F.col("row").alias("kept_row"), F.col("t").alias("kept_t"), (F.col("times") > 1).alias("repeated_")
    )
    found = marked(given, names[key], names[text]).join(
        kept.hint("shuffle_hash"), (F.col("row_") == F.col("kept_row")) & (F.col("t_") == F.col("kept_t"))
    )
    single = restored(found.where("not repeated_"), names)
    return single.unionByName(restored(found.where("repeated_").dropDuplicates(["row_", "t_"]), names))


def unique_members(task):
    """Drop repeated rows of a cell, which come one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def once() -> Iterator[pa.RecordBatch]:
            last = None
            names = ("comp", "low", "high", "cid")
            for batch in batches:
                if batch.num_rows:
                    columns = [rp.numbers(batch, c) for c in names]
                    keep = np.zeros(batch.num_rows, dtype=bool)
                    for c in columns:
                        keep[1:] |= c[1:] != c[:-1]
                    keep[0] = last != tuple(c[0] for c in columns)
                    last = tuple(c[-1] for c in columns)
                    yield batch.filter(pa.array(keep))

        yield from task(once())

    return run
