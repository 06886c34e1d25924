"""Prefix trie of sequences by van Emde Boas recursion, and the trie of conversations.

A trie of height 2m is cut at depth m: the upper trie holds the first m items of every sequence, each
of its deepest nodes is the root of a lower trie with the next m items. Both kinds of halves are pieces
of one table and are cut again in one job, so a trie of height h needs log2(h) rounds.
Equal pieces below the same root become one row with their number of sequences and the smallest of
them, so a beginning that many sequences share is carried on once.

A piece never becomes an array: its items stay rows of their own, so one sequence may hold any share of
all items. Cut prefixes get a name of 128 bits, the exclusive or of hashes of (position, item) over all
items before the cut; being associative it is summed up before any shuffle, and the name of a node is
the name of its piece's root combined with the piece's own.

Totals go up in two sweeps over the same cuts: first every cut node learns the total of the tries below
it, from small to large; then the totals are grafted onto the nodes above the cut, from large to small,
a span of 2m nodes above a cut being its lower m nodes and the upper m nodes above its middle.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from propensa.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Member ids are joined to texts of this many ids; a text is the largest value that a task holds.
IDS_PER_TEXT = 4_096
#: Fixed values of the conversations' rebuilding rule.
FAMILY, HEADS = 5, 9

_KEY = ["depth", "a", "b"]


# ---- positions of the items of sequences


def numbering_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``local``, the place of a row among its sequence's rows in this partition."""
    last, seen = None, 0
    for batch in batches:
        ids = batch.column("seq").to_numpy(zero_copy_only=False)
        if not len(ids):
            continue
        new = np.flatnonzero(np.concatenate(([last is None or ids[0] != last], ids[1:] != ids[:-1])))
        starts = np.concatenate(([0], new)) if not len(new) or new[0] else new
        run = np.searchsorted(starts, np.arange(len(ids)), "right") - 1
        local = np.arange(len(ids)) - starts[run]
        if len(new) == 0 or new[0] != 0:
            local[run == 0] += seen
        last, seen = ids[-1], int(local[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(local, pa.int64())], [*batch.schema.names, "local"])


def numbered(items: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``pos``, the place of an item in its sequence ``seq`` (from 0), in the given order.

    The items are dealt by range, so a sequence may span any number of tasks. Only sequences that begin
    a partition can have rows in earlier ones: at most one per partition, whose offsets are broadcast.
    """
    dealt = items.repartitionByRange("seq", *order).sortWithinPartitions("seq", *order)
    typed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields)
    rows = cut_lineage(
        dealt.withColumn("part", F.spark_partition_id()).mapInArrow(numbering_task, f"{typed}, part int, local bigint"),
        "numbered",
    )
    heads = rows.groupBy("part").agg(F.min("seq").alias("seq")).select("seq").distinct()
    counts = rows.join(F.broadcast(heads), "seq", "left_semi").groupBy("seq", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("seq").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("seq", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    offsets = cut_lineage(offsets.where("before > 0"), "offsets")
    out = rows.join(F.broadcast(offsets), ["seq", "part"], "left")
    return out.select(*items.columns, (F.col("local") + F.coalesce("before", F.lit(0))).alias("pos"))


# ---- the recursion


def _xor(*columns: str | Column) -> Column:
    first, *rest = [F.col(c) if isinstance(c, str) else c for c in columns]
    for c in rest:
        first = first.bitwiseXOR(c)
    return first


def _due(length: Column, span: int) -> Column:
    """The cut that a piece made in a trie of height ``span`` meets next: at half its height, or later if it is shorter."""
    largest = F.pow(F.lit(2.0), F.length(F.bin(length)) - 1).cast("bigint")
    return F.when(length == span, F.lit(span // 2).cast("bigint")).otherwise(largest)


class _Pieces:
    """Stored pieces and items by the cut at which they are due."""

    def __init__(self):
        self.pieces: list[DataFrame] = []
        self.items: list[DataFrame] = []

    @staticmethod
    def _at(tables: list[DataFrame], m: int) -> DataFrame:
        out = tables[0].where(F.col("due") == m)
        for t in tables[1:]:
            out = out.unionByName(t.where(F.col("due") == m))
        return out

    def at(self, m: int) -> tuple[DataFrame, DataFrame]:
        return self._at(self.pieces, m), self._at(self.items, m)


def _cut(pieces: DataFrame, items: DataFrame, m: int) -> tuple[DataFrame, DataFrame]:
    """Halves of the pieces due at ``m``, and the items of those that stand for their equals.

    A piece is (base, p, ra, rb, xa, xb, n, stop): it holds the items base…stop-1 of the sequence ``p``, the
    smallest of its ``n`` sequences; r is the name of its root, x that of its content.
    """
    base = F.col("pos") - F.col("pos") % (2 * m)
    upper = (
        items.withColumn("base", base)
        .where((F.col("pos") < F.col("base") + m) & (F.col("stop") > F.col("base") + m))
        .groupBy("base", "p")
        .agg(F.bit_xor("ha").alias("ua"), F.bit_xor("hb").alias("ub"))
    )
    # A piece of height m is all upper half.
    split = pieces.join(upper, ["base", "p"], "left").withColumns({
        "ua": F.coalesce("ua", "xa"), "ub": F.coalesce("ub", "xb")
    })
    middle = F.col("base") + m
    halves = F.array(
        F.struct("base", "ra", "rb", F.col("ua").alias("xa"), F.col("ub").alias("xb"), middle.alias("stop")),
        F.when(
            F.col("stop") > middle,
            F.struct(
                middle.alias("base"), _xor("ra", "ua").alias("ra"), _xor("rb", "ub").alias("rb"),
                _xor("xa", "ua").alias("xa"), _xor("xb", "ub").alias("xb"), F.col("stop"),
            ),
        ),
    )
    key = ["base", "ra", "rb", "xa", "xb", "stop"]
    made = (
        split.select("p", "n", F.explode(halves).alias("h")).where(F.col("h").isNotNull()).select("p", "n", "h.*")
        .groupBy(*key).agg(F.min("p").alias("p"), F.sum("n").alias("n"))
        .withColumn("due", _due(F.col("stop") - F.col("base"), m))
    )
    made = cut_lineage(made, f"pieces-{m}")
    low = F.col("pos") - F.col("pos") % m
    highest = low + m
    moved = items.withColumns({"base": low, "stop": F.least(F.col("stop"), highest)})
    moved = moved.withColumn("due", _due(F.col("stop") - F.col("base"), m))
    stand = made.select("base", "p")
    return made, cut_lineage(moved.join(stand, ["base", "p"], "left_semi").drop("base"), f"items-{m}")


def _sums(table: DataFrame) -> DataFrame:
    return table.groupBy(*_KEY).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def prefix_trie(items: DataFrame, sequences: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All nodes of the trie of the given sequences, and the node at which each sequence ends.

    ``items`` (seq long, pos long from 0 without gaps, name binary, weight long): a sequence's items; equal
    names are equal items. ``sequences`` (seq long, length long): every sequence once, also empty ones.
    The first table holds per node (depth, a, b: its name), conv_id (smallest member), parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens; the second (seq, depth, a, b). Without sequences there is no node, not even the root.
    """
    hashes = [F.xxhash64(F.lit(salt), "pos", "name").alias(name) for salt, name in ((11, "ha"), (23, "hb"))]
    hashed = cut_lineage(items.select("seq", "pos", *hashes, "weight"), "items")
    digests = hashed.groupBy("seq").agg(F.bit_xor("ha").alias("a"), F.bit_xor("hb").alias("b"))
    ends = cut_lineage(
        sequences.join(digests, "seq", "left").select(
            "seq", F.col("length").alias("depth"), F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b")
        ),
        "ends",
    )
    whole = ends.agg(F.max("depth").alias("d"), F.min("seq").alias("first"), F.count("*").alias("n")).first()
    top = 2
    while top < (whole["d"] or 0):
        top *= 2

    zero = F.lit(0).cast("bigint")
    pieces = (
        ends.where(F.col("depth") > 0).groupBy(*_KEY).agg(F.min("seq").alias("p"), F.count("*").alias("n"))
        .select(
            zero.alias("base"), zero.alias("ra"), zero.alias("rb"), F.col("a").alias("xa"), F.col("b").alias("xb"),
            F.col("depth").alias("stop"), "p", "n",
        )
        .withColumn("due", _due(F.col("stop"), top))
    )
    pool = _Pieces()
    pool.pieces.append(cut_lineage(pieces, "pieces"))
    started = hashed.withColumnRenamed("seq", "p").join(pool.pieces[0].select("p", "stop"), "p")
    pool.items.append(cut_lineage(started.withColumn("due", _due(F.col("stop"), top)), "items-whole"))
    # Whole spans by height: a node, and its ancestor one span above. The last ones are all nodes and their parents.
    spans: dict[int, DataFrame] = {}
    m = top // 2
    while m:
        made, moved = _cut(*pool.at(m), m)
        pool.pieces.append(made)
        pool.items.append(moved)
        spans[m] = made.where(F.col("stop") - F.col("base") == m).select(
            "base", "ra", "rb", F.col("stop").alias("depth"), _xor("ra", "xa").alias("a"), _xor("rb", "xb").alias("b"),
            "p", "n",
        )
        m //= 2

    own = moved.select((F.col("pos") + 1).alias("depth"), "p", "weight")
    found = spans[1].join(own, ["depth", "p"])
    # The smallest member by parent; the root, which may have most children, is known already.
    children = found.groupBy(F.col("base").alias("depth"), F.col("ra").alias("a"), F.col("rb").alias("b")).agg(
        F.count("*").alias("n_children")
    )
    nodes = cut_lineage(
        found.join(children, _KEY, "left").select(
            *_KEY, "base", "ra", "rb", F.col("p").alias("conv_id"), F.col("n").alias("n_convs"),
            F.coalesce("n_children", F.lit(0)).alias("n_children"),
            F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("bigint").alias("leaves"),
            ((F.col("n") - 1) * F.col("weight")).alias("saved"),
        ),
        "nodes",
    )
    grafted = _totals(nodes, spans, top)
    total = grafted["root"]
    named = nodes.select("depth", F.col("a").alias("ra"), F.col("b").alias("rb"), F.col("conv_id").alias("parent"))
    below = nodes.join(grafted["above"].toDF(*_KEY, "more_leaves", "more_saved"), _KEY, "left")
    deep = below.where(F.col("depth") > 1).join(
        named.withColumnRenamed("depth", "base"), ["base", "ra", "rb"]
    )
    first = F.lit(whole["first"]).cast("bigint")
    flat = below.where(F.col("depth") == 1).withColumn("parent", first)
    out = deep.unionByName(flat).select(
        *_KEY, "conv_id", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children",
        (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"),
        (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved_tokens"),
    )
    root = children.where(F.col("depth") == 0).agg(F.coalesce(F.sum("n_children"), F.lit(0)).alias("n_children"))
    sums = total.agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    # One row each, so that this is no join of rows.
    root = root.select(
        *[zero.alias(k) for k in _KEY], first.alias("conv_id"), F.lit(None).cast("bigint").alias("parent_conv_id"),
        F.lit(whole["n"]).cast("bigint").alias("n_convs"), "n_children",
        F.coalesce(sums.select("leaves").scalar(), F.lit(1)).cast("bigint").alias("n_leaves"),
        F.coalesce(sums.select("saved").scalar(), F.lit(0)).cast("bigint").alias("saved_tokens"),
    ).where(F.lit(whole["n"]) > 0)
    return out.unionByName(root), ends


def _totals(nodes: DataFrame, spans: dict[int, DataFrame], top: int) -> dict[str, DataFrame]:
    """Totals of all nodes below each node (``above``: what the node itself has is left out), and of the whole trie."""
    totals = {1: cut_lineage(_sums(nodes.select(
        F.col("base").alias("depth"), F.col("ra").alias("a"), F.col("rb").alias("b"), "leaves", "saved"
    )), "totals-1")}
    up = F.struct(F.col("base").alias("depth"), F.col("ra").alias("a"), F.col("rb").alias("b")).alias("up")
    s = 1
    while s < top:
        # The tries below a cut node count for the root of the upper trie too.
        low = spans[s].where(F.col("base") % (2 * s) == 0).select(*_KEY, up)
        lifted = totals[s].join(low, _KEY).select("up.*", "leaves", "saved")
        kept = totals[s].where(F.col("depth") % (2 * s) == 0)
        totals[2 * s] = cut_lineage(_sums(kept.unionByName(lifted)), f"totals-{2 * s}")
        s *= 2
    waiting = None
    while s > 1:
        s //= 2
        # The total below a cut goes to the whole span of nodes above it.
        parts = totals[s].where(F.col("depth") % (2 * s) == s)
        if waiting is not None:
            low = spans[s].where(F.col("base") % (2 * s) == s).select(*_KEY, up)
            parts = parts.unionByName(waiting).unionByName(
                waiting.join(low, _KEY).select("up.*", "leaves", "saved")
            )
        waiting = cut_lineage(_sums(parts), f"grafts-{s}")
    return {"above": waiting, "root": totals[top].where(F.col("depth") == 0)}


# ---- digests of members


def texts_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of sorted rows as comma-joined texts, at most IDS_PER_TEXT ids each."""
    at: tuple | None = None
    ids: list[int] = []
    out: dict[str, list] = {k: [] for k in [*_KEY, "first", "ids"]}

    def close():
        if ids:
            for k, v in zip(out, [*at, ids[0], ",".join(map(str, ids))]):
                out[k].append(v)
            ids.clear()

    def batch_out():
        made = pa.RecordBatch.from_arrays(
            [*[pa.array(out[k], pa.int64()) for k in [*_KEY, "first"]], pa.array(out["ids"], pa.string())], [*out]
        )
        for v in out.values():
            v.clear()
        return made

    for batch in batches:
        rows = zip(*(batch.column(k).to_pylist() for k in [*_KEY, "seq"]))
        for d, a, b, seq in rows:
            if (d, a, b) != at or len(ids) == IDS_PER_TEXT:
                close()
                at = (d, a, b)
            ids.append(seq)
        if len(out["ids"]) > 1_000:
            yield batch_out()
    close()
    if out["ids"]:
        yield batch_out()


def digest_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the joined texts of each node, one text at a time."""
    at, state = None, None
    for batch in batches:
        out: dict[str, list] = {k: [] for k in [*_KEY, "sha"]}

        def close():
            if at is not None:
                for k, v in zip(out, [*at, state.hexdigest()]):
                    out[k].append(v)

        for *key, ids in zip(*(batch.column(k).to_pylist() for k in [*_KEY, "ids"])):
            if key != at:
                close()
                at, state = key, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield _digests(out)
    if at is not None:
        yield _digests({k: [v] for k, v in zip([*_KEY, "sha"], [*at, state.hexdigest()])})


def _digests(out: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [*[pa.array(out[k], pa.int64()) for k in _KEY], pa.array(out["sha"], pa.string())], [*out]
    )


def member_digests(ends: DataFrame) -> DataFrame:
    """(depth, a, b, sha): the SHA-256 of the ascending, comma-joined ids ``seq`` of each node.

    Ids are dealt by range and joined to texts of bounded length first, so a node with most of the ids
    is read as few rows, one text at a time.
    """
    texts = (
        ends.repartitionByRange(*_KEY, "seq").sortWithinPartitions(*_KEY, "seq")
        .mapInArrow(texts_task, "depth bigint, a bigint, b bigint, first bigint, ids string")
    )
    return (
        texts.repartition(*_KEY).sortWithinPartitions(*_KEY, "first")
        .mapInArrow(digest_task, "depth bigint, a bigint, b bigint, sha string")
    )


# ---- conversations


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items and sequences of all rebuilt conversations of (conv_id, turn, role, text).

    Conversation c becomes the first h turns of conversation c - c % 5 and its own turns after its
    first h, where h is the unsigned CRC-32 of c in decimal, modulo 9.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    name = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    known = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("seq"), "turn", name.alias("name"),
        F.octet_length(text).cast("bigint").alias("weight"),
    )
    placed = numbered(known, ["turn", "name", "weight"]).drop("turn")
    placed = cut_lineage(placed, "turns")
    convs = placed.groupBy("seq").agg(F.count("*").alias("own"))
    h = F.pmod(F.crc32(F.col("seq").cast("string").cast("binary")), F.lit(HEADS)).cast("bigint")
    base = F.col("seq") - F.col("seq") % FAMILY
    lengths = convs.select(F.col("seq").alias("base"), F.col("own").alias("offered"))
    plan = cut_lineage(
        convs.withColumns({"h": h, "base": base}).join(lengths, "base", "left")
        .withColumn("taken", F.least("h", F.coalesce("offered", F.lit(0).cast("bigint"))))
        .withColumn("kept", F.greatest(F.col("own") - F.col("h"), F.lit(0)))
        .select("seq", "base", "h", "taken", (F.col("taken") + F.col("kept")).alias("length")),
        "plan",
    )
    heads = placed.where(F.col("pos") < HEADS - 1).withColumnRenamed("seq", "base")
    borrowed = plan.where("taken > 0").select("seq", "base", "taken").join(heads, "base").where("pos < taken")
    after = placed.where(F.col("pos") >= h)
    # Own turns move up only where the other conversation was too short.
    short = plan.where("taken < h").select("seq", (F.col("h") - F.col("taken")).alias("gap"))
    rest = after.join(short, "seq", "left").withColumn("pos", F.col("pos") - F.coalesce("gap", F.lit(0)))
    fields = ["seq", "pos", "name", "weight"]
    return borrowed.select(*fields).unionByName(rest.select(*fields)), plan.select("seq", "length")


def conversation_trie(turns: DataFrame) -> DataFrame:
    """Nodes of the trie of the rebuilt conversations, with totals and digests.

    ``turns`` holds conv_id, turn, role and text; other columns play no part. Turns are ordered by turn,
    null first, equal ones by a digest of role and text; null roles and texts are empty; repeated rows are
    repeated turns; rows without conv_id belong to no conversation. An empty table has no node.
    Returns conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    items, sequences = rebuilt(turns)
    items = cut_lineage(items, "rebuilt")
    nodes, ends = prefix_trie(items, sequences)
    digests = member_digests(ends)
    nothing = hashlib.sha256(b"").hexdigest()
    return nodes.join(digests, _KEY, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("sha", F.lit(nothing)).alias("ends_sha256"),
    )


#: The CRC-32 of an id's digits, bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
  lambda acc, byte: list_reduce(list_prepend(xor(acc, byte), range(8)),
    lambda r, i: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384::BIGINT) ELSE r >> 1 END)), 4294967295::BIGINT)"""

#: What :func:`conversation_trie` returns, over the stored conversations.
ORACLE = f"""
WITH turns AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (
    PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, c - c % 5 AS base, {_CRC} % 9 AS h FROM (SELECT DISTINCT c FROM turns)),
parts AS (
  SELECT k.c, 0 AS part, t.pos, t.role, t.text FROM convs k JOIN turns t ON t.c = k.base AND t.pos < k.h
  UNION ALL SELECT k.c, 1, t.pos, t.role, t.text FROM convs k JOIN turns t ON t.c = k.c AND t.pos >= k.h),
seqs AS (
  SELECT k.c, coalesce(list(sha256(octet_length(encode(p.role)) || ':' || p.role || p.text) ORDER BY part, pos)
      FILTER (p.c IS NOT NULL), []) AS items,
    coalesce(list(octet_length(encode(p.text)) ORDER BY part, pos) FILTER (p.c IS NOT NULL), []) AS sizes
  FROM convs k LEFT JOIN parts p ON p.c = k.c GROUP BY k.c),
prefixes AS (
  SELECT c, d, array_to_string(items[1:d], ',') AS path, array_to_string(items[1:d-1], ',') AS up,
    CASE WHEN d = 0 THEN 0 ELSE sizes[d] END AS size, len(items) AS length
  FROM (SELECT *, unnest(range(len(items) + 1)) AS d FROM seqs)),
nodes AS MATERIALIZED (
  SELECT d, path, min(up) AS up, min(c) AS conv_id, count(*) AS n, (count(*) - 1) * min(size) AS saved,
    sha256(coalesce(string_agg(CASE WHEN length = d THEN c::VARCHAR END, ',' ORDER BY c), '')) AS ends
  FROM prefixes GROUP BY d, path),
kids AS (SELECT d - 1 AS d, up AS path, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1, 2),
full_nodes AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k USING (d, path)),
below AS (
  SELECT a.d, a.path, count(*) FILTER (b.n_children = 0) AS n_leaves, sum(b.saved) AS saved_tokens
  FROM nodes a JOIN full_nodes b ON b.d >= a.d AND (a.d = 0 OR b.path = a.path OR starts_with(b.path, a.path || ','))
  GROUP BY 1, 2)
SELECT f.conv_id, f.d::BIGINT AS depth, p.conv_id AS parent_conv_id, f.n AS n_convs, f.n_children::BIGINT AS n_children,
  b.n_leaves, b.saved_tokens::BIGINT AS saved_tokens, f.ends AS ends_sha256
FROM full_nodes f JOIN below b USING (d, path) LEFT JOIN nodes p ON f.d > 0 AND p.d = f.d - 1 AND p.path = f.up"""
