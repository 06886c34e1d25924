"""Suffix-array dedup: exact byte strings of 100 bytes or more that occur earlier are removed.

A suffix is sorted together with its neighbours: every window of 100 bytes has an anchor, the gram
in it with the smallest hash, and consecutive windows with one anchor are a run (see
:mod:`repeats`). Equal windows have the same anchor, so runs are sorted by their anchor as leading
token, in two rounds:

1. Runs are range-partitioned by (anchor, 96-bit digest of the whole run, document, start), with splitters
   that Spark draws from a sample. In a bucket, a run equal to an earlier one in anchor, digest and length
   consists of windows that occur earlier. Of the others, those go on whose anchor also begins a different run.
2. These runs are range-partitioned by (anchor, salt), with their bytes; an anchor with more than
   ``ANCHOR_RUNS`` of them has several salts. Its runs are cut by how far a window begins before the anchor,
   which is the same for equal windows, and only beyond that dealt out by document and start. A bucket sorts all windows of its runs by multikey quicksort over symbols of eight bytes: windows are split by one
   symbol, and only those still equal go on to the next. Equal windows then stand together, the
   earliest first, and the others are removed.

Document and start in the first key, and the salt in the second, spread a string that occurs very
often over many buckets, so the same window may be met in several. In round 1 the runs at both
ends of a bucket go on whatever they are. In round 2 a bucket also reports the different windows of
anchors that were dealt out; these are compared across the boundaries by digest, and have as many
rows for a digest as buckets hold it.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from propensa.llm import repeats as rp
from propensa.llm import textarrays as ta

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WIDTH = 100
GRAM = 16
SPAN = "array<struct<start: bigint, end: bigint>>"
RUNS = "anchor bigint, d1 bigint, d2 int, row bigint, t int, start int, n int"
#: Set in ``t`` of a run whose text has no id; the other 31 bits are those of the text.
NO_ID = -(1 << 31)
COPIED, OPEN, EDGE = 0, 1, 2
#: Runs of an anchor that go on, from which they are spread over several buckets.
ANCHOR_RUNS = 16_384
#: Windows that are sorted at once, where one anchor does not have more in its bucket.
WINDOWS_AT_ONCE = 1 << 21


def tagged(piece: pa.RecordBatch, text: np.ndarray) -> pa.Array:
    """The column t of runs of ``text``, with a mark on those that come after all others."""
    last = rp.numbers(piece, "ord")[text] == rp.LAST
    return pa.array((rp.numbers(piece, "t")[text] | np.where(last, NO_ID, 0)).astype(np.int32))


def untagged(row: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(t, ord) of runs as :func:`tagged` wrote them."""
    return (t & ~NO_ID).astype(np.int64), np.where(t < 0, rp.LAST, row)


def runs_task(width: int, gram: int):
    """Task code: every run of windows with one anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in ta.pieces(batch, "text"):
                units = rp.Units(*ta.flat(rp.field(piece, "text")), False)
                text, start, n, anchor, _ = rp.runs(units, width, gram)
                d1, d2 = units.digests(start, start + n + width - 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        rp.signed(anchor), rp.signed(d1), pa.array((d2 >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                        pa.array(rp.numbers(piece, "row")[text], pa.int64()), tagged(piece, text),
                        pa.array((start - units.first[text]).astype(np.int32)), pa.array(n.astype(np.int32)),
                    ],
                    names=["anchor", "d1", "d2", "row", "t", "start", "n"],
                )

    return run


def fresh(*columns: np.ndarray) -> np.ndarray:
    """True where sorted rows differ from the row before in any of the columns."""
    out = np.ones(len(columns[0]), dtype=bool)
    out[1:] = False
    for column in columns:
        out[1:] |= column[1:] != column[:-1]
    return out


def later(new: np.ndarray, row: np.ndarray, t: np.ndarray, own: np.ndarray, start: np.ndarray) -> np.ndarray:
    """True for rows of a group that have an earlier one in it; rows are sorted by group, ord, row, t, start.

    ``new`` is True where a group begins. Earlier is a smaller id, or a smaller start in the same text.
    """
    group = np.flatnonzero(new)[np.cumsum(new) - 1]
    text = new | fresh(own, row, t)
    first = np.flatnonzero(text)[np.cumsum(text) - 1]
    return (own > own[group]) | (start > start[first])


def table_of(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    kept = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(kept) if kept else None


def found(kind: int, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    n = len(columns["row"])
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, kind, dtype=np.int8)), *(pa.array(c, pa.int64()) for c in columns.values())],
        names=["kind", *columns],
    )


def first_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task code: of one bucket of runs, those that occur earlier, and those that go on."""
    whole = table_of(batches)
    if whole is None:
        return
    names = ("anchor", "d1", "d2", "row", "t", "start", "n")
    anchor, d1, d2, row, t, start, n = (whole.column(c).to_numpy() for c in names)
    del whole
    t, own = untagged(row, t)
    order = np.lexsort((d1, anchor))
    # Only runs that share anchor and first digest need the other keys.
    same = np.zeros(len(order) + 1, dtype=bool)
    same[1:-1] = ~fresh(anchor[order], d1[order])[1:]
    tied = np.flatnonzero(same[:-1] | same[1:])
    group = np.cumsum(~same[:-1])[tied]
    i = order[tied]
    order[tied] = i[np.lexsort((start[i], t[i], row[i], own[i], n[i], d2[i], group))]
    anchor, d1, d2, row, t, own, start, n = (x[order] for x in (anchor, d1, d2, row, t, own, start, n))
    new = fresh(anchor, d1, d2, n)
    copied = later(new, row, t, own, start)
    # Anchors with runs of several kinds; those at the ends of the bucket may have more elsewhere.
    begins = fresh(anchor)
    number = np.cumsum(begins) - 1
    several = np.bincount(number, weights=new) > 1
    several[[0, -1]] = True
    going = ~copied & several[number]
    for kind, which in ((COPIED, copied), (OPEN, going)):
        at = np.flatnonzero(which)
        for low in range(0, len(at), rp.CHUNK):
            i = at[low : low + rp.CHUNK]
            yield found(kind, {"row": row[i], "t": t[i], "start": start[i], "n": n[i], "anchor": anchor[i]})


def bytes_task(width: int, gram: int):
    """Task code: anchor, salt and bytes of the runs in ``open``, and whether equal windows may have other salts."""
    reach = width - gram + 1

    def place(piece: pa.RecordBatch, text: np.ndarray, start: np.ndarray, salts: np.ndarray) -> np.ndarray:
        """Number among the salts that a class of a very crowded anchor has, 0 for all others."""
        each = -(-salts // reach)
        code = ta.mix(start.astype(np.uint64) + rp.numbers(piece, "t")[text].astype(np.uint64))
        return (code % each.astype(np.uint64)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in ta.pieces(batch, "text"):
                units = rp.Units(*ta.flat(rp.field(piece, "text")), False)
                text, start, n, salts = rp.own_spans(piece, "open", 4)
                begin = units.first[text] + start
                _, every, _, anchor, lead = rp.runs(units, width, gram)
                at = np.searchsorted(every, begin)
                cut = parted(lead[at], n, np.minimum(salts, reach), reach)
                of, skip, n, part = cut
                text, start, salts, at = text[of], start[of] + skip, salts[of], at[of]
                begin = units.first[text] + start
                size = n + width - 1
                places = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                body = units.data[rp.spread(begin, size)]
                bodies = pa.Array.from_buffers(
                    pa.binary(), len(n), [None, pa.py_buffer(places.tobytes()), pa.py_buffer(body.tobytes())]
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        rp.signed(anchor[at]), pa.array(rp.numbers(piece, "row")[text], pa.int64()), tagged(piece, text),
                        pa.array(start.astype(np.int32)), bodies, pa.array(part + reach * place(piece, text, start, salts)),
                        pa.array(salts > reach),
                    ],
                    names=["anchor", "row", "t", "start", "bytes", "salt", "spread"],
                )

    return run


def parted(lead: np.ndarray, n: np.ndarray, classes: np.ndarray, reach: int) -> tuple[np.ndarray, ...]:
    """(run, windows skipped, windows, class) of the parts of runs, cut by the windows' distance from the anchor.

    Equal windows are at the same distance, so they are in parts of the same class.
    """
    of = np.repeat(np.arange(len(n)), n)
    step = rp.spread(np.zeros(len(n), dtype=np.int64), n)
    kind = (lead[of] - step) * classes[of] // reach
    begin = np.flatnonzero(fresh(of, kind)) if len(of) else of
    end = np.append(begin[1:], len(of))
    return of[begin], step[begin], end - begin, kind[begin]


def multikey(body: np.ndarray, at: np.ndarray, group: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, number): windows in ascending order within their groups, and the number of each distinct one.

    ``group`` ascends. The windows begin at ``at`` in ``body``. One symbol of eight bytes after
    another splits the windows that were equal so far; the last symbol overlaps the one before.
    """
    n = len(at)
    # Eight bytes from every place on, as one number.
    eight = np.ndarray((len(body) - 7,), dtype=">u8", buffer=body, strides=(1,))
    order = np.arange(n)
    starts = [*range(0, width - 7, 8)]
    if starts[-1] != width - 8:
        starts.append(width - 8)
    for offset in starts:
        same = np.zeros(n + 1, dtype=bool)
        same[1:n] = group[1:] == group[:-1]
        tied = np.flatnonzero(same[:-1] | same[1:])
        if not len(tied):
            break
        rows, of = order[tied], group[tied]
        value = eight[at[rows] + offset].astype(np.uint64)
        # Groups that agree in the symbol stay as they are; most of those left are copies.
        begin = fresh(of)
        first = np.flatnonzero(begin)
        number = np.cumsum(begin) - 1
        mixed = np.flatnonzero(np.logical_or.reduceat(value != value[first[number]], first)[number])
        if not len(mixed):
            continue
        tied, rows, of, value = tied[mixed], rows[mixed], of[mixed], value[mixed]
        inner = np.lexsort((value, of))
        order[tied], value = rows[inner], value[inner]
        new = ~same[:-1]
        new[tied] |= fresh(of, value)
        group = np.cumsum(new) - 1
    return order, group


def second_round(width: int):
    """Task code: of one bucket of runs, the windows that occur earlier, and the windows at its ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = table_of(batches)
        if whole is None:
            return
        whole = whole.take(pa.array(np.argsort(whole.column("anchor").to_numpy(), kind="stable")))
        anchor = whole.column("anchor").to_numpy()
        size = np.array([len(x) for x in whole.column("bytes").to_pylist()], dtype=np.int64) - (width - 1)
        total = np.concatenate([[0], np.cumsum(size)])
        begins = np.append(np.flatnonzero(fresh(anchor)), len(anchor))
        low = 0
        while low < len(begins) - 1:
            goal = total[begins[low]] + WINDOWS_AT_ONCE
            high = max(low + 1, int(np.searchsorted(total[begins], goal, side="right")) - 1)
            yield from sort(whole.slice(begins[low], begins[high] - begins[low]))
            low = high

    def sort(part: pa.Table) -> Iterator[pa.RecordBatch]:
        joined = part.column("bytes").to_pylist()
        body = np.frombuffer(b"".join(joined) + b"\0" * 8, dtype=np.uint8)
        size = np.array([len(x) for x in joined], dtype=np.int64)
        n = size - (width - 1)
        of = np.repeat(np.arange(len(n)), n)
        pos = rp.spread(np.zeros(len(n), dtype=np.int64), n)
        at = (np.cumsum(size) - size)[of] + pos
        anchor, row, t, start = (part.column(c).to_numpy().astype(np.int64) for c in ("anchor", "row", "t", "start"))
        t, own = untagged(row, t)
        order, group = multikey(body, at, (np.cumsum(fresh(anchor)) - 1)[of], width)
        r = of[order]
        first = start[r] + pos[order]
        inner = np.lexsort((first, t[r], row[r], own[r], group))
        r, first, order = r[inner], first[inner], order[inner]
        new = fresh(group)
        again = later(new, row[r], t[r], own[r], first)
        yield spans(row[r[again]], t[r[again]], first[again])
        edge = np.flatnonzero(~again & part.column("spread").to_numpy()[r])
        if len(edge):
            place = np.sort(at[order[edge]])
            turn = np.argsort(at[order[edge]], kind="stable")
            edge = edge[turn]
            d1 = ta.slice_hashes(body, place, place + width)
            d2 = ta.slice_hashes(body, place, place + width, rp.SECOND_BASE)
            columns = {"row": row[r[edge]], "t": t[r[edge]], "start": first[edge], "n": np.ones(len(edge), dtype=np.int64)}
            yield found(EDGE, columns | {"ord": own[r[edge]], "d1": d1.view(np.int64), "d2": d2.view(np.int64)})

    def spans(row: np.ndarray, t: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
        """Consecutive windows of a text as one span."""
        order = np.lexsort((start, t, row))
        row, t, start = row[order], t[order], start[order]
        new = fresh(row, t)
        new[1:] |= start[1:] > start[:-1] + 1
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(start)) - 1
        zero = np.zeros(len(begin), dtype=np.int64)
        columns = {"row": row[begin], "t": t[begin], "start": start[begin], "n": start[end] - start[begin] + 1} if len(begin) else {
            c: zero for c in ("row", "t", "start", "n")}
        return found(COPIED, columns | {"ord": zero, "d1": columns["row"], "d2": columns["start"]})

    return run


def removal_task(width: int):
    """Task code: what stays of every text, from its repeated windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in ta.pieces(batch, "text"):
                data, offsets = ta.flat(rp.field(piece, "text"))
                text, start, n = rp.own_spans(piece, "removed")
                begin = offsets[text] + start
                edge = np.zeros(len(data) + 1, dtype=np.int32)
                np.add.at(edge, begin, 1)
                np.add.at(edge, begin + n + width - 1, -1)
                gone = np.cumsum(edge)[:-1] > 0
                low, high = ta.stretches(gone, offsets)
                of = np.searchsorted(offsets, low, side="right") - 1
                places = np.searchsorted(of, np.arange(piece.num_rows + 1)).astype(np.int32)
                spans = pa.ListArray.from_arrays(
                    pa.array(places),
                    pa.StructArray.from_arrays([pa.array(low - offsets[of]), pa.array(high - offsets[of])], ["start", "end"]),
                )
                gone_in = np.concatenate([[0], np.cumsum(gone)])
                left = offsets - gone_in[offsets]
                body = data[~gone].tobytes()
                kept = pa.Array.from_buffers(
                    pa.large_binary(), piece.num_rows, [None, pa.py_buffer(left.astype(np.int64).tobytes()), pa.py_buffer(body)]
                ).cast(pa.binary())
                names = [c for c in piece.schema.names if c != "removed"]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(rp.field(piece, c) for c in names), pa.array(np.diff(offsets), pa.int64()),
                        pa.array(np.diff(gone_in[offsets]), pa.int64()), spans, kept,
                    ],
                    names=[*names, "n_bytes_", "n_removed_", "spans_", "kept_"],
                )

    return run


def packed(runs: DataFrame) -> DataFrame:
    """Runs as five long columns: a field of a shuffled row takes eight bytes whatever its type."""

    def both(high: str, low: str) -> Column:
        return F.shiftleft(F.col(high).cast("bigint"), 32).bitwiseOR(F.col(low).cast("bigint"))

    return runs.select("anchor", "d1", both("d2", "start").alias("place"), "row", both("t", "n").alias("size"))


def unpacked(runs: DataFrame) -> DataFrame:
    def high(c: str) -> Column:
        return F.shiftright(c, 32).cast("int")

    def low(c: str) -> Column:
        return F.col(c).bitwiseAND(F.lit(0x7FFFFFFF).cast("bigint")).cast("int")

    return runs.select(
        "anchor", "d1", high("place").alias("d2"), "row", high("size").alias("t"), low("place").alias("start"), low("size").alias("n")
    )


def suffix_dedup(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, gram: int = GRAM
) -> DataFrame:
    """``docs`` with n_bytes, n_removed, spans (maximal removed runs of bytes) and kept, the bytes that stay.

    A byte is removed if a string of ``width`` bytes that covers it also begins earlier: in a
    document with a smaller id, or in the same text before. Strings are judged on the input and
    never cross documents. ``key`` is an integer column; rows with the same id do not remove from each
    other, and neither do rows without an id, which come after all others. A null text is empty. Columns named like a
    result column are replaced. ``kept`` is binary, since a string may begin or end inside a character.
    """
    results = ["n_bytes", "n_removed", "spans", "kept"]
    given = docs.drop(*results)
    others = [c for c in given.columns if c not in (key, text)]
    clear = {c: f"c{i}_" for i, c in enumerate(others)}
    source = given.select(
        F.col(key).alias("id_"), F.col(text).alias("text"), *[F.col(c).alias(clear[c]) for c in others]
    )
    rows = rp.with_rows(source, "id_", "text")
    read = rows.select("row", "t", "ord", "text")
    runs = unpacked(packed(read.mapInArrow(runs_task(width, gram), RUNS)).repartitionByRange("anchor", "d1", "place", "row"))
    judged = runs.mapInArrow(first_round, "kind tinyint, row bigint, t bigint, start bigint, n bigint, anchor bigint")
    left = judged.where(F.col("kind") == OPEN).select("anchor", "row", "t", "start", "n").distinct()
    many = left.groupBy("anchor").agg(F.count("*").alias("runs")).where(F.col("runs") > ANCHOR_RUNS)
    salts = F.coalesce(F.ceil(F.col("runs") / ANCHOR_RUNS), F.lit(1)).cast("bigint")
    left = left.join(rp.apart(many), "anchor", "left")
    spans = left.groupBy("row").agg(F.collect_list(F.struct("t", "start", "n", salts.alias("salts"))).alias("open"))
    opened = rp.attach(read, spans, "inner").mapInArrow(
        bytes_task(width, gram),
        "anchor bigint, row bigint, t int, start int, bytes binary, salt bigint, spread boolean",
    )
    windows = opened.repartitionByRange("anchor", "salt").mapInArrow(
        second_round(width),
        "kind tinyint, row bigint, t bigint, start bigint, n bigint, ord bigint, d1 bigint, d2 bigint",
    )
    # Windows of anchors that are spread: a digest has as many rows as buckets have it, at most.
    same = Window.partitionBy("kind", "d1", "d2")
    own = Window.partitionBy("kind", "d1", "d2", "row", "t")
    across = windows.withColumn("lo", F.min("ord").over(same)).withColumn("from", F.min("start").over(own))
    single = across.where((F.col("kind") == COPIED) | (F.col("ord") > F.col("lo")) | (F.col("start") > F.col("from")))
    span = ["row", "t", "start", "n"]
    removed = rp.spans_of(judged.where(F.col("kind") == COPIED).select(*span).unionByName(single.select(*span)), "removed")
    final = rp.attach(rows, removed, "left").drop("row", "none", "ord")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in final.schema.fields if f.name != "removed")
    out = final.mapInArrow(
        removal_task(width), f"{schema}, n_bytes_ bigint, n_removed_ bigint, spans_ {SPAN}, kept_ binary"
    )
    back = {"id_": key, "text": text, **{v: k for k, v in clear.items()}}
    return out.select(
        *[F.col(next(n for n, k in back.items() if k == c)).alias(c) for c in given.columns],
        *[F.col(f"{c}_").alias(c) for c in results],
    )


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The columns of the registered query."""
    return found.select(
        key, "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
