"""Runs of windows that occur again elsewhere: the search shared by the two exact substring operators.

A text is a sequence of units, words or bytes, and a window is ``width`` consecutive units of one
text. Among the grams of a window, the one with the smallest hash is its anchor (the leftmost, if
that gram occurs twice). Equal windows have equal anchors at the same place, so a window can only
occur again if its anchor does. Consecutive windows with one anchor are a run, and of the work below
all but the last step handles runs:

1. anchors are counted; only runs whose anchor occurs again go on;
2. runs are compared whole, by a 128-bit digest of their units: a run that also occurs earlier
   consists of windows that occur earlier. Inner parts of copied passages end here, however often
   they are copied;
3. the earliest occurrences of different runs that share an anchor are compared window by window.

Every shuffle is a hash shuffle that adds up before it sends, or an equi-join that adaptive
execution splits if one key is hot; nothing gathers an unbounded group. The texts are shuffled
once, by row; the later steps of the same query read that shuffle again.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propensa.llm import textarrays as ta

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LAST = (1 << 63) - 1
CHUNK = 1 << 16
LOW = np.uint64((1 << 24) - 1)
SECOND_BASE = 0xA0761D6478BD642F
MARKED = "row bigint, t bigint, none boolean, anchor bigint, d1 bigint, d2 bigint, start bigint, n bigint"


class Units:
    """The units of the texts of one piece: ``first`` has where each text's units begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, words: bool) -> None:
        self.data, self.words = data, words
        if words:
            self.starts, self.ends, self.first = ta.slices(data, offsets, ta.ascii_space())
            self.values = ta.slice_hashes(data, self.starts, self.ends)
        else:
            self.first = offsets
            self.values = data

    def grams(self, size: int) -> np.ndarray:
        return ta.window_hashes(self.values, size) if self.words else ta.byte_grams(self.data, size)

    def digests(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        values = self.values
        return ta.slice_hashes(values, starts, ends), ta.slice_hashes(values, starts, ends, SECOND_BASE)


def owners(grams: np.ndarray, reach: int) -> np.ndarray:
    """Place of the smallest of every ``reach`` consecutive grams, the leftmost on ties."""
    n = len(grams) - reach + 1
    out = np.empty(max(n, 0), dtype=np.int64)
    for low in range(0, n, CHUNK):
        part = grams[low : low + CHUNK + reach - 1] & ~LOW
        part |= np.arange(len(part), dtype=np.uint64)
        least = ta.sliding_min(part, reach)
        out[low : low + len(least)] = low + (least & LOW).astype(np.int64)
    return out


def runs(units: Units, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, first window, number of windows, anchor, lead) of every run of windows with one anchor.

    ``lead`` is how far behind the start of its first window the anchor begins.
    """
    inside = ta.within(units.first, width)
    if not inside.any():
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none.astype(np.uint64), none
    grams = units.grams(gram)
    owner = owners(grams, width - gram + 1)
    fresh = inside.copy()
    fresh[1:] &= ~inside[:-1] | (owner[1:] != owner[:-1])
    starts = np.flatnonzero(fresh)
    ends = np.append(starts[1:], len(inside))
    # A run also ends where its text has no more windows.
    text = np.searchsorted(units.first, starts, side="right") - 1
    ends = np.minimum(ends, units.first[text + 1] - width + 1)
    return text, starts, ends - starts, grams[owner[starts]], owner[starts] - starts


def field(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return field(batch, name).to_numpy(zero_copy_only=False)


def lists(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All elements of a column of lists, and to which row each belongs."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    return column.flatten(), np.repeat(np.arange(len(column)), sizes)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).astype(np.uint64).view(np.int64))


def anchors_task(width: int, gram: int, words: bool):
    """Task code: (row, anchor) of every run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in ta.pieces(batch, "text"):
                units = Units(*ta.flat(field(piece, "text")), words)
                text, _, _, anchor, _ = runs(units, width, gram)
                own = numbers(piece, "ord")[text]
                row = numbers(piece, "row")[text]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row, pa.int64()), pa.array(own, pa.int64()), signed(anchor)], names=["row", "ord", "anchor"]
                )

    return run


def runs_task(width: int, gram: int, words: bool):
    """Task code: the runs whose anchor is among the ``marks`` of their row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in ta.pieces(batch, "text"):
                units = Units(*ta.flat(field(piece, "text")), words)
                text, start, n, anchor, _ = runs(units, width, gram)
                marks, of = lists(field(piece, "marks"))
                wanted = np.asarray(marks).astype(np.int64).view(np.uint64)
                salt = np.arange(piece.num_rows, dtype=np.uint64) * ta.BASE
                keep = np.isin(anchor + salt[text], wanted + salt[of])
                text, start, n, anchor = text[keep], start[keep], n[keep], anchor[keep]
                d1, d2 = units.digests(start, start + n + width - 1)
                columns = [numbers(piece, c)[text] for c in ("row", "t")]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.array(c, pa.int64()) for c in columns),
                        pa.array(numbers(piece, "none")[text].astype(bool)),
                        signed(anchor), signed(d1), signed(d2),
                        pa.array(start - units.first[text]), pa.array(n),
                    ],
                    names=["row", "t", "none", "anchor", "d1", "d2", "start", "n"],
                )

    return run


def own_spans(piece: pa.RecordBatch, name: str, fields: int = 3) -> tuple[np.ndarray, ...]:
    """(text, start, n, …) of the spans (t, start, n, …) in a column of lists, by text and start.

    A span of another text with this row's id is passed over.
    """
    spans, of = lists(field(piece, name))
    if not len(spans):
        return (np.zeros(0, dtype=np.int64),) * fields
    t, *rest = (np.asarray(spans.field(i)).astype(np.int64) for i in range(fields))
    own = t == numbers(piece, "t")[of]
    order = np.lexsort((rest[0][own], of[own]))
    return of[own][order], *(x[own][order] for x in rest)


def spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start+1, … of every span, one after another."""
    total = np.concatenate([[0], np.cumsum(n)])
    return np.arange(total[-1]) + np.repeat(start - total[:-1], n)


def with_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The rows to search, shuffled once: row, t, none (no id), ord (smaller is earlier).

    ``row`` is the id, or a hash of the text where there is none; ``t``, 31 bits of that hash, tells
    rows apart that share an id.
    """
    whole = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    rows = docs.withColumn("t", whole.bitwiseAND(F.lit(0x7FFFFFFF).cast("bigint")))
    rows = rows.withColumn("row", F.coalesce(F.col(key).cast("bigint"), whole)).repartition("row")
    return rows.withColumn("none", F.col(key).isNull()).withColumn(
        "ord", F.when(F.col("none"), F.lit(LAST)).otherwise(F.col("row"))
    )


def order_of(none: Column, row: Column) -> Column:
    return F.when(none, F.lit(LAST)).otherwise(row)


def repeated_runs(rows: DataFrame, width: int, gram: int, words: bool, inside: bool) -> DataFrame:
    """Runs whose anchor occurs in another row, or, if ``inside``, anywhere else."""
    # All branches read the same columns of the rows, so that they share one shuffle of the texts.
    source = rows.select("row", "t", "ord", "text")
    anchors = source.mapInArrow(anchors_task(width, gram, words), "row bigint, ord bigint, anchor bigint")
    if inside:
        again = anchors.groupBy("anchor").agg(F.count("*").alias("times")).where("times > 1")
    else:
        again = anchors.groupBy("anchor").agg(F.min("ord").alias("lo"), F.max("ord").alias("hi")).where("lo < hi")
    marks = (
        anchors.join(apart(again.select("anchor")), "anchor", "left_semi")
        .groupBy("row").agg(F.collect_set("anchor").alias("marks"))
    )
    marked = rows.select("row", "t", "none", "text").join(marks.hint("shuffle_hash"), "row")
    return marked.mapInArrow(runs_task(width, gram, words), MARKED).withColumn(
        "ord", order_of(F.col("none"), F.col("row"))
    )


def apart(small: DataFrame) -> DataFrame:
    """Sums that join what they were made from: shuffled anew, which lets a hot key's rows be split."""
    return small.hint("rebalance")


def spans_of(found: DataFrame, name: str) -> DataFrame:
    """One row per row id with its spans (t, start, n) as a list."""
    return found.groupBy("row").agg(F.collect_list(F.struct("t", "start", "n")).alias(name))


def attach(rows: DataFrame, spans: DataFrame, how: str) -> DataFrame:
    """The texts with their lists of spans; the lists are the hashed side of the join."""
    return rows.join(spans.hint("shuffle_hash"), "row", how)


Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
