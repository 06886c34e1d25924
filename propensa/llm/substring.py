"""Substring dedup: Rabin-Karp hashes of every window of 50 words, counted in Spark.

A word is a maximal run of bytes other than 0x20 and 0x09 to 0x0D. A word is removed if some
window that covers it also starts in a document with a smaller id; windows are judged on the input.
Windows are told apart by two rolling hashes of 64 and 32 bits. Windows that start at neighbouring
words and share the same sampled gram are first counted as one run (see :mod:`repeats`), the others
one by one. Repeated windows merge into maximal removal intervals.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propensa.llm import repeats as rp
from propensa.llm import textarrays as ta

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WIDTH = 50
GRAM = 8
SPAN = "array<struct<word: bigint, n_words: bigint, start: bigint, end: bigint>>"


def windows_task(width: int):
    """Task code: both rolling hashes of every window in the runs of ``open``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in ta.pieces(batch, "text"):
                units = rp.Units(*ta.flat(rp.field(piece, "text")), True)
                text, start, n = rp.own_spans(piece, "open")
                pos = rp.spread(start, n)
                of = np.repeat(text, n)
                at = units.first[of] + pos
                h1 = ta.window_hashes(units.values, width)[at]
                h2 = (ta.window_hashes(units.values, width, rp.SECOND_BASE)[at] >> np.uint64(33)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rp.numbers(piece, "row")[of], pa.int64()), pa.array(rp.numbers(piece, "t")[of], pa.int64()),
                        pa.array(rp.numbers(piece, "ord")[of], pa.int64()), rp.signed(h1), pa.array(h2), pa.array(pos, pa.int64()),
                    ],
                    names=["row", "t", "ord", "h1", "h2", "start"],
                )

    return run


def removal_task(width: int):
    """Task code: kept words and removed spans of every text, from its repeated windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in ta.pieces(batch, "text"):
                data, offsets = ta.flat(rp.field(piece, "text"))
                starts, ends, first = ta.slices(data, offsets, ta.ascii_space())
                text, start, n = rp.own_spans(piece, "removed")
                begin = first[text] + start
                edge = np.zeros(len(starts) + 1, dtype=np.int64)
                np.add.at(edge, begin, 1)
                np.add.at(edge, begin + n + width - 1, -1)
                gone = np.cumsum(edge)[:-1] > 0
                low, high = ta.stretches(gone, first)
                of = np.searchsorted(first, low, side="right") - 1
                spans: list[list[dict]] = [[] for _ in range(piece.num_rows)]
                for i, s, e in zip(of.tolist(), low.tolist(), high.tolist(), strict=True):
                    spans[i].append({
                        "word": int(s - first[i]), "n_words": e - s,
                        "start": int(starts[s] - offsets[i]), "end": int(ends[e - 1] - offsets[i]),
                    })
                body, kept = data.tobytes(), []
                for i in range(piece.num_rows):
                    parts, at = [], int(offsets[i])
                    for span in spans[i]:
                        parts.append(body[at : offsets[i] + span["start"]])
                        at = int(offsets[i]) + span["end"]
                    parts.append(body[at : offsets[i + 1]])
                    kept.append(b" ".join(b" ".join(parts).split()).decode())
                gone_in = np.concatenate([[0], np.cumsum(gone)])
                names = [c for c in piece.schema.names if c != "removed"]
                kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("word", "n_words", "start", "end")]))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(rp.field(piece, c) for c in names), pa.array(np.diff(first), pa.int64()),
                        pa.array(np.diff(gone_in[first]), pa.int64()), pa.array(spans, kind), pa.array(kept, pa.string()),
                    ],
                    names=[*names, "n_words_", "n_removed_", "spans_", "kept_"],
                )

    return run


def substring_dedup(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, gram: int = GRAM
) -> DataFrame:
    """``docs`` with n_words, n_removed, spans (in words and bytes) and kept, the words that stay.

    ``key`` is an integer column. Two rows with the same id are not earlier than one another; a row
    without id is later than all that have one, and such rows do not remove from each other. A null
    text has no words. Columns named like a result column are replaced.
    """
    results = ["n_words", "n_removed", "spans", "kept"]
    given = docs.drop(*results)
    others = [c for c in given.columns if c not in (key, text)]
    clear = {c: f"c{i}_" for i, c in enumerate(others)}
    source = given.select(
        F.col(key).alias("id_"), F.col(text).alias("text"), *[F.col(c).alias(clear[c]) for c in others]
    )
    rows = rp.with_rows(source, "id_", "text")
    marked = rp.repeated_runs(rows, width, gram, True, False)

    # Whole runs: every run that also occurs in an earlier document is removed.
    first = marked.groupBy("anchor", "d1", "d2").agg(F.min("ord").alias("lo"))
    several = (
        first.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("lo").alias("lo"))
        .where((F.col("kinds") > 1) & (F.col("lo") < rp.LAST)).select("anchor")
    )
    judged = marked.join(rp.apart(first), ["anchor", "d1", "d2"])
    copied = judged.where("ord > lo").select("row", "t", "start", "n")
    # Earliest runs that share an anchor with a different run: their windows one by one.
    left = judged.where("ord <= lo").join(rp.apart(several), "anchor", "left_semi").select("row", "t", "start", "n")
    opened = rp.attach(rows.select("row", "t", "ord", "text"), rp.spans_of(left, "open"), "inner")
    windows = opened.mapInArrow(
        windows_task(width), "row bigint, t bigint, ord bigint, h1 bigint, h2 int, start bigint"
    )
    earliest = windows.groupBy("h1", "h2").agg(F.min("ord").alias("lo"), F.max("ord").alias("hi")).where("lo < hi")
    single = (
        windows.join(rp.apart(earliest.drop("hi")), ["h1", "h2"]).where("ord > lo")
        .select("row", "t", "start", F.lit(1).cast("bigint").alias("n"))
    )
    removed = rp.spans_of(copied.unionByName(single), "removed")
    final = rp.attach(rows, removed, "left").drop("row", "none", "ord")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in final.schema.fields if f.name != "removed")
    out = final.mapInArrow(
        removal_task(width), f"{schema}, n_words_ bigint, n_removed_ bigint, spans_ {SPAN}, kept_ string"
    )
    back = {"id_": key, "text": text, **{v: k for k, v in clear.items()}}
    return out.select(
        *[F.col(next(n for n, k in back.items() if k == c)).alias(c) for c in given.columns],
        *[F.col(f"{c}_").alias(c) for c in results],
    )


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The columns of the registered query."""
    return found.select(key, "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
