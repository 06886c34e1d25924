"""Integer vectors, and queries that meet all rows shard by shard.

Rows are dealt to shards of bounded size, whatever their ids, labels and values, so no key can be hot.
Every shard is sent all queries; inside a task a shard's rows are held, its queries pass by in batches.
What moves is every row once and every query once per shard.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of one shard's components; rows of a smaller table are dealt to the cores of the cluster.
SHARD_BYTES = 64 << 20
#: No shard is planned for fewer rows than this.
LEAST_ROWS = 500


def scaled(vector: str, scale: int) -> Column:
    """floor(scale · x) of each component as long; components beyond the range of long saturate."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))


def usable(vector: str) -> Column:
    """Is the vector there, with no null, NaN or infinite component? An empty one is usable."""
    def finite(x: Column) -> Column:
        y = x.cast("double")
        return x.isNotNull() & ~F.isnan(y) & (F.abs(y) != F.lit(float("inf")))

    return F.col(vector).isNotNull() & F.coalesce(F.forall(vector, finite), F.lit(False))


def shards_for(rows: DataFrame) -> int:
    """Number of shards: enough to bound each by SHARD_BYTES, and for all cores unless rows are few."""
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(1)).alias("d")).first()
    bounded = -(-size["n"] * max(1, size["d"]) * 8 // SHARD_BYTES)
    busy = min(2 * rows.sparkSession.sparkContext.defaultParallelism, -(-size["n"] // LEAST_ROWS))
    return max(1, bounded, busy)


def meet(rows: DataFrame, queries: DataFrame, n: int, work: Callable, out: str) -> DataFrame:
    """``work(rows, batches of queries)`` for every shard of ``rows``.

    Both tables hold (id, v, label, own columns of the queries); ``queries`` are sent to all shards.
    """
    deal = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int")
    extra = [f for f in queries.schema.fields if f.name not in rows.columns]
    dealt = rows.select(
        deal.alias("shard"), F.lit(0).alias("kind"), *rows.columns, *[F.lit(None).cast(f.dataType).alias(f.name) for f in extra]
    )
    sent = queries.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("shard"), F.lit(1).alias("kind"), *queries.columns)
    both = dealt.unionByName(sent).repartition(n, "shard").sortWithinPartitions("shard", "kind")
    return both.mapInArrow(shard_task(work), out)


def shard_task(work: Callable):
    """Splits a sorted partition into shards; rows come first, then batches of queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, made = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = np.stack([batch.column(k).to_numpy() for k in ("shard", "kind")])
            cuts = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1
            for start, stop in zip([0, *cuts], [*cuts, batch.num_rows]):
                part = batch.slice(start, stop - start)
                if marks[0, start] != shard:
                    shard, held, made = marks[0, start], [], None
                if marks[1, start] == 0:
                    held.append(part)
                elif held or made is not None:
                    if made is None:
                        made, held = work(pa.Table.from_batches(held)), []
                    yield from made(part)

    return run


def ids_of(table) -> tuple[np.ndarray, np.ndarray]:
    """Ids, 0 where null, and whether they are there."""
    column = table.column("id")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.fill_null(0).to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False)


def matrix(table, width: int | None = None) -> np.ndarray:
    """Vectors as rows of one int64 matrix, the shorter ones filled up with zeros, cut at ``width``."""
    column = table.column("v")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    sizes = np.diff(column.offsets.to_numpy())
    wide = int(sizes.max(initial=0)) if width is None else width
    if len(sizes) and (sizes == wide).all():
        return flat.reshape(len(sizes), wide)
    out = np.zeros((len(sizes), wide), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    fits = at < wide
    out[row[fits], at[fits]] = flat[fits]
    return out


def largest(m: np.ndarray) -> int:
    return max(int(m.max(initial=0)), -int(m.min(initial=0)))


def exact(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The matrices as int64 where every sum of products of theirs fits, else as Python integers.

    Eight times the bound leaves room for the sums and differences of a recursive product.
    """
    fits = 8 * largest(a) * largest(b) * max(1, a.shape[-1]) ** 2 < 1 << 62
    return (a, b) if fits else (a.astype(object), b.astype(object))


def saturated(scores) -> list[int]:
    """Scores as longs; those beyond the range of long saturate."""
    return [min(max(int(s), -(1 << 63)), (1 << 63) - 1) for s in scores]


def in_order(ids: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Places of the rows by id, null last."""
    return np.lexsort((ids, ~known))
