"""Cross products inside tasks: a few matrices per task, merged element by element.

The module is sent to the tasks by value, so executors need numpy and pyarrow but not this package.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

NAMES = ["n", "x", "xx", "xy"]


def _written(sums: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([m.ravel()], pa.list_(pa.float64())) for m in sums], NAMES)


def products_task(shift: list[float]):
    """Per task the counts, sums, sums of squares and of products of all pairs of columns, over rows where both are known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(shift)
        sums = [np.zeros((d, d)) for _ in NAMES]
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            rows += batch.num_rows
            there = np.column_stack([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns])
            x = np.column_stack([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in batch.columns])
            x = np.where(there, x - np.array(shift), 0.0)
            known = there.astype(float)
            for total, part in zip(sums, (known.T @ known, x.T @ known, (x * x).T @ known, x.T @ x)):
                total += part
        if rows:
            yield _written(sums)

    return run


def merge_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of all rows, element by element."""
    sums: list[np.ndarray] | None = None
    for batch in batches:
        for i in range(batch.num_rows):
            row = [batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in NAMES]
            sums = [r.copy() for r in row] if sums is None else [s + r for s, r in zip(sums, row)]
    if sums is not None:
        yield _written(sums)


def pearson_task(columns: list[str]):
    """(x, y, r) of all ordered pairs, from the merged sums; without rows every r is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(columns)
        for batch in batches:
            for i in range(batch.num_rows):
                n, x, xx, xy = (batch.column(c)[i].values.to_numpy(zero_copy_only=False).reshape(d, d) for c in NAMES)
                with np.errstate(all="ignore"):
                    r = (n * xy - x * x.T) / np.sqrt((n * xx - x * x) * (n * xx.T - x.T * x.T))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(columns, d).tolist(), pa.string()),
                        pa.array(columns * d, pa.string()),
                        pa.array(r.ravel(), pa.float64(), mask=(n < 2).ravel()),
                    ],
                    ["x", "y", "r"],
                )

    return run
