"""Texts of an Arrow batch as flat byte arrays, with word slices and rolling hashes over them.

The module is sent to the tasks by value, so executors need numpy and pyarrow but not this
package. All arithmetic on hashes is modulo 2^64. Long texts are worked through in stretches of
bounded size, so the temporary arrays do not grow with a text.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Bytes of text that are worked on at once; a longer text is a piece of its own.
PIECE_BYTES = 1 << 20
STRETCH = 1 << 16
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def inverse_power_of_two_ring(odd: int) -> int:
    """The number that times ``odd`` is 1 modulo 2^64."""
    return pow(odd, -1, 1 << 64)


def powers(base: np.uint64, n: int) -> np.ndarray:
    """1, base, base², … modulo 2^64."""
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def ascii_space() -> np.ndarray:
    """True for every byte that belongs to a word, that is all but 0x20 and 0x09 to 0x0D."""
    table = np.ones(256, dtype=bool)
    table[[0x20, *range(0x09, 0x0E)]] = False
    return table


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the n+1 offsets of the texts; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, places, body = column.buffers()
    offsets = np.frombuffer(places, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if body is None or offsets[-1] == offsets[0]:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    data = np.frombuffer(body, dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def pieces(batch: pa.RecordBatch, text: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts together stay within ``limit``, where one row allows it."""
    _, offsets = flat(batch.column(batch.schema.get_field_index(text)))
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def stretches(inside: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every maximal run of True; runs also end where one of the texts ends.

    ``first`` has the place where each text begins, and the number of all items at its end.
    """
    fresh = np.ones(len(inside) + 1, dtype=bool)
    fresh[1:-1] = inside[1:] != inside[:-1]
    fresh[first] = True
    return np.flatnonzero(inside & fresh[:-1]), np.flatnonzero(inside & fresh[1:]) + 1


def slices(
    data: np.ndarray, offsets: np.ndarray, belongs: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every maximal run of bytes with ``belongs[byte]``, and where each text's runs begin.

    The third array has one more entry than there are texts. Runs never reach over the end of a text.
    """
    starts, ends = stretches(belongs[data], offsets)
    return starts, ends, np.searchsorted(starts, offsets)


def slice_hashes(
    data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = int(BASE)
) -> np.ndarray:
    """A 64-bit hash of the content of every slice; starts and ends ascend."""
    out = np.empty(len(starts), dtype=np.uint64)
    done = 0
    while done < len(starts):
        low = starts[done]
        stop = max(done + 1, int(np.searchsorted(ends, low + STRETCH, side="right")))
        part = data[low : ends[stop - 1]]
        power = powers(np.uint64(base), len(part) + 1)
        total = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[:-1], out=total[1:])
        back = powers(np.uint64(inverse_power_of_two_ring(base)), len(part) + 1)
        s, e = starts[done:stop] - low, ends[done:stop] - low
        out[done:stop] = mix((total[e] - total[s]) * back[s])
        done = stop
    return out


def window_hashes(values: np.ndarray, width: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """Rabin-Karp hash of every ``width`` consecutive values; empty if there are fewer."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.empty(n, dtype=np.uint64)
    power = powers(np.uint64(base), STRETCH + width)
    back = powers(np.uint64(inverse_power_of_two_ring(base)), STRETCH + width)
    for low in range(0, n, STRETCH):
        part = values[low : low + STRETCH + width - 1]
        total = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(part * power[: len(part)], out=total[1:])
        k = len(part) - width + 1
        out[low : low + k] = mix((total[width:] - total[:k]) * back[:k])
    return out


def byte_grams(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every ``width`` consecutive bytes; ``width`` is a multiple of eight."""
    n = len(data) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    eight = np.lib.stride_tricks.as_strided(
        np.ascontiguousarray(data), shape=(len(data) - 7, 8), strides=(1, 1)
    )
    eight = np.ascontiguousarray(eight).view("<u8").ravel()
    out = np.zeros(n, dtype=np.uint64)
    for at in range(0, width, 8):
        out = (out ^ eight[at : at + n]) * np.uint64(0x9DDFEA08EB382D69)
        out ^= out >> np.uint64(32)
    return mix(out)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every ``width`` consecutive values."""
    reach = 1
    while reach * 2 <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    if reach < width:
        rest = width - reach
        values = np.minimum(values[:-rest], values[rest:])
    return values


def within(first: np.ndarray, width: int) -> np.ndarray:
    """For every window start over items dealt to texts by ``first``: does the window stay in its text?"""
    n = int(first[-1])
    if n < width:
        return np.zeros(0, dtype=bool)
    left = np.repeat(first[1:], np.diff(first))[: n - width + 1]
    return np.arange(n - width + 1) + width <= left


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """True for each of n items that lies in a window beginning at one of ``starts``."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.asarray(starts) + width, -1)
    return np.cumsum(edge[:-1]) > 0


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every maximal run of True."""
    padded = np.zeros(len(flags) + 2, dtype=np.int8)
    padded[1:-1] = flags
    step = np.diff(padded)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)
