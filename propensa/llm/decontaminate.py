"""Benchmark decontamination by a generalised suffix automaton of the test items.

Texts are normalised to words: A-Z is lower-cased, and a word is a maximal run of
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``. The automaton accepts every run of words that occurs in
some item. A document's words are streamed through it; the state tells how many words up to here
match an item without a gap. Where that length reaches the window, all matched words are hit.

The items are taken in slices of at most ``SLICE_WORDS`` words by size, which bounds the automaton
that one task holds; a larger benchmark means more slices, whose findings are added up, and no item
is left out. A word that no item has resets the automaton, so only stretches of documents that are
made of item words and at least as long as the shortest window are streamed; numpy finds them.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propensa.llm import textarrays as ta
from propensa.llm.shield import restored, schema_of, shielded

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW = 10
#: Words of benchmark items in one automaton: below 200 bytes each, so at most 200 MB in a task.
SLICE_WORDS = 1_000_000


def word_bytes() -> np.ndarray:
    """True for every byte of a normalised word, upper case included, which is folded beforehand."""
    table = np.zeros(256, dtype=bool)
    table[0x30:0x3A] = table[0x41:0x5B] = table[0x61:0x7B] = table[0x80:] = True
    return table


def folded(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z."""
    upper = (data >= 0x41) & (data <= 0x5A)
    return data + (upper * np.uint8(0x20)).astype(np.uint8)


class Automaton:
    """Suffix automaton of several word sequences, over word numbers."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int) -> None:
        self.window = window
        self.number: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.names = [name for name, _ in items]
        #: Of a state: the items of which it has read a prefix whose windows end here.
        owners: list[set[int]] = [set()]
        whole: list[set[int]] = [set()]
        self.shortest = window
        for item, (_, words) in enumerate(items):
            if not words:
                continue
            self.shortest = min(self.shortest, len(words))
            last = 0
            for i, word in enumerate(words):
                last = self._extend(last, self.number.setdefault(word, len(self.number)))
                while len(owners) < len(self.next):
                    owners.append(set())
                    whole.append(set())
                if i + 1 >= window:
                    owners[last].add(item)
            if len(words) < window:
                whole[last].add(item)
        # An item reaches every suffix of what it has read; the owners of a state are those of the
        # states below it in the tree of suffix links, as far as a window is that long.
        order = sorted(range(1, len(self.next)), key=lambda s: -self.length[s])
        for s in order:
            up = self.link[s]
            if self.length[up] >= window:
                owners[up] |= owners[s]
        self.owners = owners
        self.whole: list[list[tuple[int, int]]] = [[] for _ in self.next]
        sizes = [len(words) for _, words in items]
        for s in reversed(order):
            own = [(sizes[i], i) for i in whole[s]]
            self.whole[s] = self.whole[self.link[s]] + own

    def _copy(self, state: int, length: int) -> int:
        self.next.append(dict(self.next[state]))
        self.link.append(self.link[state])
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, symbol: int, q: int) -> int:
        clone = self._copy(q, self.length[p] + 1)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, symbol: int) -> int:
        q = self.next[last].get(symbol)
        if q is not None:  # another item already went this way
            return q if self.length[q] == self.length[last] + 1 else self._split(last, symbol, q)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        state, p = len(self.next) - 1, last
        while p >= 0 and symbol not in self.next[p]:
            self.next[p][symbol] = state
            p = self.link[p]
        if p >= 0:
            q = self.next[p][symbol]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._split(p, symbol, q)
        return state

    def stream(self, symbols: list[int], hit: np.ndarray, found: set[int]) -> None:
        """Mark the words that lie in a window of an item; add those items to ``found``."""
        state = length = 0
        for i, symbol in enumerate(symbols):
            while state and symbol not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            state = self.next[state].get(symbol, 0)
            length = length + 1 if state else 0
            if length >= self.window:
                hit[i + 1 - length : i + 1] = True
                at = state
                while self.length[self.link[at]] >= self.window:
                    at = self.link[at]
                found |= self.owners[at]
            for size, item in self.whole[state]:
                if size <= length:
                    hit[i + 1 - size : i + 1] = True
                    found.add(item)


def item_words(text: str | None) -> list[bytes]:
    """The normalised words of one text."""
    data = folded(np.frombuffer((text or "").encode(), dtype=np.uint8))
    starts, ends, _ = ta.slices(data, np.array([0, len(data)]), word_bytes())
    body = data.tobytes()
    return [body[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]


def finder(items: list[tuple[str, str]], window: int, text: str):
    """Task code: hit spans and items of every document of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton([(name, item_words(t)) for name, t in items], window)
        known = sorted(automaton.number)
        body = np.frombuffer(b"".join(known), dtype=np.uint8)
        sizes = np.array([len(w) for w in known], dtype=np.int64)
        ends = np.cumsum(sizes)
        hashes = ta.slice_hashes(body, ends - sizes, ends)
        order = np.argsort(hashes)
        hashes = hashes[order]
        symbol = np.array([automaton.number[known[i]] for i in order], dtype=np.int64)
        belongs = word_bytes()
        for batch in batches:
            for piece in ta.pieces(batch, text):
                yield one(piece, automaton, hashes, symbol, belongs)

    def one(piece, automaton, hashes, symbol, belongs) -> pa.RecordBatch:
        data, offsets = ta.flat(piece.column(piece.schema.get_field_index(text)))
        data = folded(data)
        starts, ends, first = ta.slices(data, offsets, belongs)
        own = ta.slice_hashes(data, starts, ends)
        numbers = np.full(len(own), -1, dtype=np.int64)
        if len(hashes):
            at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
            same = hashes[at] == own
            numbers[same] = symbol[at[same]]
        n_words = np.diff(first)
        n_hit = np.zeros(piece.num_rows, dtype=np.int64)
        spans: list[list[dict]] = [[] for _ in range(piece.num_rows)]
        items_of: list[list[str]] = [[] for _ in range(piece.num_rows)]
        cut, stop = ta.stretches(numbers >= 0, first)
        hit = np.zeros(len(numbers), dtype=bool)
        found: dict[int, set[int]] = {}
        for s, e in zip(cut.tolist(), stop.tolist(), strict=True):
            if e - s >= automaton.shortest:
                mark = hit[s:e]
                names: set[int] = set()
                automaton.stream(numbers[s:e].tolist(), mark, names)
                if names:
                    row = int(np.searchsorted(first, s, side="right")) - 1
                    found.setdefault(row, set()).update(names)
        for row, names in found.items():
            a, b = first[row], first[row + 1]
            n_hit[row] = int(hit[a:b].sum())
            items_of[row] = sorted({automaton.names[i] for i in names})
            for s, e in zip(*ta.runs(hit[a:b]), strict=True):
                spans[row].append({
                    "word": int(s), "n_words": int(e - s),
                    "start": int(starts[a + s] - offsets[row]), "end": int(ends[a + e - 1] - offsets[row]),
                })
        span = pa.struct([(c, pa.int64()) for c in ("word", "n_words", "start", "end")])
        return pa.RecordBatch.from_arrays(
            [*piece.columns, pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()),
             pa.array(items_of, pa.list_(pa.string())), pa.array(spans, pa.list_(span))],
            names=[*piece.schema.names, "n_words_", "n_hit_", "items_", "spans_"],
        )

    return run


SPAN = "array<struct<word: bigint, n_words: bigint, start: bigint, end: bigint>>"


def _item_slices(
    benchmark: DataFrame, item: str, text: str
) -> Iterator[list[tuple[str, str]]]:
    """The items, dealt to slices of bounded size in the order of their ids.

    The running size that deals them out is kept in Spark; the driver holds one slice at a time
    while it is sent out. An item longer than a slice is a slice of its own.
    """
    words = F.size(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
    items = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("t"), words.alias("w"))
    total = items.agg(F.coalesce(F.sum("w"), F.lit(0)).alias("w")).first()["w"]
    if total <= SLICE_WORDS:
        return iter([[(r["item"], r["t"]) for r in items.collect()]])
    n = 2 * (total // SLICE_WORDS + 1)
    dealt = items.withColumn("slice", F.pmod(F.xxhash64("item", "t"), F.lit(n)))
    return ([(r["item"], r["t"]) for r in dealt.where(F.col("slice") == i).collect()] for i in range(n))


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """``docs`` with n_words, n_hit, items (ids as sorted strings) and spans of hit words.

    Spans are counted in words and in UTF-8 bytes of the text. A null or wordless text has no
    words; an item of no words hits nothing; equal items are both named. Columns of ``docs`` are
    kept; those named like a result column are replaced.
    """
    given, names = shielded(docs, "n_words", "n_hit", "items", "spans")
    added = f"n_words_ bigint, n_hit_ bigint, items_ array<string>, spans_ {SPAN}"
    out, slices = given, 0
    for rows in _item_slices(benchmark, item, item_text):
        rows = [(name if name is not None else "", t) for name, t in rows]
        step = out.mapInArrow(finder(rows, window, names[text]), f"{schema_of(out)}, {added}")
        if slices:
            step = step.withColumns({
                "items_": F.array_sort(F.array_union("items", "items_")), "spans_": F.concat("spans", "spans_"),
            })
        out = step.select(
            *given.columns, F.col("n_words_").alias("n_words"), F.col("n_hit_").alias("n_hit"),
            F.col("items_").alias("items"), F.col("spans_").alias("spans"),
        )
        slices += 1
    if slices > 1:
        out = _joined_spans(out)
    return restored(out, names, "n_words", "n_hit", "items", "spans")


def _joined_spans(df: DataFrame) -> DataFrame:
    """Spans of several slices may overlap: merge them and count the hit words again."""
    ordered = F.array_sort("spans")

    def add(acc, x):
        last = F.element_at(acc, -1)
        grown = F.struct(
            last["word"].alias("word"),
            (F.greatest(last["word"] + last["n_words"], x["word"] + x["n_words"]) - last["word"]).alias("n_words"),
            last["start"].alias("start"),
            F.greatest(last["end"], x["end"]).alias("end"),
        )
        apart = (F.size(acc) == 0) | (x["word"] > last["word"] + last["n_words"])
        return F.when(apart, F.concat(acc, F.array(x))).otherwise(
            F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(grown))
        )

    empty = F.array().cast(SPAN)
    merged = df.withColumn("spans", F.aggregate(ordered, empty, add))
    total = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, x: a + x["n_words"])
    return merged.withColumn("n_hit", total)


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The columns of the registered query."""
    return found.select(
        key, "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
