"""Byte-level BPE encoding and decoding, vectorised over a batch of texts.

Pre-tokenisation needs no regex. Every code point is mapped to a class by a table, with the few
facts that the pattern looks ahead for folded into the class. A small automaton over classes says
where a token begins; as each class is a function from state to state, and composition of functions
is associative, the texts are cut into stripes that run side by side, the stripes' functions are
composed to give each stripe its true first state, and the boundaries are read off.

The slices between boundaries are hashed; each distinct slice is merged once, by the ranks, and its
ids kept for later pieces under a 64-bit hash: among the slices of one task two different ones share
a hash with a chance below 10^-7. Ids, the byte offset of each token, and decoding are gathers.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propensa.llm import textarrays as ta
from propensa.llm.shield import restored, schema_of, shielded

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Distinct slices whose ids a task keeps; when full it starts again, so memory is bounded.
CACHE = 1_500_000
PIECE_BYTES = 2 << 20
TAIL_ROWS = 32
#: Bytes of a slice up to which the least pair is found by looking through all.
SHORT = 256
LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3
# The apostrophe endings that are tokens of their own.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")

# White space in the sense of the pattern: the Unicode property White_Space.
BLANKS = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


def class_table() -> np.ndarray:
    """Class of every code point."""
    table = np.full(0x110000, OTHER, dtype=np.uint8)
    for code in range(0x110000):
        kind = unicodedata.category(chr(code))[0]
        if kind == "L":
            table[code] = LETTER
        elif kind == "N":
            table[code] = NUMBER
    table[list(BLANKS)] = SPACE
    return table


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of valid UTF-8 and the byte at which each begins."""
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[starts].astype(np.int32)
    padded = np.concatenate([data, np.zeros(3, dtype=np.uint8)]).astype(np.int32)
    out = lead.copy()
    for size, low, mask in ((2, 0xC0, 0x1F), (3, 0xE0, 0x0F), (4, 0xF0, 0x07)):
        which = np.flatnonzero((lead >= low) & (lead < (0xE0, 0xF0, 0x100)[size - 2]))
        value = lead[which] & mask
        for k in range(1, size):
            value = (value << 6) | (padded[starts[which] + k] & 0x3F)
        out[which] = value
    return out, starts


# Symbols of the automaton. GLUE is a plain blank that joins the token after it; TAIL is white space
# that is last before something else and stands alone; CUT1 and CUT2 are apostrophes that open an
# ending of one or two letters if a token begins at them; END restarts everything at a text's start.
GLUE, TAIL, CUT1, CUT2, N_SYMBOLS = 4, 5, 6, 7, 8
# States: what the token under way consists of. AFTER_GLUE: only the plain blank so far. DUE2, DUE1:
# letters of an ending still to come. DONE: the token is complete, the next code point begins one.
S_LETTER, S_NUMBER, S_OTHER, S_SPACE, AFTER_GLUE, DUE2, DUE1, DONE = range(8)


def transitions() -> tuple[np.ndarray, np.ndarray]:
    """(next state, does a token begin here), both by [symbol, state]."""
    move = np.zeros((N_SYMBOLS, 8), dtype=np.uint8)
    begins = np.zeros((N_SYMBOLS, 8), dtype=bool)
    for state in range(8):
        for symbol in range(N_SYMBOLS):
            due = state in (DUE2, DUE1) and symbol == LETTER
            if due:
                move[symbol, state], begins[symbol, state] = (DUE1 if state == DUE2 else DONE), False
                continue
            goal = {LETTER: S_LETTER, NUMBER: S_NUMBER, OTHER: S_OTHER, SPACE: S_SPACE, GLUE: AFTER_GLUE, TAIL: DONE}.get(symbol, S_OTHER)
            joins = state == goal and goal <= S_SPACE or state == AFTER_GLUE and goal <= S_OTHER
            if symbol in (CUT1, CUT2) and not joins:
                goal = DUE1 if symbol == CUT1 else DUE2
            move[symbol, state], begins[symbol, state] = goal, not joins
    return move, begins


def symbols(points: np.ndarray, first: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Symbol of every code point; what follows is only looked at within the same text."""
    kind = table[points]
    out = kind.copy()
    n = len(points)
    last = np.zeros(n, dtype=bool)
    last[first[1:][np.diff(first) > 0] - 1] = True
    after = np.full(n, SPACE, dtype=np.uint8)
    after[:-1] = kind[1:]
    closing = (kind == SPACE) & (after != SPACE) & ~last
    out[closing] = np.where(points[closing] == 0x20, GLUE, TAIL)
    marks = np.flatnonzero((points == 0x27) & ~last)
    if len(marks):
        padded = np.concatenate([points, [0, 0]])
        text = np.searchsorted(first, marks, side="right")
        one, two = padded[marks + 1], np.where(marks + 2 < first[text], padded[marks + 2], 0)
        long = np.zeros(len(marks), dtype=bool)
        short = np.zeros(len(marks), dtype=bool)
        for ending in ENDINGS:
            codes = [ord(c) for c in ending]
            if len(codes) == 1:
                short |= one == codes[0]
            else:
                long |= (one == codes[0]) & (two == codes[1])
        out[marks[long]] = CUT2
        out[marks[short]] = CUT1
    return out


def boundaries(syms: np.ndarray, first: np.ndarray, move: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """True where a token begins. A text's first code point always begins one."""
    n = len(syms)
    if not n:
        return np.zeros(0, dtype=bool)
    # A text's first code point maps every state to the same: the state after DONE.
    fresh = np.zeros(n, dtype=bool)
    fresh[first[:-1][np.diff(first) > 0]] = True
    code = (syms + np.where(fresh, N_SYMBOLS, 0).astype(np.uint8)) * np.uint8(8)
    whole = np.concatenate([move, np.repeat(move[:, DONE : DONE + 1], 8, axis=1)]).ravel()
    opens = np.concatenate([begins, np.ones_like(begins)]).ravel()
    width = max(TAIL_ROWS, int(np.sqrt(n)))
    stripes = -(-n // width)
    padded = np.zeros(stripes * width, dtype=np.uint8)
    padded[:n] = code
    grid = padded.reshape(stripes, width).T.copy()
    # The function of each stripe: the state it ends in, by the state it begins in. Most symbols map
    # all states to one, so the last rows alone give it, unless a stripe ends in one long word.
    ends = composed(grid[-TAIL_ROWS:], whole)
    open_ = np.flatnonzero((ends != ends[:, :1]).any(axis=1))
    if len(open_):
        ends[open_] = composed(grid[:, open_], whole)
    # Inclusive scan by doubling: after it, entry i is the function of all stripes up to i.
    reach = 1
    while reach < stripes:
        joined = np.take_along_axis(ends[reach:], ends[:-reach].astype(np.int64), axis=1)
        ends = np.concatenate([ends[:reach], joined])
        reach *= 2
    state = np.full(stripes, DONE, dtype=np.uint8)
    state[1:] = ends[:-1, DONE]
    out = np.empty((width, stripes), dtype=bool)
    for i, row in enumerate(grid):
        at = row + state
        opens.take(at, out=out[i])
        state = whole.take(at)
    return out.T.reshape(-1)[:n]


def composed(grid: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """The function of every column: its last state, by [column, first state]."""
    ends = np.repeat(np.arange(8, dtype=np.uint8)[None, :], grid.shape[1], axis=0)
    for row in grid:
        ends = whole.take(row[:, None] + ends)
    return ends


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one slice: the adjacent pair of lowest rank is joined first, leftmost on ties."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    if len(piece) > SHORT:
        return merge_long(piece, ranks)
    none = len(ranks) + 1
    parts = [piece[i : i + 1] for i in range(len(piece))]
    joined = [ranks.get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
    while joined and (least := min(joined)) != none:
        i = joined.index(least)
        parts[i] += parts.pop(i + 1)
        joined.pop(i)
        if i:
            joined[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
        if i < len(joined):
            joined[i] = ranks.get(parts[i] + parts[i + 1], none)
    return [ranks[part] for part in parts]


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same for a slice of any length, with a heap of pairs instead of repeated searches."""
    n = len(piece)
    end = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    after = [*range(1, n), -1]
    alive = [True] * n
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j >= 0:
            rank = ranks.get(piece[i : end[j]])
            if rank is not None:
                heapq.heappush(heap, (rank, i, end[j]))

    for i in range(n):
        offer(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or after[i] < 0 or end[after[i]] != stop:
            continue
        j = after[i]
        alive[j] = False
        end[i], after[i] = end[j], after[j]
        if after[i] >= 0:
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


class Codec:
    """Encoder and decoder of one task."""

    def __init__(self, rank_file: bytes) -> None:
        pairs = (line.split() for line in rank_file.splitlines() if line.strip())
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.sizes = np.array([len(t) for t in tokens], dtype=np.int64)
        self.place = np.concatenate([[0], np.cumsum(self.sizes)])
        self.body = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.table = class_table()
        self.move, self.begins = transitions()
        self.forget()

    def forget(self) -> None:
        """Empty the cache: sorted hashes of slices, place and number of the ids of each."""
        self.known = np.zeros(0, dtype=np.uint64)
        self.at = self.count = np.zeros(0, dtype=np.int64)
        self.pool = np.zeros(0, dtype=np.uint32)

    def learn(self, hashes: np.ndarray, parts: list[bytes]) -> None:
        """Merge slices that the cache has not."""
        ids = [merge(part, self.ranks) for part in parts]
        count = np.array([len(x) for x in ids], dtype=np.int64)
        at = len(self.pool) + np.concatenate([[0], np.cumsum(count)])[:-1]
        self.pool = np.concatenate([self.pool, np.array([i for x in ids for i in x], dtype=np.uint32)])
        where = np.searchsorted(self.known, hashes)
        self.known = np.insert(self.known, where, hashes)
        self.at, self.count = np.insert(self.at, where, at), np.insert(self.count, where, count)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and where each text's ids begin."""
        points, starts = code_points(data)
        first = np.searchsorted(starts, offsets)
        syms = symbols(points, first, self.table)
        begin = starts[boundaries(syms, first, self.move, self.begins)]
        end = np.append(begin[1:], len(data))
        hashes = ta.slice_hashes(data, begin, end)
        distinct, sample, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) > CACHE:
            self.forget()
        at = np.searchsorted(self.known, distinct)
        new = at == len(self.known)
        new[~new] = self.known[at[~new]] != distinct[~new]
        if new.any():
            body, fresh = data.tobytes(), sample[new]
            self.learn(distinct[new], [body[s:e] for s, e in zip(begin[fresh].tolist(), end[fresh].tolist(), strict=True)])
            at = np.searchsorted(self.known, distinct)
        at = at[which]
        counts = self.count[at]
        total = np.concatenate([[0], np.cumsum(counts)])
        return self.pool[gather(self.at[at], counts, total)], total[np.searchsorted(begin, offsets)]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of a sequence of ids."""
        sizes = self.sizes[ids]
        total = np.concatenate([[0], np.cumsum(sizes)])
        return self.body[gather(self.place[ids], sizes, total)]

    def token_offsets(self, ids: np.ndarray) -> np.ndarray:
        """Byte at which each token begins."""
        return np.concatenate([[0], np.cumsum(self.sizes[ids])])[:-1] if len(ids) else np.zeros(0, np.int64)


def gather(base: np.ndarray, counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Indices base, base+1, … of each entry, one after another."""
    return np.arange(total[-1]) + np.repeat(base - total[:-1], counts)


def coder(rank_file: bytes, text: str, full: bool):
    """Task code: ids, offsets and digests of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(rank_file)
        for batch in batches:
            for piece in ta.pieces(batch, text, PIECE_BYTES):
                data, offsets = ta.flat(piece.column(piece.schema.get_field_index(text)))
                ids, first = codec.encode(data, offsets)
                ids = ids.astype("<u4")
                raw = ids.tobytes()
                plain = codec.decode(ids).tobytes()
                ends = np.concatenate([[0], np.cumsum(codec.sizes[ids])])[first]
                rows = range(piece.num_rows)
                added = {
                    "n_tokens": pa.array(np.diff(first), pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(raw[4 * first[i] : 4 * first[i + 1]]).hexdigest() for i in rows], pa.string()),
                    "decoded_sha256": pa.array([hashlib.sha256(plain[ends[i] : ends[i + 1]]).hexdigest() for i in rows], pa.string()),
                }
                if full:
                    begins = codec.token_offsets(ids) - np.repeat(ends[:-1], np.diff(first))
                    places = pa.array(first, pa.int32())
                    added["ids"] = pa.ListArray.from_arrays(places, pa.array(ids.astype(np.int32)))
                    added["offsets"] = pa.ListArray.from_arrays(places, pa.array(begins.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([*piece.columns, *added.values()], names=[*piece.schema.names, *added])

    return run


DIGESTS = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def encode(docs: DataFrame, rank_path: str, text: str = "text", full: bool = True) -> DataFrame:
    """``docs`` with n_tokens, ids_sha256, decoded_sha256 and, if ``full``, ids and token offsets.

    The rank file is read on the driver, at most some MB, and sent to the tasks with the code. Offsets count UTF-8 bytes of
    the text. A null text is encoded like an empty one, to no ids. Columns of ``docs`` that are
    named like a result column are replaced.
    """
    with open(rank_path, "rb") as file:
        ranks = file.read()
    results = ["n_tokens", "ids_sha256", "decoded_sha256"] + (["ids", "offsets"] if full else [])
    source, names = shielded(docs, "n_tokens", "ids_sha256", "decoded_sha256", "ids", "offsets")
    schema = f"{schema_of(source)}, {DIGESTS}" + (", ids array<int>, offsets array<bigint>" if full else "")
    return restored(source.mapInArrow(coder(ranks, names[text], full), schema), names, *results)


def decoder(rank_file: bytes, ids: str):
    """Task code: the text of every id list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(rank_file)
        for batch in batches:
            out = []
            for row in batch.column(batch.schema.get_field_index(ids)):
                own = row.values.to_numpy(zero_copy_only=False).astype(np.int64) if row.is_valid else np.zeros(0, np.int64)
                out.append(codec.decode(own).tobytes().decode("utf-8", "replace") if row.is_valid else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, "decoded"])

    return run


def decode(df: DataFrame, rank_path: str, ids: str = "ids") -> DataFrame:
    """``df`` with the text of each list of ids as ``decoded``; null for a null list."""
    with open(rank_path, "rb") as file:
        ranks = file.read()
    source, names = shielded(df, "decoded")
    out = source.mapInArrow(decoder(ranks, names[ids]), f"{schema_of(source)}, decoded string")
    return restored(out, names, "decoded")


def default_ranks() -> str:
    """The public 50k byte-level vocabulary, as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def digest(encoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """The columns of the registered query."""
    return encoded.select(F.col(key), "n_tokens", "ids_sha256", "decoded_sha256")
