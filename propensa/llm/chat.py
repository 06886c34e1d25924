"""Chat formatting: roles of transcript lines by a hidden Markov model, then canonical turns.

A transcript is a sequence of lines. The hidden state of a line is its speaker's role and whether it
opens a turn; what is seen of it is a symbol: the kind of speaker marker, whether a blank line or a question
came before, and its length. Transitions and emissions are counted on transcripts with known
roles. Viterbi finds the likeliest states, so that turns without a marker are told by what
is around them.

A conversation may hold any share of the lines. It is cut into blocks; a block is summed up by the
best score from each state before it to each state at its end, a small matrix, and such matrices
multiply in the max-plus sense. Matrices are combined over levels of ``FAN`` each, the states
at the ends are fixed from the top down, and each block is then decoded on its own between
two known states. The result is the same as decoding the conversation in one go.
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
from propensa.llm.jaccard import groups
from propensa.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROLES = ["system", "user", "assistant"]
#: States: role * 2 + (0 opens a turn, 1 goes on); before the first line the state is BEFORE.
STATES, BEFORE = 6, 6
MARKERS, LENGTHS = 5, 3
SYMBOLS = MARKERS * 2 * 2 * 2 * LENGTHS
#: Blocks of a conversation that are combined at once, and turns of one block in :func:`transcripts`.
FAN, BLOCK_TURNS = 256, 64
NOWHERE = -(1 << 63)

# Speaker names by role, and the ways of writing a marker.
NAMES = {
    "system": "system|sys|context|instructions?|prompt",
    "user": "user|human|customer|client|question|q|prompter|you",
    "assistant": "assistant|ai|bot|agent|model|answer|a|chatgpt|gpt",
}
EVERY = "|".join(NAMES.values())
OPENING = rf"^\s*(?:#+\s*)?[\[<(*]*({EVERY})[\])*]*\s*(?::|>|\]|-|$)[\])*]*\s*"
STRIP = rf"(?i){OPENING}"
UNKNOWN = r"^\s*(?:#+\s*)?[\[<(*]*[A-Z][A-Za-z0-9_]{1,20}[\])*]*\s*[:>](?:\s|$)"


def symbol(line: Column, previous: Column) -> Column:
    """What is seen of a line; ``previous`` is the line before it, null for none."""
    name = F.lower(F.regexp_extract(line, STRIP, 1))
    marker = F.when(line.rlike(STRIP), F.when(name.rlike(f"^(?:{NAMES['user']})$"), 1).when(name.rlike(f"^(?:{NAMES['assistant']})$"), 2).otherwise(3))
    marker = F.coalesce(marker, F.when(line.rlike(UNKNOWN), 4).otherwise(0))
    blank = F.coalesce((F.trim(previous) == "").cast("int"), F.lit(0))
    asked = F.coalesce(F.rtrim(previous).endswith("?").cast("int"), F.lit(0))
    empty = (F.trim(line) == "").cast("int")
    size = F.when(F.length(line) < 20, 0).when(F.length(line) < 120, 1).otherwise(2)
    return ((((marker * 2 + blank) * 2 + asked) * 2 + empty) * LENGTHS + size).cast("int")


def lines_of(turns: DataFrame, conv: str, block: str, turn: str, text: str) -> DataFrame:
    """Lines of raw transcript pieces: conv, block, turn, pos, line, sym.

    ``turn`` orders the pieces, ``block`` ascends with it. The line before the first of a piece is
    taken to be the piece's ``before`` column where there is one.
    """
    pieces = turns.withColumn("all_", F.split(F.coalesce(F.col(text), F.lit("")), "\n"))
    extra = [c for c in ("role", "before") if c in turns.columns]
    each = pieces.select(conv, block, turn, *extra, "all_", F.posexplode("all_").alias("pos", "line"))
    earlier = F.get("all_", F.col("pos") - 1)
    if "before" in turns.columns:
        earlier = F.when(F.col("pos") == 0, F.col("before")).otherwise(earlier)
    return each.withColumn("sym", symbol(F.col("line"), earlier)).drop("all_", "before")


def in_blocks(lines: DataFrame) -> DataFrame:
    return lines.repartition("conv", "block").sortWithinPartitions("conv", "block", "turn", "pos", "line")


def each_group(table: pa.Table) -> Iterator[tuple[int, int]]:
    conv, block = (table.column(c).to_numpy() for c in ("conv", "block"))
    new = np.ones(len(conv), dtype=bool)
    new[1:] = (conv[1:] != conv[:-1]) | (block[1:] != block[:-1])
    starts = np.append(np.flatnonzero(new), len(conv))
    yield from zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)


def count_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task code: transitions and emissions within blocks of lines whose state is known."""
    moves = np.zeros((STATES + 1, STATES), dtype=np.int64)
    seen = np.zeros((STATES, SYMBOLS), dtype=np.int64)
    for table in groups(batches, ["conv", "block"]):
        state, sym, block = (table.column(c).to_numpy() for c in ("state", "sym", "block"))
        np.add.at(seen, (state, sym), 1)
        for s, e in each_group(table):
            before = np.concatenate([[BEFORE if block[s] == 0 else state[s]], state[s : e - 1]])
            first = 0 if block[s] == 0 else 1
            np.add.at(moves, (before[first:], state[s + first : e]), 1)
    for kind, counts in ((0, moves), (1, seen)):
        i, j = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(i), kind, dtype=np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(counts[i, j])],
            names=["kind", "i", "j", "n"],
        )


class Model:
    """Log probabilities: ``moves`` [state before or BEFORE, state], ``seen`` [state, symbol]."""

    def __init__(self, moves: np.ndarray, seen: np.ndarray) -> None:
        self.moves, self.seen = moves, seen

    def steps(self, sym: np.ndarray) -> np.ndarray:
        """The matrix of each line: score from the state before it to its own."""
        full = np.full((len(sym), STATES + 1, STATES + 1), -np.inf)
        full[:, :, :STATES] = self.moves[None] + self.seen.T[sym][:, None, :]
        return full


def fit(lines: DataFrame) -> Model:
    """Counts with half a count added to each, from lines with a ``state``."""
    counts = in_blocks(lines).mapInArrow(count_task, "kind int, i int, j int, n bigint")
    moves, seen = np.full((STATES + 1, STATES), 0.5), np.full((STATES, SYMBOLS), 0.5)
    # At most one row per transition and emission of the model.
    for r in counts.groupBy("kind", "i", "j").agg(F.sum("n").alias("n")).collect():
        (seen if r["kind"] else moves)[r["i"], r["j"]] += r["n"]
    return Model(np.log(moves / moves.sum(1, keepdims=True)), np.log(seen / seen.sum(1, keepdims=True)))


def product(steps: np.ndarray) -> np.ndarray:
    """Max-plus product of matrices, by halves."""
    while len(steps) > 1:
        odd = steps[-1:] if len(steps) % 2 else steps[:0]
        left, right = steps[0 : len(steps) - len(odd) : 2], steps[1 : len(steps) - len(odd) : 2]
        steps = np.concatenate([(left[:, :, :, None] + right[:, None, :, :]).max(axis=2), odd])
    return steps[0]


def best_path(steps: np.ndarray, first: int, last: int | None) -> list[int]:
    """The states after each matrix on the best way from ``first``, to ``last`` if it is given."""
    score = np.full(STATES + 1, -np.inf)
    score[first] = 0
    back = np.empty((len(steps), STATES + 1), dtype=np.int64)
    for k, step in enumerate(steps):
        total = score[:, None] + step
        back[k] = total.argmax(axis=0)
        score = total.max(axis=0)
    state = int(score.argmax()) if last is None else last
    out = []
    for k in range(len(steps) - 1, -1, -1):
        out.append(state)
        state = int(back[k, state])
    return out[::-1]


def matrices(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy()
    return flat.reshape(-1, STATES + 1, STATES + 1)


def summary_task(model: Model | None):
    """Task code: the matrix of each block, from its lines or from the matrices of smaller blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["conv", "block"]):
            conv, block = (table.column(c).to_numpy() for c in ("conv", "block"))
            own = model.steps(table.column("sym").to_numpy()) if model else matrices(table.column("m"))
            spans = list(each_group(table))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([conv[s] for s, _ in spans], pa.int64()), pa.array([block[s] for s, _ in spans], pa.int64()),
                    pa.array([product(own[s:e]).ravel() for s, e in spans], pa.list_(pa.float64())),
                ],
                names=["conv", "block", "m"],
            )

    return run


def ends_task(top: bool):
    """Task code: states before and at the end of each smaller block, from those of the block around it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["conv", "block"]):
            own = matrices(table.column("m"))
            conv, small = (table.column(c).to_numpy() for c in ("conv", "small"))
            before, after = np.empty(len(conv), dtype=np.int32), np.empty(len(conv), dtype=np.int32)
            for s, e in each_group(table):
                first = BEFORE if top else table.column("first")[s].as_py()
                path = best_path(own[s:e], first, None if top else table.column("last")[s].as_py())
                before[s:e], after[s:e] = [first, *path[:-1]], path
            yield pa.RecordBatch.from_arrays(
                [pa.array(conv), pa.array(small), pa.array(before), pa.array(after)], names=["conv", "block", "first", "last"]
            )

    return run


def decode_task(model: Model):
    """Task code: the state of each line of blocks whose ends are known, and its number of turns so far in the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["conv", "block"]):
            steps = model.steps(table.column("sym").to_numpy())
            state = np.empty(table.num_rows, dtype=np.int32)
            opened = np.empty(table.num_rows, dtype=np.int64)
            for s, e in each_group(table):
                state[s:e] = best_path(steps[s:e], table.column("first")[s].as_py(), table.column("last")[s].as_py())
                opened[s:e] = np.cumsum(state[s:e] % 2 == 0)
            names = ["conv", "block", "turn", "pos", "line"]
            whole = table.select(names).append_column("state", pa.array(state)).append_column("opened", pa.array(opened))
            yield from whole.to_batches()

    return run


def decode(lines: DataFrame, model: Model) -> DataFrame:
    """Lines with their likeliest state and ``opened``, the turns opened in their block up to them."""
    ordered = in_blocks(lines.select("conv", "block", "turn", "pos", "line", "sym"))
    kind = "conv bigint, block bigint, m array<double>"
    levels = [cut_lineage(ordered.mapInArrow(summary_task(model), kind), "blocks")]
    while (levels[-1].agg(F.max("block").alias("b")).first()["b"] or 0) >= FAN:
        nested = _nested(levels[-1]).repartition("conv", "block").sortWithinPartitions("conv", "block", "small")
        levels.append(cut_lineage(nested.select("conv", "block", "m").mapInArrow(summary_task(None), kind), "blocks"))
    ends = None
    out = "conv bigint, block bigint, first int, last int"
    for level in reversed(levels):
        if ends is None:
            inner = level.select("conv", F.lit(0).cast("bigint").alias("block"), F.col("block").alias("small"), "m")
        else:
            inner = _nested(level).join(ends, ["conv", "block"])
        inner = inner.repartition("conv", "block").sortWithinPartitions("conv", "block", "small")
        ends = inner.mapInArrow(ends_task(ends is None), out)
    ready = lines.select("conv", "block", "turn", "pos", "line", "sym").join(ends, ["conv", "block"])
    result = "conv bigint, block bigint, turn bigint, pos int, line string, state int, opened bigint"
    return in_blocks(ready).mapInArrow(decode_task(model), result)


def _nested(level: DataFrame) -> DataFrame:
    return level.select("conv", F.floor(F.col("block") / FAN).alias("block"), F.col("block").alias("small"), "m")


def turns_of(decoded: DataFrame) -> DataFrame:
    """One row per recovered turn: conv, number, role, text, rendered, n_lines.

    Blank lines at the ends of a turn and its speaker marker are not part of its text.
    """
    counts = decoded.groupBy("conv", "block").agg(F.max("opened").alias("n"))
    order = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("conv", "block", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))
    numbered = decoded.join(before, ["conv", "block"]).withColumn("number", F.col("base") + F.col("opened"))
    opens = F.col("state") % 2 == 0
    said = F.when(opens, F.regexp_replace("line", STRIP, "")).otherwise(F.col("line"))
    role = F.element_at(F.array(*[F.lit(r) for r in ROLES]), F.floor(F.col("state") / 2).cast("int") + 1)
    grouped = numbered.select("conv", "number", role.alias("role"), F.struct("block", "turn", "pos", said.alias("line")).alias("x"))
    turns = grouped.groupBy("conv", "number").agg(
        F.min("role").alias("role"), F.sort_array(F.collect_list("x")).alias("all"), F.count("*").alias("n_lines")
    )
    text = F.regexp_replace(F.array_join(F.col("all.line"), "\n"), r"^\s+|\s+$", "")
    return turns.select("conv", "number", "role", text.alias("text"), "n_lines").withColumn(
        "rendered", F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), "text", F.lit("<|im_end|>\n"))
    )


def transcripts(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Stored conversations as pieces of raw transcripts: conv, block, turn, text, role.

    Every conversation is written in one of five ways of marking speakers, chosen by a hash of its id; one
    turn in ten has no marker, only a blank line before it. A null role is written without a
    marker, a null text as an empty line.
    """
    key = F.coalesce(F.col(conv).cast("bigint"), F.lit(NOWHERE))
    style = F.pmod(F.xxhash64(key, F.lit("style")), F.lit(5))
    number = F.coalesce(F.col(turn).cast("bigint"), F.lit(0))
    bare = (F.pmod(F.xxhash64(key, number, F.lit("bare")), F.lit(10)) == 0) & (number > 0) | F.col(role).isNull()
    ways = [
        {"system": "System: ", "user": "User: ", "assistant": "Assistant: "},
        {"system": "### System:\n", "user": "### Human:\n", "assistant": "### Assistant:\n"},
        {"system": "[system] ", "user": "[user] ", "assistant": "[assistant] "},
        {"system": "Context: ", "user": "Q: ", "assistant": "A: "},
        {"system": "SYS> ", "user": "USER> ", "assistant": "BOT> "},
    ]
    marker = F.lit("")
    for i, way in enumerate(ways):
        for name, mark in way.items():
            marker = F.when((style == i) & (F.col(role) == name), F.lit(mark)).otherwise(marker)
    said = F.concat(F.when(bare, F.lit("\n")).otherwise(marker), F.coalesce(F.col(text), F.lit("")))
    return conversations.select(
        key.alias("conv"), F.floor(F.greatest(number, F.lit(0)) / BLOCK_TURNS).alias("block"), number.alias("turn"), said.alias("text"),
        F.col(role).alias("role"),
    )


def known_states(lines: DataFrame) -> DataFrame:
    """Lines of pieces with a ``role`` in ROLES, with the state that it implies: the first line that is not blank opens."""
    place = F.array_position(F.array(*[F.lit(r) for r in ROLES]), F.col("role")).cast("int") - 1
    return lines.where(F.col("role").isin(ROLES)).withColumn("state", place * 2 + (F.col("pos") > 0).cast("int"))


def format_chats(conversations: DataFrame, train: Column | None = None) -> DataFrame:
    """Stored conversations as transcripts, parsed: conv_id, turn, role, text, rendered, n_lines.

    The model is fitted on the conversations that ``train`` names, by default every second one by a hash of the
    id. Rows without id are one conversation; repeated rows are repeated in it.
    """
    pieces = transcripts(conversations)
    lines = cut_lineage(lines_of(pieces, "conv", "block", "turn", "text"), "lines")
    chosen = F.pmod(F.xxhash64("conv"), F.lit(2)) == 0 if train is None else train
    model = fit(known_states(lines.where(chosen)))
    found = turns_of(decode(lines, model))
    return found.select(
        F.when(F.col("conv") != NOWHERE, F.col("conv")).alias("conv_id"), F.col("number").alias("turn"), "role", "text", "rendered", "n_lines"
    )


def digest(found: DataFrame) -> DataFrame:
    """The columns of the registered query."""
    return found.select("conv_id", "turn", "role", "n_lines", "text", F.sha2(F.col("rendered").cast("binary"), 256).alias("rendered_sha256"))
