"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule is a measure of a text and a limit. A rule's cost and the share of rows it rejects are
estimated on a bounded sample; the cascade asks the rules in the order of rejections per cost and
stops at the first that rejects. The order changes the work, never the verdict. Everything is an
expression over one row: no shuffle, and no state between rows.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propensa.llm.shield import restored, shielded

BLANK = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Rows on which costs and selectivities are estimated.
SAMPLE_ROWS = 2_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, BLANK), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Words in windows of three that occur twice or more in the list, the first occurrence included.

    Windows are compared by a 64-bit hash of their words.
    """

    def window(i):
        return F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))

    def places(s):
        def again(x, j):
            # Out of range is null, and never equal.
            return F.get(s, j - 1)["h"].eqNullSafe(x["h"]) | F.get(s, j + 1)["h"].eqNullSafe(x["h"])

        return F.sort_array(F.transform(F.filter(s, again), lambda x: x["i"]))

    def covered(at):
        gaps = F.transform(at, lambda v, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - v, F.lit(3))))
        return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda total, x: total + x)

    def count(hashes):
        in_order = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        # Most texts repeat no window; they are spared the sort.
        unique = F.size(F.array_distinct(hashes)) == F.size(hashes)
        return F.when(unique, F.lit(0).cast("bigint")).otherwise(let(let(in_order, places), covered))

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), window)
    return F.when(F.size(words) < 3, F.lit(0).cast("bigint")).otherwise(let(windows, count))


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.

    A null text is measured like an empty one. Columns with these names are replaced.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    given, inner = shielded(docs, *names)
    t = F.coalesce(F.col(inner[text]), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.translate(x, BLANKS, "") != "")
    counted = let(
        words_of(t),
        lambda w: F.struct(F.size(w).cast("bigint").alias("n"), repeated_words(w).alias("r")),
    )
    of_lines = let(
        lines, lambda x: F.struct(F.size(x).cast("bigint").alias("n"), F.size(F.array_distinct(x)).alias("d"))
    )
    staged = given.withColumns({"words_": counted, "lines_": of_lines})
    return restored(
        staged,
        inner,
        F.col("words_.n").alias("n_words"),
        F.length(F.translate(t, BLANKS, "")).cast("bigint").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        F.col("lines_.n").alias("n_lines"),
        (F.col("lines_.n") - F.col("lines_.d")).alias("n_dup_lines"),
        F.col("words_.r").alias("n_repeat_words"),
    )


@dataclass(frozen=True)
class Rule:
    """``rejects`` says of a text column whether the rule rejects it, from nothing but the text."""

    name: str
    rejects: Callable[[Column], Column]


def _n_words(t: Column) -> Column:
    return F.size(words_of(t))


def _chars(t: Column) -> Column:
    return F.length(F.translate(t, BLANKS, ""))


# Limits, all as whole-number comparisons, so that every engine agrees on them.
SHORTEST_WORD, LONGEST_WORD = 3, 12
SYMBOL_PERCENT = 30
DUP_LINE_PERCENT = 50


def default_rules() -> list[Rule]:
    """The rules of the verdict beyond the base ones."""

    def symbols(t):
        return 100 * (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))) > SYMBOL_PERCENT * _n_words(t)

    def lines(t):
        found = F.filter(F.split(t, "\n"), lambda x: F.translate(x, BLANKS, "") != "")
        return let(found, lambda x: 100 * (F.size(x) - F.size(F.array_distinct(x))) > DUP_LINE_PERCENT * F.size(x))

    def lengths(t):
        return let(_n_words(t), lambda n: (_chars(t) < SHORTEST_WORD * n) | (_chars(t) > LONGEST_WORD * n))

    return [Rule("symbols", symbols), Rule("repeated_lines", lines), Rule("word_length", lengths)]


def base_rules() -> list[Rule]:
    """Too short, or mostly windows of words that repeat."""
    return [
        Rule("short", lambda t: _n_words(t) < 50),
        Rule("repeated_words", lambda t: let(words_of(t), lambda w: 100 * repeated_words(w) > 50 * F.size(w))),
    ]


def plan(docs: DataFrame, rules: list[Rule], text: str = "text", rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejections per second on a sample of about ``rows`` rows; ties keep the given order."""
    total = docs.count()
    if not total or len(rules) < 2:
        return rules
    t = F.coalesce(F.col(text), F.lit(""))
    sample = docs.select(t.alias("t")).sample(min(1.0, rows / total), seed=7).persist()
    try:
        sample.count()
        worth = {}
        for rule in rules:
            began = time.perf_counter()
            rejected = sample.agg(F.count_if(rule.rejects(F.col("t"))).alias("n")).first()["n"]
            worth[rule.name] = rejected / max(time.perf_counter() - began, 1e-3)
    finally:
        sample.unpersist()
    return sorted(rules, key=lambda rule: -worth[rule.name])


def cascade(text: Column, rules: list[Rule]) -> Column:
    """Name of the first rule that rejects the text, null if none does; later rules are not computed."""
    t = F.coalesce(text, F.lit(""))
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(rule.rejects(t), F.lit(rule.name)).otherwise(out)
    return out


def judge(docs: DataFrame, text: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """``docs`` with ``rejected_by``: the rule of the planned cascade that rejects the row, or null."""
    rules = plan(docs, base_rules() + default_rules() if rules is None else rules, text)
    return docs.withColumn("rejected_by", cascade(F.col(text), rules))


def measured_cascade(docs: DataFrame, text: str = "text") -> DataFrame:
    """All measures, the base verdict, and the verdict of the cascade for what passes the base."""
    rules = plan(docs.select(text), default_rules(), text)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = measures(docs, text).withColumn("base_failed", failed)
    return out.withColumn("kept", F.when(F.col("base_failed"), False).otherwise(cascade(F.col(text), rules).isNull()))


def digest(judged: DataFrame, key: str = "doc_id") -> DataFrame:
    """The columns of the registered query."""
    return judged.select(
        key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
    [x FOR x IN string_split_regex(coalesce(text, ''), '{BLANK}') IF x <> ''] AS w,
    [x FOR x IN string_split(coalesce(text, ''), chr(10))
      IF regexp_replace(x, '{BLANK}', '', 'g') <> ''] AS lines
  FROM documents),
u AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
g AS (
  SELECT doc_id, i, x, lead(x) OVER p AS x1, lead(x, 2) OVER p AS x2 FROM u
  WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
h AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x, x1, x2) AS n FROM g WHERE x2 IS NOT NULL),
r AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM h WHERE n > 1) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words,
    length(regexp_replace(t, '{BLANK}', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    len(lines)::BIGINT AS n_lines,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN r USING (doc_id)),
b AS (
  SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (NOT base_failed AND NOT 100 * n_symbols > {SYMBOL_PERCENT} * n_words
   AND NOT 100 * n_dup_lines > {DUP_LINE_PERCENT} * n_lines
   AND NOT word_chars < {SHORTEST_WORD} * n_words AND NOT word_chars > {LONGEST_WORD} * n_words) AS kept
FROM b
"""
