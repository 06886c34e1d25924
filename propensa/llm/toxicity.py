"""Toxicity: a lexicon trie searched by Levenshtein automata, with scores of the words around a hit.

The lexicon is learned: words that occur far more often in toxic than in clean labelled documents.
So are stems that several such words begin with. Both are kept as a trie. For a word of a text, the Levenshtein automaton (all strings within one edit,
as two bit masks of positions) is walked along the trie, so that misspelled terms are found without
listing spellings; terms shorter than five letters must be met exactly. A hit between quotation
marks counts as quotation, other hits near it as abuse. A logistic regression over these counts,
fitted on labelled rows that the lexicon has not seen, turns them into a score.

Fitting looks at no more than ``FIT_ROWS`` labelled documents, chosen by a hash of their id; scoring
covers every document. Neither language, source nor id is an input of the score.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propensa.llm import textarrays as ta
from propensa.llm.shield import restored, schema_of, shielded
from propensa.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Labelled documents that a fit looks at, at most.
FIT_ROWS = 20_000
THRESHOLD = 0.3
#: A term occurs in so many different toxic texts and in that share of them at least, and its share
#: among toxic texts is so many times its share among clean ones.
LEAST_TEXTS, LEAST_SHARE, LEAST_RATIO = 3, 0.005, 20.0
#: Letters of a term from which one edit is allowed, and words on either side of a hit that are looked at.
FUZZY_FROM, NEAR = 5, 5
FEATURES = ["exact", "stem", "fuzzy", "quoted", "weight", "clustered", "share"]
# Letters of a stem, the beginning of several terms, which a word must begin with exactly.
STEMS = (5, 8)
STEM = "*"
# Opening or closing quotation marks, as UTF-8.
QUOTES = ('"', "“", "”", "„", "«", "»", "‹", "›")


def letters() -> np.ndarray:
    """True for bytes of words: a-z, 0-9 and all beyond ASCII."""
    table = np.zeros(256, dtype=bool)
    table[0x30:0x3A] = table[0x61:0x7B] = table[0x80:] = True
    return table


class Trie:
    """Terms as nested nodes: (children by letter, [term that ends here, stem that ends here]), -1 for none."""

    def __init__(self, terms: list[str]) -> None:
        self.root: tuple[dict, list[int]] = ({}, [-1, -1])
        for number, term in enumerate(terms):
            node = self.root
            for letter in term.rstrip(STEM):
                node = node[0].setdefault(letter, ({}, [-1, -1]))
            node[1][term.endswith(STEM)] = number
        self.terms = terms

    def within_one(self, word: str) -> tuple[int, int]:
        """(number, kind) of the best match, -1 if there is none.

        Kinds, best first: 0 the term itself, 1 a stem that the word begins with, 2 one edit away.
        """
        n = len(word)
        at = {}
        for i, letter in enumerate(word):
            at[letter] = at.get(letter, 0) | 1 << i
        end = 1 << n
        best = (3, -1)
        # Bit i of a mask: the first i letters of the word are read, with no edit or with one.
        stack = [(self.root, 1, 2)]
        while stack:
            (children, (term, stem)), none, one = stack.pop()
            if term >= 0 and none & end:
                best = min(best, (0, term))
            elif term >= 0 and one & end and min(n, len(self.terms[term])) >= FUZZY_FROM:
                best = min(best, (2, term))
            if stem >= 0 and none:
                best = min(best, (1, stem))
            for letter, child in children.items():
                mask = at.get(letter, 0)
                now = (none & mask) << 1
                edited = (one & mask) << 1 | none | none << 1 | now << 1
                if now or edited:
                    stack.append((child, now, edited))
        return (best[1], best[0]) if best[1] >= 0 else (-1, 0)


def halves(terms: list[str]) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray]]:
    """Hashes of the first and last halves of the terms, by length in bytes.

    One edit leaves the first or the second half of a term as it is, so a word with neither cannot match.
    """
    front: dict[int, set[int]] = {}
    back: dict[int, set[int]] = {}
    for term in terms:
        whole = len(term) < FUZZY_FROM or term.endswith(STEM)
        term = term.rstrip(STEM)
        raw = np.frombuffer(term.encode(), dtype=np.uint8)
        cut = len(raw) if whole else len(term[: len(term) // 2].encode())
        for table, part in ((front, raw[:cut]), (back, raw[cut:])):
            if len(part):
                h = ta.slice_hashes(part, np.array([0]), np.array([len(part)]))[0]
                table.setdefault(len(part), set()).add(int(h))
    pack = lambda t: {k: np.array(sorted(v), dtype=np.uint64) for k, v in t.items()}
    return pack(front), pack(back)


class Matcher:
    """Finds terms among the words of a piece; remembers what it has looked up."""

    def __init__(self, terms: list[str], weights: list[float]) -> None:
        self.trie = Trie(terms)
        self.weights = np.array([*weights, 0.0])
        self.front, self.back = halves(terms)
        self.belongs = letters()
        self.known: dict[bytes, tuple[int, int]] = {}

    def hits(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the word, term, kind) of every word that matches."""
        possible = np.zeros(len(starts), dtype=bool)
        size = ends - starts
        for tables, from_end in ((self.front, False), (self.back, True)):
            for length, wanted in tables.items():
                long = np.flatnonzero(size >= length)
                s = ends[long] - length if from_end else starts[long]
                h = ta.slice_hashes(data, s, s + length)
                at = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
                possible[long[wanted[at] == h]] = True
        body = data.tobytes()
        where, term, kind = [], [], []
        if len(self.known) > 500_000:
            self.known.clear()
        for i in np.flatnonzero(possible).tolist():
            word = body[starts[i] : ends[i]]
            got = self.known.get(word)
            if got is None:
                got = self.known[word] = self.trie.within_one(word.decode("utf-8", "ignore"))
            if got[0] >= 0:
                where.append(i)
                term.append(got[0])
                kind.append(got[1])
        return np.array(where, dtype=np.int64), np.array(term, dtype=np.int64), np.array(kind, dtype=np.int64)


def marks(data: np.ndarray) -> np.ndarray:
    """Bytes at which a quotation mark begins, ascending."""
    found = [np.flatnonzero(data == 0x22)]
    for mark in QUOTES[1:]:
        raw = mark.encode()
        at = np.flatnonzero(data[: len(data) - len(raw) + 1] == raw[0]) if len(data) >= len(raw) else np.zeros(0, np.int64)
        for k in range(1, len(raw)):
            at = at[data[at + k] == raw[k]]
        found.append(at)
    return np.sort(np.concatenate(found))


def measure(matcher: Matcher, column: pa.Array) -> dict[str, np.ndarray]:
    """The features of every text."""
    lowered = pa.array([None if x is None else x.lower() for x in column.to_pylist()], pa.string())
    data, offsets = ta.flat(lowered)
    starts, ends, first = ta.slices(data, offsets, matcher.belongs)
    where, term, kind = matcher.hits(data, starts, ends)
    text = np.searchsorted(first, where, side="right") - 1
    quote = marks(data)
    # The words NEAR places before and after, within the text.
    low = starts[np.maximum(where - NEAR, first[text])]
    high = ends[np.minimum(where + NEAR, first[text + 1] - 1)]
    before = np.searchsorted(quote, starts[where]) - np.searchsorted(quote, low)
    after = np.searchsorted(quote, high) - np.searchsorted(quote, ends[where])
    quoted = (before > 0) & (after > 0)
    same = np.zeros(len(where), dtype=bool)
    same[1:] = (text[1:] == text[:-1]) & (np.diff(where) <= 2 * NEAR)
    n = len(column)
    words = np.diff(first)
    count = lambda which: np.bincount(text[which], minlength=n).astype(float)
    abuse = ~quoted
    weight = np.bincount(text[abuse], weights=matcher.weights[term[abuse]] * np.where(kind[abuse] == 2, 0.5, 1.0), minlength=n)
    total = count(abuse)
    return {
        "exact": np.log1p(count(abuse & (kind == 0))),
        "stem": np.log1p(count(abuse & (kind == 1))),
        "fuzzy": np.log1p(count(abuse & (kind == 2))),
        "quoted": np.log1p(count(quoted)),
        "weight": np.log1p(weight),
        "clustered": np.log1p(count(same & abuse)),
        "share": np.log1p(100 * total / np.maximum(words, 1)),
    }


def features_task(terms: list[str], weights: list[float], text: str):
    """Task code: the given columns and the features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(terms, weights)
        for batch in batches:
            for piece in ta.pieces(batch, text):
                found = measure(matcher, piece.column(piece.schema.get_field_index(text)))
                yield pa.RecordBatch.from_arrays(
                    [*piece.columns, *(pa.array(found[f]) for f in FEATURES)],
                    names=[*piece.schema.names, *(f"{f}_" for f in FEATURES)],
                )

    return run


def held_out(key: Column) -> Column:
    """Rows that no label is learned from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def lexicon(sample: DataFrame) -> list[tuple[str, float]]:
    """(term, log of the ratio of its shares) by weight, from a bounded table (text, toxic).

    A word counts once per family of texts: texts whose smallest hash of two adjacent words is the
    same, such as copies of one another, are one family.
    """
    words = F.split(F.lower(F.col("text")), r"[^0-9a-z\x{80}-\x{10FFFF}]+")
    hashed = sample.select("toxic", words.alias("all")).select(
        "toxic",
        F.array_distinct("all").alias("words"),
        F.array_min(F.transform("all", lambda w, i: F.xxhash64(w, F.get("all", i + 1)))).alias("family"),
    )
    families = hashed.groupBy("toxic").agg(F.count_distinct("family").alias("n"))
    sizes = {r["toxic"]: r["n"] for r in families.collect()}
    if len(sizes) < 2:
        return []
    low, high = STEMS
    cuts = F.transform(F.sequence(F.lit(low), F.lit(high)), lambda k: F.when(F.length("word") > k, F.concat(F.col("word").substr(F.lit(1), k), F.lit(STEM))))
    each = hashed.select("toxic", "family", F.explode("words").alias("word")).where(F.length("word") >= 3)
    each = each.select("toxic", "family", "word", F.explode(F.concat(F.array("word"), F.filter(cuts, lambda x: x.isNotNull()))).alias("term"))
    least = max(LEAST_TEXTS, sizes[1] * LEAST_SHARE)
    stem = F.col("term").endswith(STEM)
    bad = (
        each.where("toxic = 1").groupBy("term")
        .agg(F.count_distinct("family").alias("bad"), F.count_distinct("word").alias("kinds"))
        .where((F.col("bad") >= least) & (~stem | (F.col("kinds") >= 3)))
    )
    good = each.where("toxic = 0").join(bad, "term", "left_semi").groupBy("term").agg(F.count_distinct("family").alias("good"))
    ratio = (F.col("bad") / sizes[1]) / ((F.coalesce(F.col("good"), F.lit(0)) + 0.5) / sizes[0])
    chosen = bad.join(good, "term", "left").where(ratio >= LEAST_RATIO).select("term", F.log(ratio).alias("weight"))
    # At most as many terms as words in FIT_ROWS texts; in practice some hundreds.
    found = [(r["term"], round(r["weight"], 6)) for r in chosen.orderBy(F.length("term"), "term").collect()]
    stems: set[str] = set()
    out = []
    for term, weight in found:
        if term.endswith(STEM):
            if any(term[:k] in stems for k in range(low, len(term) - 1)):
                continue
            stems.add(term[:-1])
        out.append((term, weight))
    return out


class Model:
    """A lexicon and the coefficients over its features."""

    def __init__(self, terms: list[tuple[str, float]], intercept: float, coefficients: list[float]) -> None:
        self.terms, self.intercept, self.coefficients = terms, intercept, coefficients

    def features(self, docs: DataFrame, text: str) -> DataFrame:
        names = [t for t, _ in self.terms]
        schema = f"{schema_of(docs)}, " + ", ".join(f"{f}_ double" for f in FEATURES)
        return docs.mapInArrow(features_task(names, [w for _, w in self.terms], text), schema)

    def score(self, docs: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
        """``docs`` with score and predicted; columns of these names are replaced."""
        given, names = shielded(docs, "score", "predicted")
        z = F.lit(self.intercept)
        for name, weight in zip(FEATURES, self.coefficients, strict=True):
            z = z + F.lit(weight) * F.col(f"{name}_")
        score = 1 / (1 + F.exp(-z))
        return restored(
            self.features(given, names[text]), names, score.alias("score"), (score >= threshold).cast("int").alias("predicted")
        )


def fit(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = FIT_ROWS
) -> Model:
    """A model from at most ``rows`` labelled documents that are not held out.

    Two thirds of them give the lexicon, the others the coefficients. Labels other than 0 and 1 are
    passed over; of several labels of one document the largest counts. Without both labels the score
    is a constant, the share of label 1 smoothed by one row of which a tenth is toxic.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    known = (
        labels.select(F.col(key).alias("id"), F.col(label).cast("int").alias("toxic"))
        .where(F.col("toxic").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id")))
        .groupBy("id").agg(F.max("toxic").alias("toxic"))
    )
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(rows)
    texts = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # At most ``rows`` pairs of numbers are sent to all tasks.
    sample = cut_lineage(texts.join(F.broadcast(chosen), "id"), "labelled")
    part = F.pmod(F.xxhash64("id", F.lit("part")), F.lit(3))
    terms = lexicon(sample.where(part < 2))
    model = Model(terms, 0.0, [0.0] * len(FEATURES))
    measured = cut_lineage(model.features(sample.where(part == 2).select("text", "toxic"), "text").drop("text"), "features")
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    half = {r["toxic"] for r in measured.groupBy("toxic").count().collect()}
    if len(half) < 2 or not terms:
        odds = (sizes.get(1, 0) + 0.1) / (sizes.get(0, 0) + 0.9)
        return Model(terms, math.log(odds), [0.0] * len(FEATURES))
    assembled = VectorAssembler(inputCols=[f"{f}_" for f in FEATURES], outputCol="features").transform(measured)
    fitted = LogisticRegression(labelCol="toxic", regParam=1e-3, maxIter=100).fit(assembled)
    return Model(terms, float(fitted.intercept), [float(c) for c in fitted.coefficients])


def digest(scored: DataFrame, key: str = "doc_id") -> DataFrame:
    """The columns of the registered query."""
    return scored.select(key, held_out(F.col(key)).alias("held_out"), "score", "predicted")
