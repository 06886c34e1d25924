"""Exact top-k by inner product with MaxScore over postings of integer components.

A term is a component; its postings in a block of rows are the rows with a positive and those with a
negative value there. A query bounds each term by its largest product with a value of the block. Terms
with small bounds, whose sum does not beat the query's k-th best score so far, are not essential: a
row without a positive product in the other, essential ones cannot get into the result. Essential postings
are traversed, their rows keep their partial score and the remaining terms are probed, largest bounds
first, only for rows that can still compete. Blocks whose bounds do not beat the k-th score are skipped.

Rows of a shard are held in the order of their ids, so among equal scores the first found is the one to
keep, and only larger scores compete. The tops of all shards are merged by rank.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from propensa.llm import vectors
from propensa.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows that share bounds and postings.
BLOCK = 4_096
#: Terms that are traversed or probed between two looks at which rows still compete.
PROBES = 16
#: Fixed values of the registered query.
SCALE, EVERY, K = 1_024, 100, 10


class Postings:
    """Values of a block of rows by term, with the rows of either sign and the bounds of the values."""

    def __init__(self, values: np.ndarray):
        self.values = np.ascontiguousarray(values.T)
        self.positive, self.negative = self.values > 0, self.values < 0
        self.high = self.values.max(axis=1) if values.size else np.zeros(self.values.shape[0], self.values.dtype)
        self.low = self.values.min(axis=1) if values.size else self.high

    def bounds(self, query: np.ndarray) -> np.ndarray:
        """What each term can add to a score at most; a row without the term gets nothing from it."""
        return np.maximum(np.maximum(query * self.high, query * self.low), query * 0)

    def above(self, query: np.ndarray, least) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of the rows with a score above ``least``; all rows if it is None."""
        n = self.values.shape[1]
        if least is None:
            return np.arange(n), query @ self.values
        bounds = self.bounds(query)
        order = np.argsort(bounds, kind="stable")
        sums = np.cumsum(bounds[order])
        if sums.size == 0:
            return (np.arange(n), query @ self.values) if least < 0 else (np.arange(0), query[:0])
        # The rows that no essential posting holds score at most the sum of the others, and 0 with no term.
        essential = order[sums > least] if least >= 0 else order
        if not len(essential):
            return np.arange(0), query[:0]
        if least >= 0:
            up, down = essential[query[essential] > 0], essential[query[essential] < 0]
            listed = self.positive[up].any(axis=0) | self.negative[down].any(axis=0)
            rows = np.flatnonzero(listed)
        else:
            rows = np.arange(n)
        scores = np.zeros(len(rows), self.values.dtype)
        rest = sums[-1]
        falling = order[::-1]
        for start in range(0, len(falling), PROBES):
            terms = falling[start : start + PROBES]
            part = self.values[terms] if len(rows) == n else self.values[np.ix_(terms, rows)]
            scores = scores + query[terms] @ part
            rest = rest - bounds[terms].sum()
            competing = scores + rest > least
            if not competing.all():
                rows, scores = rows[competing], scores[competing]
            if not len(rows):
                break
        return rows, scores


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, the highest first, the first places among equal ones."""
    if len(scores) > 4 * k and scores.dtype != object:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        places = np.flatnonzero(scores >= kth)
        return places[np.argsort(-scores[places], kind="stable")[:k]]
    return np.argsort(-scores, kind="stable")[:k]


def search_task(k: int):
    def work(table: pa.Table):
        ids, known = vectors.ids_of(table)
        order = vectors.in_order(ids, known)
        ids, known, values = ids[order], known[order], vectors.matrix(table)[order]
        starts = range(0, len(ids), BLOCK)
        blocks = [Postings(values[s : s + BLOCK]) for s in starts]
        large = vectors.largest(values)

        def batch_tops(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            queries = vectors.matrix(batch, values.shape[1])
            numbers = batch.column("qid").to_numpy()
            fits = vectors.largest(queries) * large * max(1, values.shape[1]) < 1 << 62
            if not fits:
                exact_blocks = [Postings(values[s : s + BLOCK].astype(object)) for s in starts]
            for i, query in enumerate(queries if fits else queries.astype(object)):
                scores, places = query[:0], np.arange(0)
                for s, block in zip(starts, blocks if fits else exact_blocks):
                    least = scores[-1] if len(scores) == k else None
                    rows, found = block.above(query, least)
                    if len(rows):
                        scores, places = np.concatenate([scores, found]), np.concatenate([places, rows + s])
                        top = best(scores, k)
                        scores, places = scores[top], places[top]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(places), numbers[i]), pa.int64()),
                        pa.array(ids[places], pa.int64(), mask=~known[places]),
                        pa.array(vectors.saturated(scores), pa.int64()),
                    ],
                    ["qid", "id", "score"],
                )

        def tops(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            made = list(batch_tops(batch))
            if made:
                yield pa.Table.from_batches(made).combine_chunks().to_batches()[0] if sum(m.num_rows for m in made) else made[0]

        return tops

    return work


def top_k(rows: DataFrame, queries: DataFrame, k: int, own: bool = False) -> DataFrame:
    """(qid, rank, id, score): each query's ``k`` highest inner products with ``rows``, ties to the smaller id.

    ``rows`` holds (id long, v array<long>), ``queries`` also a unique ``qid``. A null id comes after all
    others. Shorter vectors count as filled up with zeros; an empty one scores 0. Scores beyond the range of long saturate. Unless ``own``,
    queries are rows themselves, and one row with the query's id and its score with itself is left out: another
    row like it stays, and which of the two goes makes no difference.
    """
    wanted = k if own else k + 1
    found = vectors.meet(rows, queries, vectors.shards_for(rows), search_task(wanted), "qid bigint, id bigint, score bigint")
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= wanted)
    if not own:
        itself = queries.select("qid", F.col("id").alias("self"), square().alias("square"))
        ranked = without_itself(ranked.join(itself, "qid"), "qid").where(F.col("rank") <= k)
    return ranked.select("qid", "rank", "id", "score")


def square():
    """The inner product of a vector with itself, saturated like all scores."""
    highest = F.lit((1 << 63) - 1).cast("decimal(38,0)")

    def add(total, x):
        return F.least((total + x.cast("decimal(19,0)") * x).cast("decimal(38,0)"), highest)

    return F.aggregate("v", F.lit(0).cast("decimal(38,0)"), add).cast("bigint")


def without_itself(ranked: DataFrame, query: str) -> DataFrame:
    """Ranked rows without the first that is the query's own, ranks closed up."""
    own = F.col("id").eqNullSafe(F.col("self")) & (F.col("score") == F.col("square"))
    first = F.min(F.when(own, F.col("rank"))).over(Window.partitionBy(query))
    kept = ranked.withColumn("_own", first).where(F.col("_own").isNull() | (F.col("rank") != F.col("_own")))
    moved = F.col("rank") - F.coalesce((F.col("rank") > F.col("_own")).cast("int"), F.lit(0))
    return kept.withColumn("rank", moved).drop("_own")


def search(embeddings: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE) -> DataFrame:
    """Top rows of every row whose vec_id is divisible by ``every``.

    Components x count as floor(scale · x). Vectors that are null or hold a null or non-finite component
    take no part; neither do other columns. Rows without vec_id are no queries but may be found, after all
    others of their score. A repeated query row gives its rows again; a repeated row is found as often as it is there.
    Returns query_id, rank, vec_id, score; nothing for an empty table.
    """
    rows = embeddings.where(vectors.usable("embedding")).select(
        F.col("vec_id").cast("bigint").alias("id"), vectors.scaled("embedding", scale).alias("v")
    )
    queries = cut_lineage(
        rows.where(F.col("id") % every == 0).withColumn("qid", F.monotonically_increasing_id()), "queries"
    )
    found = top_k(rows, queries, k).join(queries.select("qid", F.col("id").alias("query_id")), "qid")
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


#: What :func:`search` returns, over the stored embeddings.
ORACLE = f"""
WITH rows AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT q.vec_id AS query_id, r.rank, r.vec_id, r.score
FROM rows q, LATERAL (
  SELECT c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score,
    row_number() OVER (ORDER BY score DESC, c.vec_id)::INT AS rank
  FROM rows c WHERE c.vec_id != q.vec_id QUALIFY rank <= {K}) r
WHERE q.vec_id % {EVERY} = 0"""
