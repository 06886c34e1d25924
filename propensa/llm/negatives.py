"""Hard negatives by exact integer scores of anchors and candidates.

Scores come from Strassen's recursive product of int64 tiles: a tile of anchors times a tile of candidates
is cut in four, filled up with zeros where a side is odd, and seven products of sums of the
quarters give the four quarters of the result. All sums are integers, so no score is rounded.

Two rounds over the same shards: the first keeps a heap of the nearest rows of the anchor's own label, the
second one heap per positive of the rows of other labels within the positive's window of scores. Heaps of a
shard are merged by rank, so the result does not depend on the shards.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from propensa.llm import topk, vectors
from propensa.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: A product with a side of at most this length is not cut any more.
LEAF = 16
#: Sides of the tiles: anchors and candidates.
ANCHORS, CANDIDATES = 256, 1_024
#: Fixed values of the registered query.
SCALE, EVERY, RELABEL, LABELS, POSITIVES, NEGATIVES, LOW, HIGH = 256, 100, 7, 10, 5, 10, 30, 90


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Strassen's product of two integer matrices."""
    n, d, m = a.shape[0], a.shape[1], b.shape[1]
    if min(n, d, m) <= LEAF:
        return a @ b
    if n % 2 or d % 2 or m % 2:
        a = np.pad(a, ((0, n % 2), (0, d % 2)))
        b = np.pad(b, ((0, d % 2), (0, m % 2)))
        return product(a, b)[:n, :m]
    i, k, j = n // 2, d // 2, m // 2
    a11, a12, a21, a22 = a[:i, :k], a[:i, k:], a[i:, :k], a[i:, k:]
    b11, b12, b21, b22 = b[:k, :j], b[:k, j:], b[k:, :j], b[k:, j:]
    p1 = product(a11 + a22, b11 + b22)
    p2 = product(a21 + a22, b11)
    p3 = product(a11, b12 - b22)
    p4 = product(a22, b21 - b11)
    p5 = product(a11 + a12, b22)
    p6 = product(a21 - a11, b11 + b12)
    p7 = product(a12 - a22, b21 + b22)
    out = np.empty((n, m), p1.dtype)
    out[:i, :j] = p1 + p4 - p5 + p7
    out[:i, j:] = p3 + p5
    out[i:, :j] = p2 + p4
    out[i:, j:] = p1 - p2 + p3 + p6
    return out


class Heap:
    """The ``k`` highest scores seen and their places; the first places among equal ones."""

    def __init__(self, k: int):
        self.k, self.scores, self.places = k, None, None

    def add(self, scores: np.ndarray, places: np.ndarray) -> None:
        """Takes in scores at places after all earlier ones."""
        if self.scores is not None:
            if len(self.scores) == self.k:
                higher = scores > self.scores[-1]
                scores, places = scores[higher], places[higher]
            scores, places = np.concatenate([self.scores, scores]), np.concatenate([self.places, places])
        top = topk.best(scores, self.k)
        self.scores, self.places = scores[top], places[top]


def heaps_task(k: int, windows: bool):
    """Heaps of a shard: of the anchor's label, or per positive of other labels within its window."""

    def work(table: pa.Table):
        ids, known = vectors.ids_of(table)
        order = vectors.in_order(ids, known)
        ids, known, values = ids[order], known[order], vectors.matrix(table)[order]
        labels = table.column("label").to_numpy()[order]
        tiles = [(s, np.ascontiguousarray(values[s : s + CANDIDATES].T)) for s in range(0, len(ids), CANDIDATES)]

        def tops(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            anchors = vectors.matrix(batch, values.shape[1])
            numbers, own = batch.column("qid").to_numpy(), batch.column("label").to_numpy()
            bounds = batch.column("windows").to_pylist() if windows else None
            for first in range(0, len(anchors), ANCHORS):
                group = range(first, min(first + ANCHORS, len(anchors)))
                heaps: dict[tuple[int, int], Heap] = {}
                for start, tile in tiles:
                    a, b = vectors.exact(anchors[first : group.stop], tile)
                    scores = product(a, b)
                    there = labels[start : start + tile.shape[1]]
                    for q in group:
                        row = scores[q - first]
                        if not windows:
                            places = np.flatnonzero(there == own[q])
                            heaps.setdefault((q, 0), Heap(k)).add(row[places], places + start)
                            continue
                        other = there != own[q]
                        for w in bounds[q] or ():
                            places = np.flatnonzero(other & (row >= w["low"]) & (row <= w["high"]))
                            if len(places):
                                heaps.setdefault((q, w["positive"]), Heap(k)).add(row[places], places + start)
                yield from written(heaps, numbers)

        def written(heaps: dict[tuple[int, int], Heap], numbers: np.ndarray) -> Iterator[pa.RecordBatch]:
            if not heaps:
                return
            sizes = [len(h.places) for h in heaps.values()]
            places = np.concatenate([h.places for h in heaps.values()])
            scores = np.concatenate([h.scores for h in heaps.values()])
            keys = np.array([(numbers[q], p) for q, p in heaps], np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(keys[:, 0], sizes), pa.int64()),
                    pa.array(np.repeat(keys[:, 1], sizes), pa.int64()),
                    pa.array(ids[places], pa.int64(), mask=~known[places]),
                    pa.array(vectors.saturated(scores), pa.int64()),
                ],
                ["qid", "positive", "id", "score"],
            )

        return tops

    return work


_FOUND = "qid bigint, positive bigint, id bigint, score bigint"


def mine(
    rows: DataFrame, anchors: DataFrame, positives: int, negatives: int, low: int, high: int
) -> tuple[DataFrame, DataFrame]:
    """(qid, positive, id, score) and (qid, positive, rank, id, score): positives of each anchor, and their negatives.

    ``rows`` holds (id long, v array<long>, label), ``anchors`` also a unique ``qid``. An anchor's positives are
    its highest other rows of its label, numbered in ``positive``; the negatives of a positive are the highest
    rows of other labels with low · score(positive) <= 100 · score <= high · score(positive).
    Ties go to the smaller id, a null id comes after all others.
    """
    n = vectors.shards_for(rows)
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    near = vectors.meet(rows, anchors, n, heaps_task(positives + 1, False), _FOUND)
    ranked = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= positives + 1)
    itself = anchors.select("qid", F.col("id").alias("self"), topk.square().alias("square"))
    others = topk.without_itself(ranked.join(itself, "qid"), "qid").where(F.col("rank") <= positives)
    chosen = cut_lineage(others.select("qid", F.col("rank").cast("bigint").alias("positive"), "id", "score"), "positives")

    wide = F.col("score").cast("decimal(38,0)")
    # Whole numbers: the least from low · score / 100 on, the largest up to high · score / 100.
    window = F.struct(
        "positive", F.ceil(wide * low / 100).cast("bigint").alias("low"), F.floor(wide * high / 100).cast("bigint").alias("high")
    )
    # At most ``positives`` windows an anchor.
    bounds = chosen.groupBy("qid").agg(F.sort_array(F.collect_list(window)).alias("windows"))
    asked = cut_lineage(anchors.join(bounds, "qid"), "anchors")
    hard = vectors.meet(rows, asked, n, heaps_task(negatives, True), _FOUND)
    place = Window.partitionBy("qid", "positive").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    hard = hard.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= negatives)
    return chosen, hard


def hard_negatives(
    embeddings: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH
) -> DataFrame:
    """Hard negatives for the positives of every row whose vec_id is divisible by 100.

    Components x count as floor(256 · x). Rows with a null label, a null vector or a null or non-finite
    component take no part; other columns play none. Where vec_id is divisible by 7, the label becomes
    (label + 1) % 10. Rows without vec_id are no anchors. A repeated row is as many rows. Shorter vectors count as
    filled up with zeros; scores beyond the range of long saturate.
    Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score; nothing for an empty table.
    """
    label = F.col("label").cast("bigint")
    moved = F.when(F.col("vec_id") % RELABEL == 0, (label + 1) % LABELS).otherwise(label)
    rows = embeddings.where(vectors.usable("embedding") & F.col("label").isNotNull()).select(
        F.col("vec_id").cast("bigint").alias("id"), vectors.scaled("embedding", SCALE).alias("v"), moved.alias("label")
    )
    anchors = cut_lineage(
        rows.where(F.col("id") % EVERY == 0).withColumn("qid", F.monotonically_increasing_id()), "anchors"
    )
    chosen, hard = mine(rows, anchors, positives, negatives, low, high)
    chosen = chosen.toDF("qid", "positive", "positive_id", "positive_score")
    return (
        hard.join(chosen, ["qid", "positive"])
        .join(anchors.select("qid", F.col("id").alias("anchor_id")), "qid")
        .select(
            "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
            F.col("score").alias("negative_score"),
        )
    )


#: What :func:`hard_negatives` returns, over the stored embeddings.
ORACLE = f"""
WITH rows AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % {RELABEL} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label,
    list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
    list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM rows a JOIN rows c ON a.vec_id % {EVERY} = 0 AND a.vec_id != c.vec_id),
positives AS (
  SELECT * FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES})
SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (
    PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id)::INT AS rank,
  n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scores n ON n.anchor_id = p.anchor_id AND NOT n.same
  AND {LOW} * p.score <= 100 * n.score AND 100 * n.score <= {HIGH} * p.score
QUALIFY rank <= {NEGATIVES}"""
