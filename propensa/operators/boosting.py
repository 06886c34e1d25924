"""Boosted trees and stumps over binned features.

Features are cut into bins once and stored as one code per feature, in blocks of some thousand rows. After that a round needs only the sums
of two measures per open node, feature and bin: every task adds up its rows into one array, and the arrays
are merged element by element. What reaches the driver are those sums, whose size depends on nodes, features and
bins but not on the rows. A row's margin is stored with it every few rounds, so neither plans nor tasks
grow with the number of rounds. The rounds are the same for a few rows, which one task holds, and for many.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable

import numpy as np
from pyspark import RDD, StorageLevel, keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propensa.functions import rounds as rounds_
from propensa.functions import trees as tree_tasks
from propensa.functions.hashing import SEED
from propensa.functions.rounds import Node, _below, split_gains
from propensa.session import cut_lineage

#: Bins of a feature with many values; one with fewer has a bin per value.
BINS = 255
#: Rounds after which the margins are stored, and those of a table with more than MANY rows, whose tasks
#: would spend most of their time on the trees since the last store.
ROUNDS_PER_STORE = 25
ROUNDS_PER_STORE_OF_MANY = 5
MANY = 400_000
#: Rows for which the sums take one more task: a task of few rows is nearly all overhead.
ROWS_PER_TASK = 1 << 14
#: Rows up to which all rounds run in one task: a job per level of every tree is nearly all overhead there.
TASK_ROWS = 1 << 17
#: Up to so many arrays of sums come to the driver as they are, more are merged by tasks first.
ARRAYS = 64
MERGERS = 16


class TreeSum(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """A sum of trees over the feature vector as a pipeline stage: adds ``score`` and ``prediction``.

    The score is the logistic function of the sum divided by ``scale``.
    """

    trees = Param(Params._dummy(), "trees", "trees as JSON", typeConverter=TypeConverters.toString)
    width = Param(Params._dummy(), "width", "number of features", typeConverter=TypeConverters.toInt)
    scale = Param(Params._dummy(), "scale", "divisor of the sum", typeConverter=TypeConverters.toFloat)
    importances = Param(Params._dummy(), "importances", "share of each feature", typeConverter=TypeConverters.toListFloat)
    featuresCol = Param(Params._dummy(), "featuresCol", "feature vector", typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, *, trees="[]", width=0, scale=1.0, importances=(), featuresCol="features"):
        super().__init__()
        self._setDefault(trees="[]", width=0, scale=1.0, importances=[], featuresCol="features")
        self._set(**{k: list(v) if k == "importances" else v for k, v in self._input_kwargs.items()})

    def nodes(self) -> list[list[Node]]:
        return [[tuple(n) for n in t] for t in json.loads(self.getOrDefault("trees"))]

    @property
    def featureImportances(self) -> DenseVector:
        return DenseVector(self.getOrDefault("importances"))

    def _transform(self, df: DataFrame) -> DataFrame:
        total = F.pandas_udf(tree_tasks.margins_udf(self.nodes(), self.getOrDefault("width")), "double")
        margin = total(vector_to_array(self.getOrDefault("featuresCol"))) / F.lit(self.getOrDefault("scale"))
        out = df.withColumn("_margin", margin)
        return out.withColumns(
            {"score": 1 / (1 + F.exp(-F.col("_margin"))), "prediction": (F.col("_margin") > 0).cast("double")}
        ).drop("_margin")


def quantile_edges(arrays: DataFrame, width: int, bins: int = BINS) -> list[list[float]]:
    """Cuts of each feature near its quantiles, of a feature with few values at every value but the first."""
    shares = [i / bins for i in range(bins + 1)]
    out: list[list[float]] = []
    # A plan of bounded size for any number of features.
    for first in range(0, width, 200):
        at = range(first, min(first + 200, width))
        row = arrays.agg(*[F.percentile_approx(F.get("x", F.lit(j)), shares, 10 * bins).alias(f"q{j}") for j in at]).first()
        out += [sorted(set(row[f"q{j}"] or []))[1:] for j in at]
    return out


def even_edges(arrays: DataFrame, width: int, bins: int = 16) -> list[list[float]]:
    """``bins`` cuts of each feature at even distances between its least and its largest value.

    They lie off the simple fractions of the range, so that no value of a small scale falls on one.
    """
    out: list[list[float]] = []
    for first in range(0, width, 200):
        at = range(first, min(first + 200, width))
        row = arrays.agg(
            *[F.struct(F.min(F.get("x", F.lit(j))), F.max(F.get("x", F.lit(j)))).alias(f"s{j}") for j in at]
        ).first()
        for j in at:
            low, high = row[f"s{j}"]
            steps = range(1, bins + 1) if low is not None and low < high else ()
            out.append([low + (high - low) * (i - 0.37) / bins for i in steps])
    return out


class _Rows(rounds_.Rows):
    """Blocks of binned rows with label, weight and margin, and the sums over them."""

    def __init__(self, train: DataFrame, label: str, weight: str | None, features: str, edges):
        x = vector_to_array(features) if dict(train.dtypes)[features] == "vector" else F.col(features)
        arrays = train.select(
            x.alias("x"), F.col(label).cast("double").alias("y"),
            (F.lit(1.0) if weight is None else F.col(weight).cast("double")).alias("w"),
        ).withColumns({"u": F.xxhash64("x", "y"), "m": F.lit(0.0)})
        first = arrays.select("x").first()
        if first is None:
            raise ValueError("there are no rows to train on")
        width = len(first["x"])
        super().__init__(edges(arrays, width) if isinstance(edges, Callable) else [list(e) for e in edges])
        self.schema = "n int, codes binary, y binary, w binary, u binary, m binary"
        self.pending: list[list[Node]] = []
        self.held: DataFrame | None = None
        self.cells: RDD | None = None
        self._keep(arrays.mapInArrow(tree_tasks.blocks_task(self.edges), self.schema))
        self.rows = rows = self.held.agg(F.sum("n").alias("n")).first()["n"]
        self.parts = min(self.cells.getNumPartitions(), max(2, 1 + rows // ROWS_PER_TASK))
        self.every = ROUNDS_PER_STORE_OF_MANY if rows > MANY else ROUNDS_PER_STORE

    def _keep(self, rows: DataFrame) -> None:
        new = cut_lineage(rows, "binned")
        self.release()
        self.held = new
        # A job per sum: on an RDD it needs no plan of its own, which for few rows is a third of its time.
        self.cells = new.rdd.mapPartitions(tree_tasks.cells).persist(StorageLevel.MEMORY_AND_DISK)

    def release(self) -> None:
        if self.cells is not None:
            self.cells.unpersist()

    def run(self, rounds: Callable, *given):
        """What the rounds make of these rows: in one task if it can hold them, else here from sums of all tasks."""
        if self.rows > min(TASK_ROWS, MANY):
            out = rounds(self, *given)
        else:
            task = rounds_.whole_task(self.edges, rounds, given)
            out = json.loads(self.held.coalesce(1).mapInArrow(task, "found string").first()["found"])
        self.release()
        return out

    def sums(self, measures: Callable, growing: list[Node], open_: list[int], round_: int = 0, share: float = 1.0):
        """Two arrays (node, feature, bin) of sums of the measures."""
        task = tree_tasks.histogram_task(self.starts, self.kind, self.pending, growing, open_, measures, round_, share)
        found = self.cells.coalesce(self.parts).mapPartitions(tree_tasks.in_cells(task, tree_tasks.BLOCK))
        if self.parts > ARRAYS:
            for n in (MERGERS, 1):
                found = found.repartition(n).mapPartitions(tree_tasks.in_cells(tree_tasks.added_task, ["a", "b"]))
        total = np.zeros((2, len(open_), self.starts[-1]))
        for r in found.collect():
            for t, part in zip(total, r):
                t += np.frombuffer(part).reshape(t.shape)
        return self.placed(total)

    def add(self, tree: list[Node]) -> None:
        self.pending.append(tree)
        if len(self.pending) == self.every:
            rows = self.held.coalesce(self.parts)
            self._keep(rows.mapInArrow(tree_tasks.margin_task(self.width, self.kind, self.pending), self.schema))
            self.pending = []

# ---- second-order boosting


def boost(
    train: DataFrame, label: str = "ProdTaken", weight: str | None = None, features: str = "features",
    rounds: int = 150, rate: float = 0.3, depth: int = 6, l1: float = 0.0, l2: float = 1.0, min_gain: float = 0.0,
    child_weight: float = 1.0, rows: float = 1.0, columns: float = 1.0, edges=quantile_edges, seed: int = SEED,
) -> TreeSum:
    """Second-order boosted trees of the logistic loss.

    A leaf is -T(G) · rate / (H + l2), where G and H are the sums of the first and second derivatives of its rows and
    T takes ``l1`` off the size of G. A node is split at the cut with the highest
    T(G)²/(H + l2) of both sides less that of the node, if that is above ``min_gain`` and both sides have an H of
    ``child_weight`` at least. Each round sees a share ``rows`` of the rows and ``columns`` of the features.
    """
    data = _Rows(train, label, weight, features, edges)
    fitted, importance = data.run(
        rounds_.grown, tree_tasks.gradients, rounds, rate, rate, depth, l1, l2, min_gain, child_weight, rows, columns, seed
    )
    return TreeSum(trees=json.dumps(fitted), width=data.width, importances=importance, featuresCol=features)


def gradient_boost(
    train: DataFrame, label: str = "ProdTaken", weight: str | None = None, features: str = "features",
    maxIter: int = 100, stepSize: float = 0.1, maxDepth: int = 3, maxBins: int = 32, minInfoGain: float = 0.0,
    minInstancesPerNode: int = 1, subsamplingRate: float = 1.0, seed: int = SEED,
) -> TreeSum:
    """Gradient boosted regression trees; the parameters are named as Spark ML names them.

    For labels y of -1 and 1 and the loss 2·log(1 + exp(-2·y·F)), the first tree is fitted to the labels and counts as a
    whole, each later one to the residuals 4·y / (1 + exp(2·y·F)) and counts ``stepSize``. A node is split at the cut that
    lessens the variance most; a leaf is the mean of its rows, with or without weights. The score is 1 / (1 + exp(-2·F)).
    """
    data = _Rows(train, label, weight, features, functools.partial(quantile_edges, bins=maxBins))
    # Before the first tree, residuals are twice the labels.
    fitted, importance = data.run(
        rounds_.grown, tree_tasks.residuals, maxIter, stepSize, 0.5, maxDepth, 0.0, 0.0, minInfoGain, minInstancesPerNode,
        subsamplingRate, 1.0, seed,
    )
    return TreeSum(trees=json.dumps(fitted), width=data.width, scale=0.5, importances=importance, featuresCol=features)


def first_gains(
    train: DataFrame, label: str, weight: str | None, features: str = "features", l1: float = 0.0, l2: float = 1.0,
    child_weight: float = 1.0, edges=quantile_edges,
) -> list[tuple[int, int, float, float, float]]:
    """(feature, cut, G and H below the cut, gain) of every allowed cut of the first root, cuts counted from 1."""
    data = _Rows(train, label, weight, features, edges)
    (g,), (h,) = data.sums(tree_tasks.gradients, [(-1, 0.0, -1, -1, 0.0)], [0])
    data.release()
    gains, gl, hl = split_gains(g, h, data.valid(), l1, l2, child_weight), _below(g), _below(h)
    return [
        (int(j), int(c) + 1, float(gl[j, c]), float(hl[j, c]), float(gains[j, c]))
        for j, c in zip(*np.nonzero(np.isfinite(gains)))
    ]


# ---- boosted stumps


def stumps(
    train: DataFrame, label: str = "ProdTaken", weight: str | None = None, features: str = "features", rounds: int = 50,
    rate: float = 1.0, edges=quantile_edges,
) -> tuple[TreeSum, list[tuple[int, float, float, float]]]:
    """Discrete AdaBoost of decision stumps (SAMME, two classes), and (feature, cut, error, α) of each.

    The first weights are those of the ``weight`` column, or equal. A round takes the cut that leaves the weight least
    mixed; each side votes for its heavier class. Its error sets its say α = rate · ln((1 - error) / error), and the weight of a row that
    it got wrong rises by the factor exp(α). It stops early when a stump is perfect, which then counts 1, or no better than chance.
    """
    data = _Rows(train, label, weight, features, edges)
    fitted, said, importance = data.run(rounds_.stumped, rounds, rate)
    if not fitted:
        raise ValueError("no stump is better than chance")
    says = sum(s[3] for s in said)
    model = TreeSum(
        trees=json.dumps(fitted), width=data.width, scale=says,
        importances=[i / sum(importance) for i in importance], featuresCol=features,
    )
    return model, [tuple(a) for a in said]
