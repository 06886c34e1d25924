"""Fitting, comparing and searching classifiers with Spark ML."""

from __future__ import annotations

import math
import random
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Model
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LogisticRegression,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propensa.functions.hashing import SEED
from propensa.operators.balance import oversample
from propensa.operators.boosting import TreeSum, boost, gradient_boost, stumps
from propensa.operators.evaluate import auc, binary_metrics
from propensa.operators.features import folds
from propensa.operators.forest import forest
from propensa.session import cut_lineage

FEATURES = "features"
# Spark's trees are at most this deep; an unlimited depth maps to it, in forests too.
DEEPEST = 30


def estimator(name: str, label: str, n_rows: int | None = None, weight: str | None = None,
              seed: int = SEED, **params):
    """Untrained classifier of Spark ML by name; ``params`` are the Spark ML parameters of the class."""
    common = {"featuresCol": FEATURES, "labelCol": label}
    if weight:
        common["weightCol"] = weight
    if name == "logistic_regression":
        strength = params.pop("C", 1.0)
        settings = {"maxIter": 1000, "elasticNetParam": 0.0, "standardization": False}
        if n_rows:
            settings["regParam"] = 1.0 / (strength * n_rows)
        return LogisticRegression(**common, **(settings | params))
    if name == "decision_tree":
        settings = {"impurity": "gini", "maxDepth": DEEPEST, "seed": seed}
        return DecisionTreeClassifier(**common, **(settings | params))
    raise ValueError(f"unknown classifier {name!r}")


def _two_classes(df: DataFrame, label: str) -> DataFrame:
    """Declare the label binary, so that Spark ML need not scan the rows for its classes."""
    return df.withMetadata(label, {"ml_attr": {"type": "nominal", "vals": ["0", "1"]}})


def fit(name: str, train: DataFrame, label: str = "ProdTaken", weight: str | None = None,
        seed: int = SEED, **params) -> Model:
    """Train one classifier on a table with a feature vector, a label and maybe a weight."""
    train = _two_classes(train, label)
    if name == "adaboost":
        return adaboost(train, label, weight, **params)
    if name == "random_forest":
        return forest(train, label, weight, FEATURES, seed=seed, **({"maxDepth": DEEPEST} | params))
    if name == "gradient_boosting":
        return gradient_boost(train, label, weight, FEATURES, seed=seed, **params)
    if name == "boosted_regularized":
        return boost(train, label, weight, FEATURES, seed=seed, **params)
    n_rows = _mass(train, weight) if name == "logistic_regression" else None
    return estimator(name, label, n_rows, weight, seed, **params).fit(train)


def _mass(df: DataFrame, weight: str | None) -> float:
    """Rows, or the sum of their weights."""
    total = F.count("*") if weight is None else F.sum(weight)
    return float(df.agg(F.coalesce(total, F.lit(0)).alias("n")).first()["n"])


def adaboost(train: DataFrame, label: str = "ProdTaken", weight: str | None = None, n: int = 50,
             rate: float = 1.0) -> TreeSum:
    """Boosted decision stumps; see :func:`propensa.operators.boosting.stumps`."""
    return stumps(train, label, weight, FEATURES, rounds=n, rate=rate)[0]


def predict(model: Model, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Kept columns, the probability of class 1 as ``score`` and the class as ``prediction``."""
    out = model.transform(df)
    if "score" not in out.columns:
        out = out.withColumn("score", vector_to_array("probability")[1])
    return out.select(*keep, "score", F.col("prediction").cast("int").alias("prediction"))


def scores_of(models: Mapping[str, Model], df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """(keep…, model, score, prediction): every model on every row, in one scan of ``df``."""
    out, entries = df, []
    for i, (name, model) in enumerate(models.items()):
        step = model.transform(out)
        score = F.col("score") if "score" in step.columns else vector_to_array("probability")[1]
        out = step.select(*out.columns, score.alias(f"_s{i}"), F.col("prediction").cast("int").alias(f"_p{i}"))
        entries.append(F.struct(
            F.lit(name).alias("model"), F.col(f"_s{i}").alias("score"), F.col(f"_p{i}").alias("prediction")
        ))
    return out.select(*keep, F.explode(F.array(*entries)).alias("_m")).select(*keep, "_m.*")


def metrics_of(scored: DataFrame, label: str, by: Sequence[str]) -> DataFrame:
    """Label metrics and AUC per group of a table with ``score`` and ``prediction``."""
    hard = binary_metrics(scored, label, "prediction", by)
    return hard.join(auc(scored, label, "score", by).withColumnRenamed("auc", "roc_auc"), list(by))


# Fixed values: (classifier, parameters) of the model line-up at its full size.
LINE_UP = {
    "logistic_regression": {"C": 0.5, "maxIter": 1000},
    "decision_tree": {"maxDepth": 8},
    "random_forest": {"numTrees": 150},
    "adaboost": {"n": 100, "rate": 0.5},
    "gradient_boosting": {"maxIter": 150, "stepSize": 0.05, "maxDepth": 4},
    "boosted_regularized": {"rounds": 150, "rate": 0.05, "depth": 4},
}


# The line-up for rows balanced by synthetic ones, and the weight of positives in its regularized boosting.
BALANCED_LINE_UP = {
    "logistic_regression": {"C": 1.0, "maxIter": 1000},
    "decision_tree": {},
    "random_forest": {"numTrees": 200},
    "gradient_boosting": {"maxIter": 150, "stepSize": 0.1, "maxDepth": 3},
    "boosted_regularized": {"rounds": 150, "rate": 0.3, "depth": 6},
}
BALANCED_POSITIVE_WEIGHT = 4.0


# Parameter grids of the random searches, in the terms of Spark ML and of the boosted trees.
# An unlimited depth is DEEPEST; minimum samples per split have no counterpart.
FOREST_GRID = {
    "numTrees": [100, 200, 300, 500],
    "maxDepth": [5, 8, 12, DEEPEST],
    "minInstancesPerNode": [1, 2, 4],
    "featureSubsetStrategy": ["sqrt", "log2", "0.5"],
    "bootstrap": [True, False],
}
BOOSTED_GRID = {
    "rounds": [100, 200, 500, 1000],
    "depth": [3, 5, 7, 10],
    "rate": [0.01, 0.05, 0.1, 0.2],
    "rows": [0.6, 0.8, 1.0],
    "columns": [0.6, 0.8, 1.0],
    "min_gain": [0.0, 0.1, 0.3, 0.5],
    "child_weight": [1, 3, 5, 7],
    "l1": [0, 0.01, 0.1, 1],
    "l2": [0.1, 1, 5, 10],
}


#: Started first in a comparison, so that none of them is left to run alone at its end.
_LONGEST = ("boosted_regularized", "gradient_boosting", "random_forest")


def compare(
    train: DataFrame,
    test: DataFrame,
    line_up: Mapping[str, Mapping] = LINE_UP,
    label: str = "ProdTaken",
    weight: str | Mapping[str, str | None] | None = None,
    on_train: bool = False,
    parallelism: int = 4,
    seed: int = SEED,
) -> tuple[DataFrame, dict[str, Model]]:
    """One metrics row per model, best AUC first, and the trained models.

    ``weight`` is one column for all models, or the column of each by name (none where it is not
    named). The fits are independent jobs, ``parallelism`` of them at a time. All models score the rows in
    one scan and are evaluated together. With ``on_train`` every model also gets a row for the train rows
    (column ``split``), to show over-fitting. Tables that the caller has cached stay cached.
    """
    given, held = (train, test), []
    for df in given:
        if not (df.storageLevel.useMemory or df.storageLevel.useDisk):
            held.append(df.persist())
    train.count()

    def weight_of(name: str) -> str | None:
        return weight.get(name) if isinstance(weight, Mapping) else weight

    with ThreadPoolExecutor(parallelism) as jobs:
        fits = {
            n: jobs.submit(fit, n, train, label, weight_of(n), seed, **dict(line_up[n]))
            for n in sorted(line_up, key=lambda n: _LONGEST.index(n) if n in _LONGEST else len(_LONGEST))
        }
        models = {n: fits[n].result() for n in line_up}
    rows = test.select(label, FEATURES, F.lit("test").alias("split"))
    if on_train:
        rows = rows.unionByName(train.select(label, FEATURES, F.lit("train").alias("split")))
    stored = cut_lineage(scores_of(models, rows, [label, "split"]), "scored")
    for df in held:
        df.unpersist()
    table = metrics_of(stored, label, ["model", "split"]).orderBy("split", F.desc("roc_auc"))
    return table, models


def best_model(metrics: DataFrame, metric: str = "roc_auc") -> DataFrame:
    """Name of the model with the highest metric, the first name on ties, and its value."""
    best = F.min(F.struct((-F.col(metric)).alias("less"), "model")).alias("b")
    return metrics.agg(best).select("b.model", (-F.col("b.less")).alias(metric))


def best_scores(metrics: DataFrame) -> DataFrame:
    """The highest AUC and the highest F1 of a metrics table."""
    return metrics.agg(F.max("roc_auc").alias("best_auc"), F.max("f1").alias("best_f1"))


def sort_by_metric(metrics: DataFrame, metric: str, descending: bool = True) -> DataFrame:
    order = F.desc(metric) if descending else F.asc(metric)
    return metrics.orderBy(order, "model")


def importances(model: Model, names: Sequence[str], df: DataFrame) -> DataFrame:
    """(feature, importance) of a tree model; the names must match its features one to one."""
    values = model.featureImportances
    if values.size != len(names):
        raise ValueError(f"{len(names)} feature names for {values.size} importances")
    rows = [(n, float(v)) for n, v in zip(names, values.toArray())]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


def top_features(table: DataFrame, n: int = 15) -> DataFrame:
    return table.orderBy(F.desc("importance"), "feature").limit(n)


def draw_settings(grid: Mapping[str, Sequence], n: int, seed: int = SEED) -> list[dict]:
    """n different combinations of a parameter grid, at random; the grid is never listed out."""
    sizes = [len(v) for v in grid.values()]
    total = math.prod(sizes)
    picks = random.Random(seed).sample(range(total), min(n, total))
    out = []
    for pick in picks:
        setting = {}
        for name, size in zip(grid, sizes):
            pick, i = divmod(pick, size)
            setting[name] = grid[name][i]
        out.append(setting)
    return out


def random_search(
    train: DataFrame,
    name: str,
    grid: Mapping[str, Sequence],
    n_iter: int = 50,
    k: int = 5,
    key: str = "CustomerID",
    label: str = "ProdTaken",
    weight: str | None = None,
    balance: bool = False,
    metric: str = "roc_auc",
    parallelism: int = 4,
    seed: int = SEED,
) -> tuple[DataFrame, dict, Model]:
    """(metrics per setting, best setting, model refitted with it on all train rows).

    Settings are scored by cross-validation on stratified folds, by AUC or by accuracy. With ``balance`` synthetic
    rows are made inside each training part, so none of them reaches the rows it is scored on. Folds, and the grown
    training part of each, are stored once and shared by all settings; ``parallelism`` fits run at a time.
    """
    settings = draw_settings(grid, n_iter, seed)
    if balance and weight:
        raise ValueError("rows are balanced by weights or by synthetic rows, not by both")
    if metric not in ("roc_auc", "accuracy"):
        raise ValueError("metric must be 'roc_auc' or 'accuracy'")
    dealt = cut_lineage(_two_classes(folds(train, key, label, k, seed), label), "folds")
    parts = []
    for fold in range(k):
        learn = dealt.where(F.col("fold") != fold).drop("fold")
        if balance:
            learn = cut_lineage(balanced(learn, key, label, seed=seed), "grown")
        parts.append((learn.persist(), dealt.where(F.col("fold") == fold).drop("fold").persist()))
    if metric == "roc_auc":
        judge = BinaryClassificationEvaluator(labelCol=label, rawPredictionCol="score", numBins=0)
    else:
        judge = MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy")

    def judged(at: tuple[int, int]) -> float:
        learn, held = parts[at[1]]
        model = fit(name, learn, label, weight, seed, **settings[at[0]])
        return judge.evaluate(predict(model, held, [label]).withColumn("prediction", F.col("prediction").cast("double")))

    tasks = [(i, fold) for i in range(len(settings)) for fold in range(k)]
    with ThreadPoolExecutor(parallelism) as jobs:
        found = dict(zip(tasks, jobs.map(judged, tasks)))
    for learn, held in parts:
        learn.unpersist()
        held.unpersist()
    scores = [sum(found[i, fold] for fold in range(k)) / k for i in range(len(settings))]
    top = max(range(len(scores)), key=scores.__getitem__)
    whole = balanced(train, key, label, seed=seed) if balance else train
    best = fit(name, whole, label, weight, seed, **settings[top])
    rows = [
        (i, ", ".join(f"{p}={v}" for p, v in sorted(s.items())), float(m))
        for i, (s, m) in enumerate(zip(settings, scores))
    ]
    table = train.sparkSession.createDataFrame(rows, f"setting int, params string, {metric} double")
    return table, settings[top], best


def balanced(
    df: DataFrame, key: str = "CustomerID", label: str = "ProdTaken", k: int = 5, seed: int = SEED
) -> DataFrame:
    """Rows and synthetic minority rows of a table with a feature vector."""
    flat = df.select(key, label, vector_to_array(FEATURES).alias(FEATURES))
    grown = oversample(flat, key, label, FEATURES, k, seed)
    return grown.select(key, label, array_to_vector(FEATURES).alias(FEATURES))

