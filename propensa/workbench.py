"""The whole job in three calls: load and clean, train and compare, pick and tune."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.ml import Model
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from propensa.functions.hashing import SEED
from propensa.operators import serve, training
from propensa.operators.clean import clean, derive
from propensa.operators.evaluate import best_threshold
from propensa.operators.features import Preprocessor, folds, split, with_class_weights
from propensa.session import cached, release
from propensa.sources.schemas import KEY, LABEL
from propensa.sources.tables import customers_or_profile


def load_and_clean(spark: SparkSession, path: str, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Raw customers (from the file, or built from the tables) and their cleaned version."""
    raw = cached(customers_or_profile(spark, path, sf_dir))
    return raw, clean(raw)


@dataclass
class Trained:
    """What training leaves behind."""

    metrics: DataFrame
    models: dict[str, Model]
    preprocessor: Preprocessor
    test: DataFrame
    best_name: str
    threshold: float

    def bundle(self) -> serve.Bundle:
        return serve.bundle(self.preprocessor, self.models[self.best_name], self.threshold, self.best_name)

    def release(self) -> None:
        """Let go of the tables that were kept for training; metrics and models stay usable."""
        release(self.test.sparkSession)


def train_models(
    df: DataFrame,
    line_up: Mapping[str, Mapping] = training.LINE_UP,
    balance: str = "weights",
    seed: int = SEED,
) -> Trained:
    """Split, preprocess, balance, fit and compare; tune the threshold of the best model.

    ``balance`` is one of 'weights', 'synthetic' and 'none'. The threshold is tuned on a fifth of
    the train rows that no model of the comparison has seen, never on the test rows.
    """
    rows = cached(folds(split(derive(df), seed=seed), seed=seed))
    train = rows.where(F.col("split") == "train")
    learn, check = train.where(F.col("fold") > 0), train.where(F.col("fold") == 0)
    pre = Preprocessor.fit(learn, [KEY, LABEL, "split", "fold"])
    keep = [KEY, LABEL]
    matrix, weight = pre.matrix(learn, keep), None
    if balance == "weights":
        matrix = with_class_weights(with_class_weights(matrix, LABEL), LABEL, "ratio", "ratio")
        weight = dict.fromkeys(line_up, "weight") | {"boosted_regularized": "ratio"}
    elif balance == "synthetic":
        matrix = training.balanced(cached(matrix), seed=seed)
    elif balance != "none":
        raise ValueError("balance must be 'weights', 'synthetic' or 'none'")
    test = pre.matrix(rows.where(F.col("split") == "test"), keep)
    metrics, models = training.compare(matrix, test, line_up, weight=weight, seed=seed)
    best = training.best_model(metrics).first()["model"]
    judged = training.predict(models[best], pre.matrix(check, keep), [LABEL])
    threshold = best_threshold(judged, LABEL, "score").first()["threshold"]
    return Trained(metrics, models, pre, test, best, threshold)
