"""Classifier evaluation on (label, prediction) and (label, score) tables.

``by`` evaluates several models or splits side by side in the same jobs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propensa.operators.ordered import running_totals

METRICS = ["accuracy", "precision", "recall", "f1", "weighted_f1", "balanced_accuracy"]


def _ratio(top: Column, bottom: Column) -> Column:
    """Quotient, 0 where the denominator is 0."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def _f1(precision: Column, recall: Column) -> Column:
    return _ratio(2 * precision * recall, precision + recall)


def confusion(df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """(by…, actual, predicted, n) with all four cells, also the empty ones."""
    actual, predicted = F.col(label), F.col(prediction)
    cells = [(a, p) for a in (0, 1) for p in (0, 1)]
    one = df.groupBy(*by).agg(
        *[F.count_if((actual == a) & (predicted == p)).alias(f"c{a}{p}") for a, p in cells]
    )
    entries = [
        F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(f"c{a}{p}").alias("n"))
        for a, p in cells
    ]
    return one.select(*by, F.explode(F.array(*entries)).alias("e")).select(*by, "e.*")


def confusion_wide(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """(actual, predicted_0, predicted_1): the same counts as a 2×2 view."""
    wide = confusion(df, label, prediction).groupBy("actual").pivot("predicted", [0, 1])
    return wide.agg(F.sum("n")).withColumnsRenamed({"0": "predicted_0", "1": "predicted_1"})


def _cells(df: DataFrame, label: str, prediction: str, by: Sequence[str]) -> DataFrame:
    actual, predicted = F.col(label) == 1, F.col(prediction) == 1
    return df.groupBy(*by).agg(
        F.count_if(actual & predicted).alias("tp"),
        F.count_if(~actual & predicted).alias("fp"),
        F.count_if(actual & ~predicted).alias("fn"),
        F.count_if(~actual & ~predicted).alias("tn"),
    )


def binary_metrics(df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy; precision, recall, F1 of class 1; support-weighted F1; hard-label AUC.

    The AUC of 0/1 predictions is the mean of both recalls, i.e. the balanced accuracy.
    """
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    f1_pos = _f1(_ratio(tp, tp + fp), _ratio(tp, tp + fn))
    f1_neg = _f1(_ratio(tn, tn + fn), _ratio(tn, tn + fp))
    return _cells(df, label, prediction, by).select(
        *by,
        n.alias("n"),
        _ratio(tp + tn, n).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        f1_pos.alias("f1"),
        _ratio(f1_pos * (tp + fn) + f1_neg * (tn + fp), n).alias("weighted_f1"),
        ((_ratio(tp, tp + fn) + _ratio(tn, tn + fp)) / 2).alias("balanced_accuracy"),
    )


def report(
    df: DataFrame, label: str, prediction: str, names=("Not Purchased", "Purchased")
) -> DataFrame:
    """(row, precision, recall, f1, support) per class, then accuracy, macro and weighted rows."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    classes = [
        (_ratio(tn, tn + fn), _ratio(tn, tn + fp), tn + fp),
        (_ratio(tp, tp + fp), _ratio(tp, tp + fn), tp + fn),
    ]
    stats = [(p, r, _f1(p, r), s) for p, r, s in classes]
    accuracy = _ratio(tp + tn, n)

    def mean(i: int) -> Column:
        return (stats[0][i] + stats[1][i]) / 2

    def weighted(i: int) -> Column:
        return _ratio(stats[0][i] * stats[0][3] + stats[1][i] * stats[1][3], n)

    rows = [(names[0], *stats[0]), (names[1], *stats[1])]
    rows.append(("accuracy", accuracy, accuracy, accuracy, n))
    rows.append(("macro avg", mean(0), mean(1), mean(2), n))
    rows.append(("weighted avg", weighted(0), weighted(1), weighted(2), n))
    entries = [
        F.struct(
            F.lit(row).alias("row"), p.alias("precision"), r.alias("recall"), f.alias("f1"),
            s.alias("support"),
        )
        for row, p, r, f, s in rows
    ]
    one = _cells(df, label, prediction, ())
    return one.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def score_totals(
    df: DataFrame, label: str, score: str, by: Sequence[str] = (), prior: bool = False
) -> DataFrame:
    """Per distinct score: positives and negatives with it, below it, and in all."""
    counts = (
        df.where(F.col(score).isNotNull())
        .groupBy(*by, F.col(score).alias("threshold"))
        .agg(
            F.count_if(F.col(label) == 1).alias("pos"),
            F.count_if(F.col(label) == 0).alias("neg"),
        )
    )
    return running_totals(counts, "threshold", ["pos", "neg"], by, prior=prior)


def auc(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """(by…, auc): chance that a positive outscores a negative, ties counting one half."""
    totals = score_totals(df, label, score, by)
    wins = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2))
    pairs = F.max(F.col("pos_all").cast("double") * F.col("neg_all"))
    return totals.groupBy(*by).agg(F.try_divide(wins, pairs).alias("auc"))


def roc(
    df: DataFrame, label: str, score: str, by: Sequence[str] = (), drop_collinear: bool = False
) -> DataFrame:
    """(by…, threshold, fpr, tpr) at every distinct score, and (0, 0) at infinity.

    ``drop_collinear`` leaves out inner points whose step equals the following step.
    """
    totals = score_totals(df, label, score, by, prior=drop_collinear)
    if drop_collinear:
        pos, neg = F.col("pos"), F.col("neg")
        highest = (F.col("pos_before") + pos == F.col("pos_all")) & (
            F.col("neg_before") + neg == F.col("neg_all")
        )
        turns = (pos != F.col("pos_prior")) | (neg != F.col("neg_prior"))
        totals = totals.where(highest | F.col("pos_prior").isNull() | turns)
    points = totals.select(
        *by,
        "threshold",
        F.try_divide(F.col("neg_all") - F.col("neg_before"), F.col("neg_all")).alias("fpr"),
        F.try_divide(F.col("pos_all") - F.col("pos_before"), F.col("pos_all")).alias("tpr"),
    )
    keys = totals.select(*by).distinct() if by else df.sparkSession.range(1)
    start = keys.select(
        *by,
        F.lit(float("inf")).alias("threshold"),
        F.lit(0.0).alias("fpr"),
        F.lit(0.0).alias("tpr"),
    )
    return points.unionByName(start)


def pr(
    df: DataFrame, label: str, score: str, by: Sequence[str] = (), closing: bool = True
) -> DataFrame:
    """(by…, threshold, precision, recall, f1) at every distinct score.

    The closing point (precision 1, recall 0) has no threshold.
    """
    totals = score_totals(df, label, score, by)
    tp = F.col("pos_all") - F.col("pos_before")
    fp = F.col("neg_all") - F.col("neg_before")
    points = totals.select(
        *by,
        "threshold",
        _ratio(tp, tp + fp).alias("precision"),
        F.coalesce(F.try_divide(tp, F.col("pos_all")), F.lit(1.0)).alias("recall"),
    )
    if closing:
        keys = totals.select(*by).distinct() if by else df.sparkSession.range(1)
        end = keys.select(
            *by,
            F.lit(None).cast("double").alias("threshold"),
            F.lit(1.0).alias("precision"),
            F.lit(0.0).alias("recall"),
        )
        points = points.unionByName(end)
    p, r = F.col("precision"), F.col("recall")
    return points.withColumn("f1", 2 * p * r / (p + r + 1e-9))


def best_threshold(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """(by…, threshold, f1): the score with the highest F1, the lowest such score on ties."""
    curve = pr(df, label, score, by, closing=False)
    best = F.min(F.struct((-F.round("f1", 12)).alias("less"), "threshold", "f1")).alias("b")
    return curve.groupBy(*by).agg(best).select(*by, "b.threshold", "b.f1")


def threshold_report(
    df: DataFrame, label: str, score: str, tuned: float | Column, default: float = 0.5
) -> DataFrame:
    """(metric, at_default, at_tuned, change) for accuracy, precision, recall and F1."""
    value = F.col(score)
    both = df.select(
        label,
        F.explode(
            F.array(
                F.struct(F.lit("d").alias("k"), (value >= default).cast("int").alias("p")),
                F.struct(F.lit("t").alias("k"), (value >= tuned).cast("int").alias("p")),
            )
        ).alias("e"),
    ).select(label, "e.*")
    metrics = ["accuracy", "precision", "recall", "f1"]
    long = binary_metrics(both, label, "p", ["k"]).unpivot(["k"], metrics, "metric", "value")
    wide = long.groupBy("metric").agg(
        F.max(F.when(F.col("k") == "d", F.col("value"))).alias("at_default"),
        F.max(F.when(F.col("k") == "t", F.col("value"))).alias("at_tuned"),
    )
    return wide.withColumn("change", F.col("at_tuned") - F.col("at_default"))


def attach_actuals(scores: DataFrame, actuals: DataFrame, key: str) -> DataFrame:
    """Score, prediction and actual label in one row per key."""
    return scores.join(actuals, key)
