"""Queries over splits, preprocessing, balancing, classifiers and scoring."""

from __future__ import annotations

import functools

from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from propensa.operators import serve, training
from propensa.operators.balance import oversample, smote
from propensa.operators.clean import align_columns, clean, recode_values, variant
from propensa.operators.evaluate import best_threshold, confusion, pr, roc, threshold_report
from propensa.operators.features import (
    Preprocessor,
    class_weights,
    fitted_fills,
    folds,
    split,
    with_class_weights,
)
from propensa.operators.neighbours import knn
from propensa.plans import sql
from propensa.plans.common import kept_profile, parted, profile, rounded, trained_matrix
from propensa.plans.registry import query
from propensa.session import cached, cut_lineage, fresh_path, remembered
from propensa.sources.schemas import KEY, LABEL, VARIANT_COLUMNS
from propensa.streaming.scoring import score_stream

_NOT_FEATURES = [KEY, LABEL, "split"]
_NUMERIC_MATRIX = [f"num_{c}" for c in sql.NUMERIC]
_ENCODED = [c for c in sql.FEATURES if not c.startswith("num_")]


def _fitted(spark, sf_dir):
    rows = parted(spark, sf_dir)
    return rows, Preprocessor.fit(rows.where(F.col("split") == "train"), _NOT_FEATURES)


@query(
    "train_test_split",
    sql.using("split", "SELECT CustomerID, ProdTaken, split FROM parted"),
)
def train_test_split(spark, sf_dir):
    return split(kept_profile(spark, sf_dir, KEY, LABEL))


@query(
    "train_test_split_plain",
    sql.using(
        "profile",
        """SELECT CustomerID, CASE WHEN row_number() OVER (
            ORDER BY md5(CustomerID::VARCHAR || ':split:42')) <= ceil(0.2::DOUBLE * count(*) OVER ())
          THEN 'test' ELSE 'train' END AS split FROM profile""",
    ),
)
def train_test_split_plain(spark, sf_dir):
    return split(profile(spark, sf_dir).select(KEY), stratify=False)


@query(
    "split_remainder",
    sql.using("split", "SELECT CustomerID, ProdTaken FROM train"),
)
def split_remainder(spark, sf_dir):
    rows = split(kept_profile(spark, sf_dir, KEY, LABEL))
    return rows.where(F.col("split") != "test").select(KEY, LABEL)


@query(
    "stratified_folds",
    sql.using(
        "profile",
        """SELECT CustomerID, ProdTaken, ((r > floor(n * 1 / 5))::INT + (r > floor(n * 2 / 5))::INT
          + (r > floor(n * 3 / 5))::INT + (r > floor(n * 4 / 5))::INT)::INT AS fold
        FROM (SELECT CustomerID, ProdTaken, count(*) OVER (PARTITION BY ProdTaken) AS n,
          row_number() OVER (PARTITION BY ProdTaken
            ORDER BY md5(CustomerID::VARCHAR || ':fold:42')) AS r FROM profile)""",
    ),
)
def stratified_folds(spark, sf_dir):
    return folds(kept_profile(spark, sf_dir, KEY, LABEL))


@query(
    "fitted_imputer",
    sql.using(
        "filled",
        "SELECT CustomerID, split, "
        + ", ".join(f"round({c}, 6) AS {c}" for c in sql.NUMERIC)
        + ", "
        + ", ".join(sql.CATEGORIES)
        + " FROM filled",
    ),
)
def fitted_imputer(spark, sf_dir):
    rows, pre = _fitted(spark, sf_dir)
    return rounded(fitted_fills(rows, pre.fills, KEY))


def _matrix_sql(columns: list[str], source: str = "matrix") -> str:
    listed = ", ".join(f'round("{c}", 6) AS "{c}"' for c in columns)
    return f"SELECT CustomerID, {listed} FROM {source}"


@query("standard_scale", sql.using("matrix", _matrix_sql(_NUMERIC_MATRIX)))
def standard_scale(spark, sf_dir):
    rows, pre = _fitted(spark, sf_dir)
    return rounded(pre.apply(rows, [KEY]).select(KEY, *_NUMERIC_MATRIX))


@query("one_hot", sql.using("matrix", _matrix_sql(_ENCODED)))
def one_hot(spark, sf_dir):
    rows, pre = _fitted(spark, sf_dir)
    encoded = [n for n in pre.feature_names() if not n.startswith("num_")]
    return rounded(pre.apply(rows, [KEY]).select(KEY, *encoded))


@query(
    "feature_matrix",
    sql.using(
        "matrix",
        "SELECT CustomerID, ProdTaken, split, "
        + ", ".join(f'round("{c}", 6) AS "{c}"' for c in sql.FEATURES)
        + " FROM matrix",
    ),
)
def feature_matrix(spark, sf_dir):
    rows, pre = _fitted(spark, sf_dir)
    return rounded(pre.apply(rows, [KEY, LABEL, "split"]))


@query(
    "feature_matrix_cleaned",
    sql.using("cleaned", _matrix_sql(sql.features(sql.CLEANED_CATEGORIES, sql.CLEANED_NUMERIC), "set_matrix"),
              sql.matrix_of("cleaned", sql.CLEANED_NUMERIC, sql.CLEANED_CATEGORIES, imputed=False)),
)
def feature_matrix_cleaned(spark, sf_dir):
    """The 17 columns of the cleaned table, encoded columns first; a category that no train row has is an error."""
    rows = split(clean(kept_profile(spark, sf_dir), keep_key=True))
    train = rows.where(F.col("split") == "train")
    pre = Preprocessor.fit(train, _NOT_FEATURES, imputed=False, unknown="error", onehot_first=True)
    return rounded(pre.apply(rows, [KEY]))


@query(
    "feature_matrix_variant",
    sql.using("variant", _matrix_sql(sql.features(sql.VARIANT_CATEGORIES, sql.VARIANT_NUMERIC), "set_matrix"),
              sql.matrix_of("variant", sql.VARIANT_NUMERIC, sql.VARIANT_CATEGORIES, imputed=True)),
)
def feature_matrix_variant(spark, sf_dir):
    """The 16 columns of the derived variant, imputed from train rows, scaled columns first."""
    rows = recode_values(kept_profile(spark, sf_dir))
    rows = split(variant(rows).select(KEY, *VARIANT_COLUMNS))
    pre = Preprocessor.fit(rows.where(F.col("split") == "train"), _NOT_FEATURES)
    return rounded(pre.apply(rows, [KEY]))


@query(
    "class_weights",
    sql.using(
        "profile",
        """SELECT ProdTaken, n, round(sum(n) OVER () / (2 * n)::DOUBLE, 6) AS balanced,
          round(CASE ProdTaken WHEN 1 THEN (sum(n) FILTER (ProdTaken = 0) OVER ()) / n::DOUBLE
            ELSE 1 END, 6) AS positive_ratio
        FROM (SELECT ProdTaken, count(*) AS n FROM profile GROUP BY 1)""",
    ),
)
def weights_per_class(spark, sf_dir):
    rows = kept_profile(spark, sf_dir, LABEL)
    counts = rows.groupBy(LABEL).agg(F.count("*").alias("n"))

    def weight(mode: str):
        out = F
        for c, w in class_weights(rows, LABEL, mode).items():
            out = out.when(F.col(LABEL) == c, F.lit(w))
        return out

    return rounded(
        counts.select(
            LABEL, "n", weight("balanced").alias("balanced"), weight("ratio").alias("positive_ratio")
        )
    )


# Neighbours and synthetic rows

_DISTANCE = "round(" + " + ".join(f'pow(a."{c}" - b."{c}", 2)' for c in sql.FEATURES) + ", 9)"
_NEIGHBOURS = f"""
minority AS MATERIALIZED (SELECT * FROM matrix WHERE split = 'train' AND ProdTaken = 1),
nearest AS MATERIALIZED (
  SELECT CustomerID, neighbour, d2, row_number() OVER (
    PARTITION BY CustomerID ORDER BY d2, neighbour)::INT AS rank
  FROM (SELECT a.CustomerID, b.CustomerID AS neighbour, {_DISTANCE} AS d2
    FROM minority a JOIN minority b ON a.CustomerID != b.CustomerID)
  QUALIFY rank <= 5)"""


def _train_vectors(spark, sf_dir):
    rows, pre = _fitted(spark, sf_dir)
    train = pre.matrix(rows.where(F.col("split") == "train"), [KEY, LABEL])
    return train.select(KEY, LABEL, vector_to_array("features").alias("features")), pre


@query(
    "minority_knn",
    sql.using(
        "matrix",
        "SELECT CustomerID, rank, neighbour, round(d2, 6) AS d2 FROM nearest",
        _NEIGHBOURS,
    ),
)
def minority_knn(spark, sf_dir):
    train, _ = _train_vectors(spark, sf_dir)
    return rounded(knn(cached(train.where(F.col(LABEL) == 1)), KEY, "features"))


def _drawn(salt: str) -> str:
    return (
        "(('0x' || substr(md5(CustomerID::VARCHAR || '-' || draw::VARCHAR || ':"
        + salt
        + ":42'), 1, 13))::BIGINT / 4503599627370496::DOUBLE)"
    )


_SHOWN = sql.FEATURES
_SYNTHETIC = f"""
need AS (
  SELECT (SELECT count(*) FROM train WHERE ProdTaken = 0) - count(*) AS need, count(*) AS n
  FROM minority),
draws AS (
  SELECT CustomerID, unnest(range(1, 1 + (need // n + CASE WHEN row_number() OVER (
      ORDER BY md5(CustomerID::VARCHAR || ':smote:42')) <= need % n THEN 1 ELSE 0 END)::BIGINT))::INT
    AS draw
  FROM minority, need),
chosen AS (
  SELECT *, (1 + floor(5 * {_drawn('neighbour')}))::INT AS rank, {_drawn('gap')} AS gap FROM draws),
synthetic AS (
  SELECT c.CustomerID, c.draw, n.neighbour, round(c.gap, 6) AS gap, """ + ", ".join(
    f'round(a."{c}" + c.gap * (b."{c}" - a."{c}"), 6) AS "{c}"' for c in _SHOWN
) + """
  FROM chosen c JOIN nearest n USING (CustomerID, rank)
    JOIN minority a ON a.CustomerID = c.CustomerID JOIN minority b ON b.CustomerID = n.neighbour)"""


@query(
    "smote",
    sql.using("matrix", "SELECT * FROM synthetic", _NEIGHBOURS, _SYNTHETIC),
)
def synthetic_rows(spark, sf_dir):
    train, pre = _train_vectors(spark, sf_dir)
    made = smote(cached(train), KEY, LABEL, "features")
    at = {n: i for i, n in enumerate(pre.feature_names())}
    shown = [F.col("features")[at[c]].alias(c) for c in _SHOWN]
    return rounded(made.select(KEY, "draw", "neighbour", "gap", *shown))


@query(
    "union_resampled",
    sql.using(
        "matrix",
        """SELECT ProdTaken, draw > 0 AS synthetic, count(*) AS n, round(sum(income), 4) AS income
        FROM (SELECT CustomerID, 0 AS draw, ProdTaken, "num_MonthlyIncome" AS income FROM matrix
            WHERE split = 'train'
          UNION ALL SELECT CustomerID, draw, 1, "num_MonthlyIncome" FROM synthetic)
        GROUP BY 1, 2""",
        _NEIGHBOURS,
        _SYNTHETIC,
    ),
)
def union_resampled(spark, sf_dir):
    train, pre = _train_vectors(spark, sf_dir)
    both = oversample(cached(train), KEY, LABEL, "features")
    income = F.col("features")[pre.feature_names().index("num_MonthlyIncome")]
    # Synthetic values are rounded like the ones they are compared with.
    exact = F.when(F.col("draw") > 0, F.round(income, 6)).otherwise(income)
    return (
        both.select(LABEL, (F.col("draw") > 0).alias("synthetic"), exact.alias("income"))
        .groupBy(LABEL, "synthetic")
        .agg(F.count("*").alias("n"), F.round(F.sum("income"), 4).alias("income"))
    )


# Classifiers: the whole line-up, whatever the machine.


def _line_up(line_up=training.LINE_UP) -> dict[str, dict]:
    return {name: dict(given) for name, given in line_up.items()}


#: Models that are trained on weighted rows; plain boosting is not, regularized boosting weighs the positives only.
_WEIGHTS = {name: None if name in ("adaboost", "gradient_boosting") else "weight" for name in training.LINE_UP}
_WEIGHTS["boosted_regularized"] = "ratio"


def _line_up_matrix(spark, sf_dir):
    """Train rows with both kinds of weights, test rows, preprocessing."""
    train, test, pre = trained_matrix(spark, sf_dir)
    return with_class_weights(train, LABEL, "ratio", "ratio"), test, pre


def _scores_of(name: str):
    def plan(spark, sf_dir):
        train, test, _ = _line_up_matrix(spark, sf_dir)
        model = training.fit(name, cached(train), weight=_WEIGHTS[name], **training.LINE_UP[name])
        return rounded(training.predict(model, test, [KEY, LABEL]))

    plan.__name__ = name
    return plan


for _name in training.LINE_UP:
    query(_name)(_scores_of(_name))


@query("score_batch")
def score_batch(spark, sf_dir):
    train, test, _ = trained_matrix(spark, sf_dir)
    model = training.fit("decision_tree", cached(train), weight="weight", maxDepth=5)
    everyone = train.drop("weight").unionByName(test)
    return rounded(training.predict(model, everyone, [KEY, LABEL]))


def _tables(sf_dir: str) -> list[str]:
    """The tables that every model is learned from."""
    return [f"{sf_dir}/{t}.parquet" for t in ("customer", "nation", "orders", "lineitem", "part")]


def _results(spark, sf_dir):
    """(metrics, scores) of all six models, trained once per application and state of the tables.

    The metrics are those of train and test rows, the scores those of the test rows. Both are stored in the
    shared folder; queries that sort them or sum them up read them there.
    """

    def make():
        train, test, _ = _line_up_matrix(spark, sf_dir)
        table, models = training.compare(train, test, _line_up(), weight=_WEIGHTS, on_train=True)
        scores = training.scores_of(models, test, [KEY, LABEL])
        return cut_lineage(table, "metrics"), cut_lineage(scores, "model-scores")

    return remembered(spark, "results", _tables(sf_dir), make)


def _compared(spark, sf_dir, split: str | None = "test"):
    """The metrics of all six models."""
    table = _results(spark, sf_dir)[0]
    return table if split is None else table.where(F.col("split") == split)


@query("compare_models")
def compare_models(spark, sf_dir):
    return rounded(_compared(spark, sf_dir).orderBy(F.desc("roc_auc")))


@query("compare_models_balanced")
def compare_models_balanced(spark, sf_dir):
    """The line-up for balanced rows, trained on train rows and synthetic ones, judged on the test rows."""
    train, test, _ = trained_matrix(spark, sf_dir)
    grown = training.balanced(cached(train.drop("weight")))
    mark = F.when(F.col(LABEL) == 1, training.BALANCED_POSITIVE_WEIGHT).otherwise(1.0)
    table, _ = training.compare(
        grown.withColumn("four", mark), test, _line_up(training.BALANCED_LINE_UP), weight={"boosted_regularized": "four"}
    )
    return rounded(table)


@query("train_vs_test")
def train_vs_test(spark, sf_dir):
    return rounded(_compared(spark, sf_dir, None).orderBy("split", F.desc("roc_auc")))


@query("best_model")
def best_model(spark, sf_dir):
    return rounded(training.best_model(_compared(spark, sf_dir)))


@query("pr_tradeoff")
def pr_tradeoff(spark, sf_dir):
    table = _compared(spark, sf_dir)
    return rounded(
        training.sort_by_metric(table, "f1").select("model", "precision", "recall", "f1", "roc_auc")
    )


@query("model_roc_curves")
def model_roc_curves(spark, sf_dir):
    """A ROC curve for every model on the test rows, without points on a straight line between their neighbours."""
    return rounded(roc(_results(spark, sf_dir)[1], LABEL, "score", ["model"], drop_collinear=True))


@query("model_pr_curves")
def model_pr_curves(spark, sf_dir):
    """Precision, recall and F1 of every model at each of its scores."""
    return rounded(pr(_results(spark, sf_dir)[1], LABEL, "score", ["model"]))


@query("model_confusion")
def model_confusion(spark, sf_dir):
    """Actual and predicted classes of the test rows, counted for every model."""
    return confusion(_results(spark, sf_dir)[1], LABEL, "prediction", ["model"])


_MODEL_NAMES = "(VALUES " + ", ".join(f"('{name}')" for name in training.LINE_UP) + ") AS models(model)"


@query(
    "model_confusion_support",
    sql.using(
        "split",
        f"SELECT model, ProdTaken AS actual, count(*) AS n FROM parted, {_MODEL_NAMES} WHERE split = 'test' GROUP BY 1, 2",
    ),
)
def model_confusion_support(spark, sf_dir):
    """Rows of either class that each model has judged, added up from its confusion cells."""
    cells = model_confusion(spark, sf_dir)
    return cells.groupBy("model", "actual").agg(F.sum("n").alias("n"))


@query(
    "model_curves_agree",
    sql.using(
        "split",
        f"""SELECT model, TRUE AS area_agrees, TRUE AS pr_agrees, TRUE AS metrics_agree FROM {_MODEL_NAMES}""",
    ),
)
def model_curves_agree(spark, sf_dir):
    """For every model: the stored AUC against Spark's evaluator on the stored scores, the highest recall and the
    base rate against the end of its precision-recall curve, precision and recall against the confusion cells."""
    metrics, scores = _results(spark, sf_dir)
    rows = []
    for name in training.LINE_UP:
        own = scores.where(F.col("model") == name)
        area = BinaryClassificationEvaluator(labelCol=LABEL, rawPredictionCol="score", numBins=0).evaluate(own)
        rows.append((name, float(area)))
    areas = spark.createDataFrame(rows, "model string, area double")
    curve = pr(scores, LABEL, "score", ["model"], closing=False).groupBy("model").agg(
        F.max("recall").alias("top"), F.min_by("precision", "threshold").alias("base")
    )
    cells = confusion(scores, LABEL, "prediction", ["model"]).groupBy("model").agg(
        *[
            F.sum(F.when((F.col("actual") == a) & (F.col("predicted") == p), F.col("n"))).alias(f"c{a}{p}")
            for a in (0, 1) for p in (0, 1)
        ]
    )

    def near(a, b):
        return F.abs(F.col(a) - b) < 1e-9

    both = metrics.where("split = 'test'").join(areas, "model").join(curve, "model").join(cells, "model")
    precision = F.coalesce(F.try_divide(F.col("c11"), F.col("c01") + F.col("c11")), F.lit(0.0))
    return both.select(
        "model",
        near("roc_auc", F.col("area")).alias("area_agrees"),
        (near("top", F.lit(1.0)) & near("base", (F.col("c10") + F.col("c11")) / sum(F.col(f"c{a}{p}") for a in (0, 1) for p in (0, 1))))
        .alias("pr_agrees"),
        (near("precision", precision) & near("recall", F.col("c11") / (F.col("c10") + F.col("c11")))).alias("metrics_agree"),
    )


@query("best_scores")
def best_scores(spark, sf_dir):
    return rounded(training.best_scores(_compared(spark, sf_dir)))


@query(
    "kpis_with_best_scores",
    sql.using(
        "split",
        "SELECT count(*) AS customers, sum(ProdTaken)::BIGINT AS buyers, 6::BIGINT AS models, "
        "TRUE AS auc_is_best, TRUE AS f1_is_best FROM parted",
    ),
)
def kpis_with_best_scores(spark, sf_dir):
    """Customers, buyers and models counted, and whether the best scores are those of the sorted lists."""
    table = _compared(spark, sf_dir)
    rows = profile(spark, sf_dir).agg(
        F.count("*").alias("customers"), F.sum(LABEL).cast("bigint").alias("buyers")
    )
    best = training.best_scores(table).first()
    first = {m: training.sort_by_metric(table, m).first()[m] for m in ("roc_auc", "f1")}
    return rows.select(
        "*",
        F.lit(table.count()).cast("bigint").alias("models"),
        F.lit(best["best_auc"] == first["roc_auc"]).alias("auc_is_best"),
        F.lit(best["best_f1"] == first["f1"]).alias("f1_is_best"),
    )


@query(
    "metrics_agree",
    sql.using(
        "split",
        """SELECT count(*) FILTER (split = 'test') AS n,
          count(*) FILTER (split = 'test' AND ProdTaken = 1) AS n_positive,
          TRUE AS auc_agrees, TRUE AS accuracy_agrees FROM parted""",
    ),
)
def metrics_agree(spark, sf_dir):
    """The library's AUC and accuracy of a forest against Spark's own evaluators."""
    train, test, _ = trained_matrix(spark, sf_dir)
    model = training.fit("random_forest", cached(train), weight="weight", **training.LINE_UP["random_forest"])
    judged = cached(training.predict(model, test, [KEY, LABEL]).withColumn("p", F.col("prediction").cast("double")))
    own = training.metrics_of(judged.withColumn("model", F.lit("forest")), LABEL, ["model"]).first()
    area = BinaryClassificationEvaluator(labelCol=LABEL, rawPredictionCol="score", numBins=0).evaluate(judged)
    right = MulticlassClassificationEvaluator(
        labelCol=LABEL, predictionCol="p", metricName="accuracy"
    ).evaluate(judged)
    return judged.agg(
        F.count("*").alias("n"),
        F.count_if(F.col(LABEL) == 1).alias("n_positive"),
        F.lit(abs(own["roc_auc"] - area) < 1e-9).alias("auc_agrees"),
        F.lit(abs(own["accuracy"] - right) < 1e-9).alias("accuracy_agrees"),
    )


@query(
    "regression_optimum",
    sql.using("split", "SELECT count(*) FILTER (split = 'train') AS n, TRUE AS flat FROM parted"),
)
def regression_optimum(spark, sf_dir):
    """Is the gradient of the penalised loss zero at the fitted coefficients?"""
    train, _, _ = trained_matrix(spark, sf_dir)
    kept = cached(train)
    model = training.fit("logistic_regression", kept, weight="weight", **training.LINE_UP["logistic_regression"])
    mass = kept.agg(F.sum("weight").alias("w")).first()["w"]
    beta = [float(b) for b in model.coefficients]
    x = vector_to_array("features")
    z = F.lit(float(model.intercept))
    rows = kept.select(LABEL, "weight", x.alias("x"))
    for i, b in enumerate(beta):
        z = z + F.lit(b) * F.col("x")[i]
    off = F.col("weight") * (1 / (1 + F.exp(-z)) - F.col(LABEL)) / F.lit(mass)
    sums = rows.select(off.alias("off"), "x").agg(
        F.count("*").alias("n"), F.sum("off").alias("g"),
        *[F.sum(F.col("off") * F.col("x")[i]).alias(f"g{i}") for i in range(len(beta))],
    ).first()
    strength = float(model.getRegParam())
    slopes = [sums["g"], *[sums[f"g{i}"] + strength * b for i, b in enumerate(beta)]]
    return spark.createDataFrame([(sums["n"], max(map(abs, slopes)) < 1e-4)], "n bigint, flat boolean")


@query("tuned_forest")
def tuned_forest(spark, sf_dir):
    """A forest on balanced train rows, judged on the test rows at 0.5 and at its best threshold.

    The threshold is tuned on a fifth of the train rows that the forest has not seen.
    """
    train, test, _ = trained_matrix(spark, sf_dir)
    dealt = cached(folds(train.drop("weight")))
    learn, check = dealt.where(F.col("fold") > 0).drop("fold"), dealt.where(F.col("fold") == 0)
    grown = training.balanced(learn)
    model = training.fit("random_forest", cached(grown), **training.LINE_UP["random_forest"])
    tuned = best_threshold(training.predict(model, check, [LABEL]), LABEL, "score").first()["threshold"]
    judged = cached(training.predict(model, test, [LABEL]))
    return rounded(threshold_report(judged, LABEL, "score", tuned))


@query("random_search")
def random_search(spark, sf_dir):
    train, _, _ = trained_matrix(spark, sf_dir)
    grid = {"numTrees": [10, 20, 30], "maxDepth": [3, 5, 8], "minInstancesPerNode": [1, 2, 4]}
    table, _, _ = training.random_search(
        train, "random_forest", grid, n_iter=3, k=3, weight="weight"
    )
    return rounded(table)


def _forest_importances(spark, sf_dir):
    train, _, pre = trained_matrix(spark, sf_dir)
    model = training.fit("random_forest", cached(train), weight="weight", **training.LINE_UP["random_forest"])
    return training.importances(model, pre.feature_names(), train)


@query(
    "importances_add_up",
    sql.using(
        "split",
        f"SELECT {len(sql.FEATURES)}::BIGINT AS n_features, TRUE AS sums_to_one, FALSE AS any_negative, "
        "count(*) > 0 AS any_rows FROM parted",
    ),
)
def importances_add_up(spark, sf_dir):
    table = _forest_importances(spark, sf_dir)
    return table.agg(
        F.count_distinct("feature").alias("n_features"),
        (F.abs(F.sum("importance") - 1) < 1e-9).alias("sums_to_one"),
        F.max(F.col("importance") < 0).alias("any_negative"),
        (F.count("*") > 0).alias("any_rows"),
    )


@query("name_importances")
def name_importances(spark, sf_dir):
    return rounded(_forest_importances(spark, sf_dir))


@query("feature_importance")
def feature_importance(spark, sf_dir):
    table = _forest_importances(spark, sf_dir)
    return rounded(table.orderBy(F.desc("importance"), "feature"))


@query("top_features")
def top_features(spark, sf_dir):
    return rounded(training.top_features(_forest_importances(spark, sf_dir), 15))


def _bundle(spark, sf_dir) -> serve.Bundle:
    """The best model of the line-up and its threshold.

    The models learn from four fifths of the train rows. The last fifth, which none of them has seen, decides
    which has the highest AUC and tunes its threshold; the test rows play no part.
    """
    rows = parted(spark, sf_dir)
    train = folds(rows.where(F.col("split") == "train"))
    learn, check = train.where(F.col("fold") > 0).drop("fold"), train.where(F.col("fold") == 0)
    pre = Preprocessor.fit(learn, _NOT_FEATURES)
    matrix = with_class_weights(with_class_weights(pre.matrix(learn, [KEY, LABEL]), LABEL), LABEL, "ratio", "ratio")
    held = pre.matrix(check, [KEY, LABEL])
    table, models = training.compare(cached(matrix), cached(held), _line_up(), weight=_WEIGHTS)
    best = training.best_model(table).first()["model"]
    judged = training.predict(models[best], held, [LABEL])
    threshold = best_threshold(judged, LABEL, "score").first()["threshold"]
    return serve.bundle(pre, models[best], threshold, best)


def train_bundle(spark, sf_dir) -> str:
    """Folder of the published bundles of these tables; the first is trained where there is none."""

    def make():
        root = fresh_path(spark, "bundles")
        serve.publish(_bundle(spark, sf_dir), spark, root)
        return root

    return remembered(spark, "bundle", _tables(sf_dir), make)


def _saved_bundle(spark, sf_dir) -> serve.Bundle:
    """The latest published bundle; scoring loads it and trains nothing."""
    return serve.current(spark, train_bundle(spark, sf_dir))


_ALL_SAME = sql.using("profile", "SELECT CustomerID, TRUE AS same FROM profile")


@query("model_roundtrip", _ALL_SAME)
def model_roundtrip(spark, sf_dir):
    """Scores before saving and after loading, key by key; a row lost on either side is not the same."""
    made = _bundle(spark, sf_dir)
    root = fresh_path(spark, "bundles")
    loaded = serve.current(spark, root, serve.publish(made, spark, root))
    rows = profile(spark, sf_dir)
    before = serve.score(rows, made).select(KEY, F.struct("probability", "decision").alias("before"))
    after = serve.score(rows, loaded).select(KEY, F.struct("probability", "decision").alias("after"))
    return before.join(after, KEY, "full").select(KEY, (F.col("before") == F.col("after")).alias("same"))


@query("scores_without_columns", _ALL_SAME)
def scores_without_columns(spark, sf_dir):
    """Leaving out any column of the template is the same as filling it with 0 or the text '0'."""
    made = _saved_bundle(spark, sf_dir)
    rows = kept_profile(spark, sf_dir)
    fields = [f for f in serve.TEMPLATE if f.name != KEY]

    def scores(change, name: str):
        parts = [
            align_columns(change(f), serve.TEMPLATE).withColumn("left_out", F.lit(f.name)) for f in fields
        ]
        whole = functools.reduce(lambda a, b: a.unionByName(b), parts)
        return serve.score(whole, made, [KEY, "left_out"]).select(KEY, "left_out", F.col("probability").alias(name))

    without = scores(lambda f: rows.drop(f.name), "a")
    zero = scores(lambda f: rows.withColumn(f.name, F.lit("0").cast(f.dataType)), "b")
    both = without.join(zero, [KEY, "left_out"], "full")
    return both.groupBy(KEY).agg(F.min(F.col("a") == F.col("b")).alias("same"))


@query("score_new_customers")
def score_new_customers(spark, sf_dir):
    made = _saved_bundle(spark, sf_dir)
    arriving = profile(spark, sf_dir).drop(LABEL)
    scored = serve.score(arriving, made, explain=True)
    return rounded(scored.withColumn("factors", F.transform("factors", lambda f: f["title"])))


@query("stream_equals_batch", _ALL_SAME)
def stream_equals_batch(spark, sf_dir):
    batch = serve.score(profile(spark, sf_dir), _saved_bundle(spark, sf_dir))
    streamed = stream(spark, sf_dir)
    columns = [c for c in batch.columns if c != KEY]
    left = rounded(batch).select(KEY, F.struct(*columns).alias("a"))
    right = streamed.select(KEY, F.struct(*columns).alias("b"))
    return left.join(right, KEY, "full").select(KEY, (F.col("a") == F.col("b")).alias("same"))


@query("score_stream")
def stream(spark, sf_dir):
    made = _saved_bundle(spark, sf_dir)
    incoming, outgoing = fresh_path(spark, "arriving"), fresh_path(spark, "scored")
    profile(spark, sf_dir).write.parquet(incoming)
    run = score_stream(spark, incoming, outgoing, fresh_path(spark, "stream-state"), made)
    run.awaitTermination()
    return rounded(spark.read.parquet(outgoing))
