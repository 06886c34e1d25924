"""Queries over classifier evaluation, on the deterministic baseline score."""

from __future__ import annotations

from pyspark.sql import functions as F

from propensa.functions.columns import apply_threshold
from propensa.operators import evaluate
from propensa.operators.explore import histogram
from propensa.plans import sql
from propensa.plans.common import rounded, scored
from propensa.plans.registry import query
from propensa.session import cached
from propensa.sources.schemas import KEY, LABEL

# The threshold at which the baseline score is turned into decisions here.
THRESHOLD = 0.21
_CELLS = sql.cells(THRESHOLD)


def _decided(spark, sf_dir):
    return scored(spark, sf_dir).withColumn("prediction", apply_threshold("score", THRESHOLD))


def _div(top: str, bottom: str) -> str:
    return f"coalesce(({top}) / nullif({bottom}, 0), 0)"


_PRECISION, _RECALL = _div("tp", "tp + fp"), _div("tp", "tp + fn")
_PRECISION0, _RECALL0 = _div("tn", "tn + fn"), _div("tn", "tn + fp")
_F1 = _div(f"2 * {_PRECISION} * {_RECALL}", f"{_PRECISION} + {_RECALL}")
_F10 = _div(f"2 * {_PRECISION0} * {_RECALL0}", f"{_PRECISION0} + {_RECALL0}")
_N = "(tp + fp + fn + tn)"


@query("baseline_score", sql.using("scored", "SELECT CustomerID, score FROM scored"))
def baseline_score(spark, sf_dir):
    return scored(spark, sf_dir).select(KEY, "score")


@query(
    "confusion_matrix",
    sql.using(
        "scored",
        " UNION ALL ".join(
            f"""SELECT {a}::INT AS actual, {p}::INT AS predicted,
            count(*) FILTER (ProdTaken = {a} AND (score >= {THRESHOLD})::INT = {p}) AS n FROM scored"""
            for a in (0, 1)
            for p in (0, 1)
        ),
    ),
)
def confusion_matrix(spark, sf_dir):
    return evaluate.confusion(_decided(spark, sf_dir), LABEL, "prediction")


@query(
    "confusion_wide",
    sql.using(
        "scored",
        f"""SELECT ProdTaken AS actual, count(*) FILTER (score < {THRESHOLD}) AS predicted_0,
        count(*) FILTER (score >= {THRESHOLD}) AS predicted_1 FROM scored GROUP BY 1""",
    ),
)
def confusion_wide(spark, sf_dir):
    return evaluate.confusion_wide(_decided(spark, sf_dir), LABEL, "prediction")


@query(
    "binary_metrics",
    sql.using(
        "scored",
        f"""SELECT {_N}::BIGINT AS n, round((tp + tn) / {_N}, 6) AS accuracy,
        round({_PRECISION}, 6) AS "precision", round({_RECALL}, 6) AS recall,
        round({_F1}, 6) AS f1 FROM cells""",
        _CELLS,
    ),
)
def binary_metrics(spark, sf_dir):
    table = evaluate.binary_metrics(_decided(spark, sf_dir), LABEL, "prediction")
    return rounded(table.select("n", "accuracy", "precision", "recall", "f1"))


@query(
    "weighted_f1",
    sql.using(
        "scored",
        f"""SELECT round(({_F1} * (tp + fn) + {_F10} * (tn + fp)) / {_N}, 6) AS weighted_f1,
        round({_F1}, 6) AS f1 FROM cells""",
        _CELLS,
    ),
)
def weighted_f1(spark, sf_dir):
    table = evaluate.binary_metrics(_decided(spark, sf_dir), LABEL, "prediction")
    return rounded(table.select("weighted_f1", "f1"))


@query(
    "roc_auc_hard",
    sql.using(
        "scored",
        f"SELECT round(({_RECALL} + {_RECALL0}) / 2, 6) AS balanced_accuracy FROM cells",
        _CELLS,
    ),
)
def roc_auc_hard(spark, sf_dir):
    table = evaluate.binary_metrics(_decided(spark, sf_dir), LABEL, "prediction")
    return rounded(table.select("balanced_accuracy"))


_REPORT = [
    ("Not Purchased", _PRECISION0, _RECALL0, _F10, "tn + fp"),
    ("Purchased", _PRECISION, _RECALL, _F1, "tp + fn"),
    ("accuracy", *[f"(tp + tn) / {_N}"] * 3, _N),
    ("macro avg", *[f"({a} + {b}) / 2" for a, b in (
        (_PRECISION0, _PRECISION), (_RECALL0, _RECALL), (_F10, _F1))], _N),
    ("weighted avg", *[f"({a} * (tn + fp) + {b} * (tp + fn)) / {_N}" for a, b in (
        (_PRECISION0, _PRECISION), (_RECALL0, _RECALL), (_F10, _F1))], _N),
]


@query(
    "classification_report",
    sql.using(
        "scored",
        " UNION ALL ".join(
            f"""SELECT '{row}' AS "row", round({p}, 6) AS "precision", round({r}, 6) AS recall,
            round({f}, 6) AS f1, ({s})::BIGINT AS support FROM cells"""
            for row, p, r, f, s in _REPORT
        ),
        _CELLS,
    ),
)
def classification_report(spark, sf_dir):
    return rounded(evaluate.report(_decided(spark, sf_dir), LABEL, "prediction"))


@query(
    "roc_curve",
    sql.using(
        "curve",
        """SELECT score AS threshold, round(fp / all_neg::DOUBLE, 6) AS fpr,
          round(tp / all_pos::DOUBLE, 6) AS tpr FROM curve
        UNION ALL SELECT 'inf'::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE""",
    ),
)
def roc_curve(spark, sf_dir):
    return evaluate.roc(scored(spark, sf_dir), LABEL, "score").select(
        "threshold", F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr")
    )


@query(
    "roc_curve_corners",
    sql.using(
        "curve",
        """SELECT score AS threshold, round(fp / all_neg::DOUBLE, 6) AS fpr,
          round(tp / all_pos::DOUBLE, 6) AS tpr FROM (
          SELECT *, row_number() OVER (ORDER BY score DESC) AS i,
            lead(pos) OVER (ORDER BY score DESC) AS next_pos,
            lead(neg) OVER (ORDER BY score DESC) AS next_neg FROM curve)
        WHERE i = 1 OR next_pos IS NULL OR next_pos != pos OR next_neg != neg
        UNION ALL SELECT 'inf'::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE""",
    ),
)
def roc_curve_corners(spark, sf_dir):
    return evaluate.roc(scored(spark, sf_dir), LABEL, "score", drop_collinear=True).select(
        "threshold", F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr")
    )


@query(
    "roc_curve_collinear",
    sql.using(
        "scored",
        """SELECT round(score, 9) AS threshold, round(fp / all_neg::DOUBLE, 6) AS fpr, round(tp / all_pos::DOUBLE, 6) AS tpr FROM (
          SELECT *, row_number() OVER w AS i, lead(pos) OVER w AS next_pos, lead(neg) OVER w AS next_neg
          FROM fine_curve WINDOW w AS (ORDER BY score DESC))
        WHERE i = 1 OR next_pos IS NULL OR next_pos != pos OR next_neg != neg
        UNION ALL SELECT 'inf'::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE""",
        """fine AS (SELECT ProdTaken, score + CustomerID / 1e9::DOUBLE AS score FROM scored)""",
        """fine_curve AS (
          SELECT score, (ProdTaken = 1)::INT AS pos, (ProdTaken = 0)::INT AS neg,
            sum((ProdTaken = 1)::INT) OVER (ORDER BY score DESC) AS tp, sum((ProdTaken = 0)::INT) OVER (ORDER BY score DESC) AS fp,
            sum((ProdTaken = 1)::INT) OVER () AS all_pos, sum((ProdTaken = 0)::INT) OVER () AS all_neg FROM fine)""",
    ),
)
def roc_curve_collinear(spark, sf_dir):
    """A curve of scores that all differ: its many straight runs of one-row steps shrink to their ends."""
    fine = scored(spark, sf_dir).withColumn("score", F.col("score") + F.col(KEY) / F.lit(1e9))
    corners = evaluate.roc(fine, LABEL, "score", drop_collinear=True)
    return corners.select(
        F.round("threshold", 9).alias("threshold"), F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr")
    )


_F1_AT = "2 * prec * rec / (prec + rec + 1e-9)"


@query(
    "pr_curve",
    sql.using(
        "curve",
        f"""SELECT score AS threshold, round(prec, 6) AS "precision", round(rec, 6) AS recall,
          round({_F1_AT}, 6) AS f1 FROM pr
        UNION ALL SELECT NULL, 1.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE""",
    ),
)
def pr_curve(spark, sf_dir):
    return rounded(evaluate.pr(scored(spark, sf_dir), LABEL, "score"))


@query(
    "roc_auc",
    sql.using(
        "scored",
        """SELECT round((sum(r) FILTER (ProdTaken = 1) - pos * (pos + 1) / 2) / (pos * neg), 6) AS auc
        FROM (SELECT ProdTaken,
            rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r,
            (sum(ProdTaken) OVER ())::DOUBLE AS pos, (sum(1 - ProdTaken) OVER ())::DOUBLE AS neg
          FROM scored) GROUP BY pos, neg""",
    ),
)
def roc_auc(spark, sf_dir):
    return rounded(evaluate.auc(scored(spark, sf_dir), LABEL, "score"))


@query(
    "optimal_threshold",
    sql.using(
        "curve",
        f"""SELECT score AS threshold, round({_F1_AT}, 6) AS f1 FROM pr
        ORDER BY round({_F1_AT}, 12) DESC, score LIMIT 1""",
    ),
)
def optimal_threshold(spark, sf_dir):
    return rounded(evaluate.best_threshold(scored(spark, sf_dir), LABEL, "score"))


_AT = {
    "accuracy": f"(tp + tn) / {_N}",
    "precision": _PRECISION,
    "recall": _RECALL,
    "f1": _F1,
}


@query(
    "threshold_report",
    sql.using(
        "curve",
        " UNION ALL ".join(
            f"""SELECT '{m}' AS metric, round(d.v, 6) AS at_default, round(t.v, 6) AS at_tuned,
            round(t.v - d.v, 6) AS change
            FROM (SELECT {x} AS v FROM at_default) d, (SELECT {x} AS v FROM at_tuned) t"""
            for m, x in _AT.items()
        ),
        f"tuned AS (SELECT score AS t FROM pr ORDER BY round({_F1_AT}, 12) DESC, score LIMIT 1)",
        *[
            f"""{name} AS (SELECT
              count(*) FILTER (ProdTaken = 1 AND score >= {t})::DOUBLE AS tp,
              count(*) FILTER (ProdTaken = 0 AND score >= {t})::DOUBLE AS fp,
              count(*) FILTER (ProdTaken = 1 AND score < {t})::DOUBLE AS fn,
              count(*) FILTER (ProdTaken = 0 AND score < {t})::DOUBLE AS tn FROM scored, tuned)"""
            for name, t in (("at_default", "0.5"), ("at_tuned", "t"))
        ],
    ),
)
def threshold_report(spark, sf_dir):
    rows = cached(scored(spark, sf_dir))
    tuned = evaluate.best_threshold(rows, LABEL, "score").select("threshold").scalar()
    return rounded(evaluate.threshold_report(rows, LABEL, "score", tuned))


@query(
    "score_histogram",
    sql.using(
        "scored",
        """SELECT bin, round(lo + bin * ((hi - lo) / 40), 6) AS low,
          round(lo + (bin + 1) * ((hi - lo) / 40), 6) AS high, ProdTaken, count(*) AS n
        FROM (SELECT ProdTaken, lo, hi, least(floor((score - lo) / ((hi - lo) / 40)), 39)::INT AS bin
          FROM scored, (SELECT min(score) AS lo, max(score) AS hi FROM scored))
        GROUP BY bin, lo, hi, ProdTaken""",
    ),
)
def score_histogram(spark, sf_dir):
    return rounded(histogram(scored(spark, sf_dir), "score", LABEL, 40))
