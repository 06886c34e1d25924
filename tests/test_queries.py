"""Every registered query: rows equal to its SQL, or at least a sound result."""

import pytest
from compare import database, spark_rows, sql_rows, type_differences

import __spark_entry__ as entry_points

QUERIES = entry_points.queries()
ORACLES = entry_points.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return database(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    columns, rows = spark_rows(df)
    expected_columns, expected = sql_rows(con, ORACLES[name])
    assert columns == expected_columns
    assert rows == expected
    assert type_differences(df, con, ORACLES[name]) == []


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    rows = entry_points.entry(spark).collect()
    assert {r["AgeGroup"] for r in rows} == {"<25", "25-35", "35-45", "45-60", "60+"}
    assert sum(r["n"] for r in rows) == 150


SCORES = [
    "logistic_regression", "decision_tree", "random_forest", "adaboost", "gradient_boosting",
    "boosted_regularized",
]


@pytest.mark.parametrize("name", SCORES)
def test_classifier_scores(spark, sf_dir, name):
    rows = QUERIES[name](spark, sf_dir).collect()
    assert len(rows) == 31
    assert all(0 <= r["score"] <= 1 and r["prediction"] in (0, 1) for r in rows)


def test_roundtrip_is_identical(spark, sf_dir):
    rows = QUERIES["model_roundtrip"](spark, sf_dir).collect()
    assert len(rows) == 150
    assert all(r["same"] for r in rows)


def test_stream_equals_batch(spark, sf_dir):
    batch = QUERIES["score_new_customers"](spark, sf_dir).drop("factors")
    streamed = QUERIES["score_stream"](spark, sf_dir)
    assert spark_rows(batch) == spark_rows(streamed)


def test_compare_models_lists_every_model(spark, sf_dir):
    table = QUERIES["compare_models"](spark, sf_dir).collect()
    assert {r["model"] for r in table} == set(SCORES)
    assert all(0 <= r["roc_auc"] <= 1 for r in table)


def test_random_search(spark, sf_dir):
    assert QUERIES["random_search"](spark, sf_dir).count() == 3


def test_importances_add_up(spark, sf_dir):
    rows = QUERIES["feature_importance"](spark, sf_dir).collect()
    assert sum(r["importance"] for r in rows) == pytest.approx(1, abs=1e-4)
    assert QUERIES["top_features"](spark, sf_dir).count() == 15


def test_curves_of_models(spark, sf_dir):
    for name in ("model_roc_curves", "model_pr_curves"):
        assert {r["model"] for r in QUERIES[name](spark, sf_dir).collect()} == set(SCORES)
