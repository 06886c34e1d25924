"""Boosting of few rows in one task."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from propensa.operators import boosting, training


@pytest.fixture(scope="module")
def train(spark):
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.normal(size=300), rng.integers(0, 4, 300)])
    y = (x[:, 0] + 0.6 * x[:, 1] + rng.normal(size=300) > 1).astype(int)
    df = spark.createDataFrame([(i, a.tolist(), int(b)) for i, (a, b) in enumerate(zip(x, y))], "id int, v array<double>, y int")
    return df.repartition(4).select("id", "y", (F.col("id") % 3 + 1.0).alias("w"), array_to_vector("v").alias("features")).persist()


@pytest.mark.parametrize("name, params", [
    ("boosted_regularized", {"rounds": 6, "depth": 3, "rows": 0.7, "columns": 0.5}),
    ("gradient_boosting", {"maxIter": 5, "maxDepth": 3}),
    ("adaboost", {"n": 6, "rate": 0.5}),
])
def test_one_task_fits_what_all_tasks_fit(train, monkeypatch, name, params):
    one = training.fit(name, train, "y", "w", **params)
    monkeypatch.setattr(boosting, "TASK_ROWS", 0)
    all_ = training.fit(name, train, "y", "w", **params)
    for a, b in zip(one.nodes(), all_.nodes(), strict=True):
        assert [n[:4] for n in a] == [n[:4] for n in b]
        assert [n[4] for n in a] == pytest.approx([n[4] for n in b])
    assert list(one.featureImportances) == pytest.approx(list(all_.featureImportances))


def test_jobs_do_not_grow_with_the_rounds(spark, train):
    """A round took a job per level, most of the time of which was not work on rows."""
    sc = spark.sparkContext

    def jobs(rounds):
        sc.setJobGroup(f"rounds-{rounds}", "boosting")
        boosting.boost(train, "y", rounds=rounds, depth=4)
        sc.setLocalProperty("spark.jobGroup.id", None)
        return len(sc.statusTracker().getJobIdsForGroup(f"rounds-{rounds}"))

    assert jobs(2) == jobs(12) <= 10
