"""Boosted trees and stumps against plain numpy."""

import json
import math

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from propensa.operators import boosting, evaluate, training


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(8)
    x = np.column_stack([rng.normal(size=500), rng.integers(0, 4, 500), rng.integers(0, 2, 500), np.full(500, 3.0)])
    y = (x[:, 0] + 0.7 * x[:, 1] * x[:, 2] + rng.normal(scale=0.5, size=500) > 1).astype(int)
    return x, y, np.where(y == 1, 2.5, 1.0)


@pytest.fixture(scope="module")
def train(spark, data):
    rows = [([float(v) for v in a], int(b), float(c)) for a, b, c in zip(*data)]
    df = spark.createDataFrame(rows, "v array<double>, y int, w double").repartition(5)
    return df.select("y", "w", array_to_vector("v").alias("features")).persist()


def edges(x):
    return [[lo + (hi - lo) * (i - 0.37) / 16 for i in range(1, 17)] if lo < hi else [] for lo, hi in zip(x.min(0), x.max(0))]


def shrunk(g, l1):
    return np.sign(g) * max(abs(g) - l1, 0)


def plain_boost(x, y, w, rounds, rate, depth, l1, l2, child):
    cuts, m = edges(x), np.zeros(len(x))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-m))
        g, h = w * (p - y), w * p * (1 - p)

        def grow(rows, left):
            a, b = g[rows].sum(), h[rows].sum()
            best = None
            for j, cs in enumerate(cuts):
                for c in cs:
                    low = rows & (x[:, j] < c)
                    gl, hl = g[low].sum(), h[low].sum()
                    if left and hl >= child and b - hl >= child:
                        gain = shrunk(gl, l1) ** 2 / (hl + l2) + shrunk(a - gl, l1) ** 2 / (b - hl + l2) - shrunk(a, l1) ** 2 / (b + l2)
                        if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                            best = gain, low
            if best is None:
                m[rows] -= shrunk(a, l1) / (b + l2) * rate
                return
            grow(best[1], left - 1)
            grow(rows & ~best[1], left - 1)

        grow(np.ones(len(x), dtype=bool), depth)
    return 1 / (1 + np.exp(-m))


def scores(model, train):
    got = training.predict(model, train.withColumn("id", F.monotonically_increasing_id()), ["features"]).collect()
    return {tuple(r["features"].toArray()): r["score"] for r in got}


def test_boosting_equals_numpy(data, train):
    x, y, w = data
    model = boosting.boost(
        train, "y", "w", rounds=4, rate=0.4, depth=3, l1=0.3, l2=2.0, child_weight=1.5, edges=boosting.even_edges
    )
    want = plain_boost(x, y, w, 4, 0.4, 3, 0.3, 2.0, 1.5)
    got = scores(model, train)
    assert max(abs(got[tuple(r)] - s) for r, s in zip(x, want)) < 1e-9
    assert sum(model.featureImportances) == pytest.approx(1) and model.featureImportances[3] == 0


def test_stored_margins_change_nothing(train, monkeypatch):
    settings = {"rounds": 5, "rate": 0.5, "depth": 2}
    whole = boosting.boost(train, "y", **settings)
    monkeypatch.setattr(boosting, "ROUNDS_PER_STORE", 2)
    monkeypatch.setattr(boosting, "ARRAYS", 1)
    parts = boosting.boost(train, "y", **settings)
    for a, b in zip(whole.nodes(), parts.nodes(), strict=True):
        assert [n[:4] for n in a] == [n[:4] for n in b]
        assert [n[4] for n in a] == pytest.approx([n[4] for n in b])


def test_penalties_and_limits(train):
    assert [len(t) for t in boosting.boost(train, "y", rounds=2, depth=3, min_gain=1e9).nodes()] == [1, 1]
    assert [len(t) for t in boosting.boost(train, "y", rounds=1, depth=3, child_weight=1e9).nodes()] == [1]
    flat = boosting.boost(train, "y", rounds=1, depth=2, l1=1e9).nodes()[0]
    assert {n[4] for n in flat} == {0.0}
    few = boosting.boost(train, "y", rounds=6, depth=2, columns=0.25)
    assert all(len({n[0] for n in t if n[0] >= 0}) <= 1 for t in few.nodes())
    sampled = boosting.boost(train, "y", rounds=2, depth=2, rows=0.5)
    assert sampled.nodes() == boosting.boost(train, "y", rounds=2, depth=2, rows=0.5).nodes()
    assert sampled.nodes() != boosting.boost(train, "y", rounds=2, depth=2).nodes()


def test_model_survives_saving(spark, train, tmp_path):
    model = PipelineModel([boosting.boost(train, "y", rounds=3, depth=3)])
    model.write().overwrite().save(str(tmp_path / "m"))
    loaded = PipelineModel.load(str(tmp_path / "m"))
    assert loaded.stages[0].nodes() == model.stages[0].nodes()
    assert scores(loaded, train) == scores(model, train)


def test_stumps_equal_numpy(data, train):
    x, y, w = data
    _, said = boosting.stumps(train, "y", "w", rounds=4, rate=0.5, edges=boosting.even_edges)
    weight = w.astype(float)
    for j, cut, error, alpha in said:
        best = None
        for a, cs in enumerate(edges(x)):
            for c in cs:
                sides = [x[:, a] < c, x[:, a] >= c]
                if min(weight[s].sum() for s in sides) <= 0:
                    continue
                pure = sum(((weight * y)[s].sum() ** 2 + (weight * (1 - y))[s].sum() ** 2) / weight[s].sum() for s in sides)
                if best is None or pure > best[0] + 1e-9:
                    best = pure, a, c, sides
        _, a, c, sides = best
        assert j == a and cut == pytest.approx(c)
        vote = np.zeros(len(y))
        for s in sides:
            vote[s] = 2 * (weight * y)[s].sum() > weight[s].sum()
        wrong = vote != y
        assert error == pytest.approx(weight[wrong].sum() / weight.sum())
        assert alpha == pytest.approx(0.5 * math.log((1 - error) / error))
        weight = weight * np.exp(alpha * wrong)


def test_line_up_models_learn(train):
    for name, params in (("boosted_regularized", {"rounds": 20}), ("adaboost", {"n": 20})):
        judged = training.predict(training.fit(name, train, "y", "w", **params), train, ["y"])
        assert evaluate.auc(judged, "y", "score").first()["auc"] > 0.9


def test_all_models_score_in_one_scan(train):
    models = {
        "a": training.fit("decision_tree", train, "y", maxDepth=2), "b": training.fit("adaboost", train, "y", n=3),
        "c": training.fit("logistic_regression", train, "y"),
    }
    scored = training.scores_of(models, train, ["y"])
    assert scored.columns == ["y", "model", "score", "prediction"]
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert plan.count("InMemoryTableScan") == 1 and "Union" not in plan
    for name, model in models.items():
        alone = sorted(tuple(r) for r in training.predict(model, train, ["y"]).collect())
        assert sorted(tuple(r) for r in scored.where(F.col("model") == name).drop("model").collect()) == alone


def test_search_over_boosted_trees(spark, train):
    rows = train.withColumn("id", F.monotonically_increasing_id())
    grid = {"rounds": [2, 3], "depth": [1, 2], "l2": [0.1, 10]}
    table, best, model = training.random_search(
        rows, "boosted_regularized", grid, n_iter=3, k=2, key="id", label="y", metric="accuracy"
    )
    assert table.count() == 3 and set(best) == set(grid)
    assert json.loads(model.getOrDefault("trees"))


def test_no_rows_to_train_on(train):
    with pytest.raises(ValueError, match="no rows"):
        boosting.boost(train.where("y > 5"), "y")


def test_sums_have_a_place_per_bin_there_is(train, monkeypatch):
    """A feature with two values took as many places in the sums as the one with the most bins."""
    made = []
    real = boosting.tree_tasks.histogram_task
    monkeypatch.setattr(boosting.tree_tasks, "histogram_task", lambda *given: (made.append(given), real(*given))[1])

    data = boosting._Rows(train, "y", None, "features", boosting.quantile_edges)
    g, _ = data.sums(boosting.tree_tasks.gradients, [(-1, 0.0, -1, -1, 0.0)], [0])
    counts = [len(e) + 1 for e in data.edges]
    assert counts[1:] == [4, 2, 1] and counts[0] > 100
    assert int(made[0][0][-1]) == sum(counts)
    assert g.shape == (1, 4, max(counts)) and not g[0][~np.hstack([np.ones((4, 1), bool), data.valid()])].any()
    assert [float(a.sum()) for a in g[0]] == pytest.approx([float(g[0, 0].sum())] * 4)
    data.release()


def test_margins_of_many_rows_are_stored_more_often(train, monkeypatch):
    few = boosting.boost(train, "y", rounds=6, rate=0.5, depth=2)
    monkeypatch.setattr(boosting, "MANY", 100)
    kept = []
    real = boosting._Rows._keep
    monkeypatch.setattr(boosting._Rows, "_keep", lambda self, rows: (kept.append(len(self.pending)), real(self, rows)))
    many = boosting.boost(train, "y", rounds=6, rate=0.5, depth=2)
    assert kept == [0, 5]
    for a, b in zip(few.nodes(), many.nodes(), strict=True):
        assert [n[:4] for n in a] == [n[:4] for n in b]
        assert [n[4] for n in a] == pytest.approx([n[4] for n in b])


def test_gradient_boosting_equals_numpy(data, train, monkeypatch):
    """It was Spark's, with four jobs and a shuffle of sums per tree; every sum now is one job over a few tasks."""
    x, y, _ = data
    monkeypatch.setattr(training, "GBTClassifier", None, raising=False)
    model = training.fit("gradient_boosting", train, "y", maxIter=4, stepSize=0.4, maxDepth=2)
    cuts = [sorted({n[1] for t in model.nodes() for n in t if n[0] == j}) for j in range(x.shape[1])]
    m = np.zeros(len(y))
    sign = 2.0 * y - 1
    for t, nodes in enumerate(model.nodes()):
        # Residuals in which each leaf is the mean, and of which the root takes the cut with the least variance.
        target = sign if t == 0 else 4 * sign / (1 + np.exp(2 * sign * m))
        at = boosting.tree_tasks.leaves(x, nodes)
        for leaf in np.unique(at):
            assert nodes[leaf][4] == pytest.approx(target[at == leaf].mean() * (0.4 if t else 1.0))
        f, cut = nodes[0][:2]

        def error(a, c):
            return sum(target[s].var() * s.sum() for s in (x[:, a] < c, x[:, a] >= c) if s.any())

        assert all(error(f, cut) <= error(a, c) + 1e-9 for a, cs in enumerate(cuts) for c in cs)
        m += np.array([n[4] for n in nodes])[at]
    got = scores(model, train)
    assert max(abs(got[tuple(r)] - s) for r, s in zip(x, 1 / (1 + np.exp(-2 * m)))) < 1e-9


def test_few_rows_are_few_tasks(spark, train):
    """A sum over some hundred rows took a task per file, each of which is mostly overhead."""
    data = boosting._Rows(train.repartition(8), "y", None, "features", boosting.quantile_edges)
    assert data.parts == 2
    g, h = data.sums(boosting.tree_tasks.gradients, [(-1, 0.0, -1, -1, 0.0)], [0])
    assert h[0, 0].sum() == pytest.approx(train.count() / 4)
    data.release()
