"""Edge cases on small hand-made frames."""

import math
import random
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from propensa.functions import columns as C
from propensa.operators import (
    balance,
    clean,
    evaluate,
    explore,
    features,
    neighbours,
    ordered,
    serve,
    training,
)
from propensa.session import cached, cut_lineage
from propensa.sources.schemas import CUSTOMER, VARIANT_COLUMNS
from propensa.sources.tables import customer_profile, customers_or_profile, read_customers


def values(df, column):
    return [r[column] for r in df.collect()]


# Column expressions


def test_age_bands_at_the_edges(spark):
    ages = [0.0, 25.0, 26.0, 35.0, 45.0, 60.0, 100.0, 101.0, None]
    df = spark.createDataFrame([(a,) for a in ages], "Age double")
    right = values(df.select(C.age_group().alias("g")), "g")
    left = values(df.select(C.age_group(closed="left").alias("g")), "g")
    assert right == [None, "<25", "25-35", "25-35", "35-45", "45-60", "60+", None, None]
    assert left == ["<25", "25-35", "25-35", "35-45", "45-60", "60+", "60+", "60+", None]


def test_income_per_trip(spark):
    df = spark.createDataFrame(
        [(100.0, 0.0), (100.0, 3.0), (None, 2.0)], "MonthlyIncome double, NumberOfTrips double"
    )
    guarded = values(df.select(C.income_per_trip().alias("x")), "x")
    assert guarded == [100.0, pytest.approx(100 / 3), None]
    cut = values(df.select(C.income_per_trip(zero_guard=False, truncate=True).alias("x")), "x")
    assert cut == [None, 33, None]


def test_total_visiting_policies(spark):
    df = spark.createDataFrame(
        [(2, None), (2, 1.0)], "NumberOfPersonVisiting int, NumberOfChildrenVisiting double"
    )
    assert values(df.select(C.total_visiting().alias("x")), "x") == [None, 3.0]
    assert values(df.select(C.total_visiting("zero").alias("x")), "x") == [2.0, 3.0]


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(1.0,), (9.0,), (5.0,), (None,)], "x double")
    assert values(df.select(C.clip("x", 2.0, 6.0).alias("x")), "x") == [2.0, 6.0, 5.0, None]


def test_rounding_modes(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,)], "x double")
    assert values(df.select(C.rounded("x", 0).alias("x")), "x") == [1.0, 2.0, 3.0]
    assert values(df.select(C.rounded("x", 0, "half_even").alias("x")), "x") == [0.0, 2.0, 2.0]


def test_threshold_is_inclusive(spark):
    df = spark.createDataFrame([(0.4,), (0.5,), (0.6,)], "s double")
    assert values(df.select(C.apply_threshold("s", 0.5).alias("p")), "p") == [0, 1, 1]


def test_map_labels_unmapped_is_null(spark):
    df = spark.createDataFrame([(0,), (1,), (2,)], "x int")
    assert values(df.select(C.map_labels("x", {0: "No", 1: "Yes"}).alias("t")), "t") == [
        "No", "Yes", None,
    ]


# Cleaning


def test_median_and_mode(spark):
    df = spark.createDataFrame(
        [(1.0, 3.0), (2.0, 3.0), (3.0, 1.0), (10.0, 1.0), (None, 7.0), (None, None)],
        "a double, b double",
    )
    assert clean.medians(df, ["a"]) == {"a": 2.5}
    assert clean.modes(df, ["b"]) == {"b": 1.0}
    filled = clean.impute(df, ["a"], ["b"])
    assert sorted(values(filled, "a")) == [1.0, 2.0, 2.5, 2.5, 3.0, 10.0]
    assert filled.where(F.col("b").isNull()).count() == 0


def test_mode_of_text_ties_to_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "t string")
    assert clean.modes(df, ["t"]) == {"t": "a"}


def test_inject_missing_is_exact(spark):
    df = spark.range(1000).select(F.col("id"), F.lit(1.0).alias("x"), F.lit("t").alias("y"))
    out = clean.inject_missing(df, {"x": 0.03, "y": 0.0555}, key="id")
    assert out.where(F.col("x").isNull()).count() == 30
    assert out.where(F.col("y").isNull()).count() == 55
    tiny = clean.inject_missing(df, {"x": 0.0001}, key="id")
    assert tiny.where(F.col("x").isNull()).count() == 0


def test_duplicates_treat_nulls_as_equal(spark):
    df = spark.createDataFrame(
        [(1, "a", None), (2, "a", None), (3, "b", 1), (4, None, 1), (5, None, 1)],
        "id long, t string, n int",
    )
    assert clean.duplicate_count(df, ["t", "n"]).first().asDict() == {"n_rows": 5, "n_duplicates": 2}
    assert sorted(values(clean.drop_duplicates(df, ["t", "n"], "id"), "id")) == [1, 3, 4]


def test_align_and_drop_ignore_unknown(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert clean.align_columns(df, ["c", "a"]).first().asDict() == {"c": 0, "a": 1}
    assert clean.drop_columns(df, ["b", "zz"]).columns == ["a"]


def test_columns_by_type(spark):
    df = spark.createDataFrame([(1, 2.0, "x", True)], "a int, b double, c string, d boolean")
    assert clean.columns_by_type(df, ["a"]) == (["b"], ["c", "d"])
    assert clean.column_difference(["a", "b"], ["a"]) == ["b"]


def test_sample_is_exact_and_repeatable(spark):
    df = spark.range(500).withColumnRenamed("id", "CustomerID")
    one, two = clean.sample_rows(df, 80), clean.sample_rows(df.repartition(3), 80)
    assert sorted(values(one, "CustomerID")) == sorted(values(two, "CustomerID"))
    assert one.count() == 80
    assert 150 < clean.sample_share(df, 0.4).count() < 250
    assert clean.sample_share(df, 1.0).count() == 500


def test_variant_has_declared_columns(spark, sf_dir):
    rows = clean.impute(clean.recode_values(customer_profile(spark, sf_dir)))
    assert clean.variant(rows).select(*VARIANT_COLUMNS).count() == 150


# Order statistics


def brute_quantile(numbers, share):
    numbers = sorted(numbers)
    at = share * (len(numbers) - 1)
    low, high = numbers[math.floor(at)], numbers[math.ceil(at)]
    return low + (high - low) * (at - math.floor(at))


@pytest.mark.parametrize("slices", [1, 3, 16])
def test_running_totals(spark, slices):
    rng = random.Random(1)
    rows = [(g, float(v), rng.randint(1, 5)) for g in "ab" for v in rng.sample(range(999), 100)]
    df = spark.createDataFrame(rows, "g string, v double, n long").repartition(5)
    out = ordered.running_totals(df, "v", ["n"], ["g"], slices=slices, prior=True).collect()
    assert len(out) == 200
    for r in out:
        same = sorted((v, n) for g, v, n in rows if g == r["g"])
        smaller = [n for v, n in same if v < r["v"]]
        assert r["n_before"] == sum(smaller)
        assert r["n_all"] == sum(n for _, n in same)
        assert r["n_prior"] == (smaller[-1] if smaller else None)


def test_quantiles_with_a_heavy_value(spark):
    rng = random.Random(2)
    numbers = [5.0] * 400 + [rng.gauss(0, 10) for _ in range(601)]
    rng.shuffle(numbers)
    df = spark.createDataFrame([(x,) for x in numbers] + [(None,)], "x double").repartition(6)
    row = ordered.quantiles(df, ["x"], [0, 0.25, 0.5, 0.9, 1]).first()
    for share, name in ((0, "q0"), (0.25, "q25"), (0.5, "q50"), (0.9, "q90"), (1, "q100")):
        assert row[name] == pytest.approx(brute_quantile(numbers, share))
    assert row["n"] == 1001


def test_quantiles_of_few_values(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,), (None,)], "x double")
    row = ordered.quantiles(df, ["x"], [0.25, 0.5]).first()
    assert (row["q25"], row["q50"]) == (1.75, 2.5)


# Exploration


def test_rate_keeps_empty_segments(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0), (None, 1)], "s string, y int")
    rows = {r["s"]: (r["n"], r["rate"]) for r in explore.rate_by(df, "s", "y", ["a", "b"]).collect()}
    assert rows == {"a": (2, 0.5), "b": (0, None)}


def test_box_stats_finds_outliers(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 2, 3, 4, 5, 6, 7, 8, 9, 100, 100]], "x double")
    row = explore.box_stats(df, ["x"]).first()
    assert (row["q1"], row["median"], row["q3"]) == (3.5, 6.0, 8.5)
    assert (row["whisker_low"], row["whisker_high"], row["n_outliers"]) == (1.0, 9.0, 2)


def test_histogram_of_constant_column(spark):
    df = spark.createDataFrame([(3.0, 1), (3.0, 0)], "x double, y int")
    rows = explore.histogram(df, "x", "y", 10).collect()
    assert {(r["bin"], r["n"]) for r in rows} == {(0, 1)}


def test_histogram_maximum_in_last_bin(spark):
    df = spark.createDataFrame([(float(x), 0) for x in range(11)], "x double, y int")
    rows = {r["bin"]: r["n"] for r in explore.histogram(df, "x", "y", 5).collect()}
    assert rows == {0: 2, 1: 2, 2: 2, 3: 2, 4: 3}


def test_correlations_pairwise_complete(spark):
    data = [(1.0, 2.0, None), (2.0, 4.1, 1.0), (3.0, 5.9, 0.0), (4.0, None, 4.0)]
    df = spark.createDataFrame(data, "a double, b double, c double")
    got = {(r["x"], r["y"]): r["r"] for r in explore.correlations(df, ["a", "b", "c"]).collect()}
    assert len(got) == 9
    assert got[("a", "b")] == pytest.approx(np.corrcoef([1, 2, 3], [2, 4.1, 5.9])[0, 1])
    assert got[("c", "a")] == pytest.approx(np.corrcoef([2, 3, 4], [1, 0, 4])[0, 1])


# Evaluation

TIED = [(0.1, 0), (0.1, 1), (0.5, 0), (0.5, 1), (0.9, 1), (0.9, 0), (0.95, 1)]


def test_auc_with_ties(spark):
    df = spark.createDataFrame(TIED, "s double, y int")
    assert evaluate.auc(df, "y", "s").first()["auc"] == pytest.approx(0.625)


def test_roc_and_pr_shapes(spark):
    df = spark.createDataFrame(TIED, "s double, y int")
    points = {r["threshold"]: (r["fpr"], r["tpr"]) for r in evaluate.roc(df, "y", "s").collect()}
    assert points[math.inf] == (0.0, 0.0)
    assert points[0.1] == (1.0, 1.0)
    assert points[0.9] == (pytest.approx(1 / 3), pytest.approx(0.5))
    corners = evaluate.roc(df, "y", "s", drop_collinear=True)
    assert sorted(values(corners, "threshold")) == [0.1, 0.95, math.inf]
    curve = {r["threshold"]: r for r in evaluate.pr(df, "y", "s").collect()}
    assert (curve[None]["precision"], curve[None]["recall"]) == (1.0, 0.0)
    assert curve[0.1]["recall"] == 1.0


def test_auc_by_group(spark):
    df = spark.createDataFrame(
        [("a", 0.1, 0), ("a", 0.9, 1), ("b", 0.9, 0), ("b", 0.1, 1), ("c", 0.5, 1)],
        "m string, s double, y int",
    )
    got = {r["m"]: r["auc"] for r in evaluate.auc(df, "y", "s", ["m"]).collect()}
    assert got == {"a": 1.0, "b": 0.0, "c": None}


def test_no_predicted_positives(spark):
    df = spark.createDataFrame([(1, 0), (0, 0), (0, 0)], "y int, p int")
    row = evaluate.binary_metrics(df, "y", "p").first()
    assert (row["precision"], row["recall"], row["f1"]) == (0.0, 0.0, 0.0)
    assert row["accuracy"] == pytest.approx(2 / 3)
    cells = {(r["actual"], r["predicted"]): r["n"] for r in evaluate.confusion(df, "y", "p").collect()}
    assert cells == {(0, 0): 2, (0, 1): 0, (1, 0): 1, (1, 1): 0}


def test_best_threshold_takes_the_lowest_on_ties(spark):
    df = spark.createDataFrame([(0.2, 1), (0.4, 1), (0.1, 0)], "s double, y int")
    row = evaluate.best_threshold(df, "y", "s").first()
    assert row["threshold"] == 0.2
    assert row["f1"] == pytest.approx(1.0)


# Splits, folds, preprocessing


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.range(503).select(
        F.col("id").alias("CustomerID"), (F.col("id") % 5 == 0).cast("int").alias("ProdTaken")
    )


def test_split_is_exact_per_class(labelled):
    out = features.split(labelled).groupBy("ProdTaken", "split").count().collect()
    got = {(r["ProdTaken"], r["split"]): r["count"] for r in out}
    assert got[(1, "test")] == math.ceil(0.2 * 101)
    assert got[(0, "test")] == math.ceil(0.2 * 402)
    assert sum(got.values()) == 503
    plain = features.split(labelled, stratify=False).where("split = 'test'").count()
    assert plain == math.ceil(0.2 * 503)
    assert 60 < features.split_by_share(labelled).where("split = 'test'").count() < 140


def test_folds_are_even_and_repeatable(labelled):
    out = features.folds(labelled, k=5)
    sizes = out.groupBy("ProdTaken", "fold").count().collect()
    for label, n in ((0, 402), (1, 101)):
        counts = [r["count"] for r in sizes if r["ProdTaken"] == label]
        assert len(counts) == 5 and sum(counts) == n and max(counts) - min(counts) <= 1
    again = features.folds(labelled.repartition(7), k=5)
    assert out.exceptAll(again).count() == 0


def test_preprocessor_edge_cases(spark):
    train = spark.createDataFrame(
        [(1.0, 4.0, "a"), (3.0, 4.0, "b"), (None, 4.0, "c"), (2.0, 4.0, None)],
        "x double, same double, t string",
    )
    pre = features.Preprocessor.fit(train, [])
    assert pre.feature_names() == ["num_x", "num_same", "t_b", "t_c"]
    out = pre.apply(train, []).collect()
    assert [r["num_same"] for r in out] == [0.0] * 4
    x = np.array([1.0, 3.0, 2.0, 2.0])
    assert [r["num_x"] for r in out] == pytest.approx(list((x - x.mean()) / x.std()))
    new = spark.createDataFrame([(1.0, 4.0, "zz")], train.schema)
    row = pre.apply(new, []).first()
    assert (row["t_b"], row["t_c"]) == (0.0, 0.0)
    strict = features.Preprocessor.fit(train, [], unknown="error", onehot_first=True)
    assert strict.feature_names()[0] == "t_b"
    with pytest.raises(Exception, match="unknown category"):
        strict.apply(new, []).collect()


def test_preprocessor_quotes_text(spark):
    train = spark.createDataFrame([("it's",), ("a\\b",), ("plain",)], "t string")
    pre = features.Preprocessor.fit(train, [])
    totals = pre.apply(train, []).agg(*[F.sum(f"`{n}`").alias(n) for n in pre.feature_names()])
    assert list(totals.first()) == [1.0, 1.0]


def test_class_weights(labelled):
    assert features.class_weights(labelled, "ProdTaken") == {
        0: pytest.approx(503 / 804), 1: pytest.approx(503 / 202),
    }
    assert features.class_weights(labelled, "ProdTaken", "ratio")[1] == pytest.approx(402 / 101)
    assert features.class_weights(labelled, "ProdTaken", 4) == {0: 1.0, 1: 4.0}


# Neighbours and balancing


def brute_neighbours(points, ids, k):
    out = {}
    for a, i in zip(points, ids):
        d2 = [(round(float(((a - b) ** 2).sum()), 9), j) for b, j in zip(points, ids) if j != i]
        out[i] = [j for _, j in sorted(d2)[:k]]
    return out


def found_neighbours(spark, points, ids, k=5):
    rows = [(int(i), [float(x) for x in p]) for i, p in zip(ids, points)]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(4)
    got = neighbours.knn(df, "id", "v", k).collect()
    out = {int(i): {} for i in ids}
    for r in got:
        out[r["id"]][r["rank"]] = r["neighbour"]
    return {i: [n for _, n in sorted(found.items())] for i, found in out.items()}


@pytest.mark.parametrize("shape", ["spread", "grid", "copies"])
def test_knn_equals_brute_force(spark, monkeypatch, shape):
    """Small cells and blocks force every path: several cells, several blocks, routing, copies."""
    monkeypatch.setattr(neighbours, "CELL_ROWS", 40)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 25)
    monkeypatch.setattr(neighbours, "CANDIDATE_BLOCK", 30)
    rng = np.random.default_rng(3)
    points = {
        "spread": rng.normal(size=(300, 3)),
        "grid": rng.integers(0, 4, size=(240, 3)).astype(float),
        "copies": np.vstack([np.zeros((120, 3)), rng.normal(size=(180, 3))]),
    }[shape]
    ids = [int(i) for i in rng.permutation(len(points))]
    assert found_neighbours(spark, points, ids) == brute_neighbours(points, ids, 5)


def test_knn_of_tiny_tables(spark):
    points = np.array([[0.0], [1.0], [3.0]])
    assert found_neighbours(spark, points, [7, 8, 9]) == {7: [8, 9], 8: [7, 9], 9: [8, 7]}
    empty = spark.createDataFrame([], "id long, v array<double>")
    assert neighbours.knn(empty, "id", "v").count() == 0


def test_knn_in_64_dimensions(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("label = 3").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("v")
    )
    local = [(r["vec_id"], np.array(r["v"])) for r in rows.collect()]
    want = brute_neighbours([v for _, v in local], [i for i, _ in local], 5)
    got = {i: [] for i in want}
    for r in neighbours.knn(rows, "vec_id", "v").orderBy("rank").collect():
        got[r["vec_id"]].append(r["neighbour"])
    assert got == want


def test_task_code_needs_no_installed_package(tmp_path):
    from pyspark import cloudpickle

    from propensa.functions import blocks

    stored = tmp_path / "code"
    stored.write_bytes(cloudpickle.dumps([blocks.search(2), blocks.place(np.zeros((1, 1)))]))
    check = (
        "import pickle, sys; pickle.load(open(sys.argv[1], 'rb')); "
        "assert not [m for m in sys.modules if m.startswith('propensa')]"
    )
    subprocess.run([sys.executable, "-I", "-c", check, str(stored)], cwd=tmp_path, check=True)


@pytest.fixture(scope="module")
def unbalanced(spark):
    rng = np.random.default_rng(5)
    rows = [(i, int(i % 6 == 0), [float(x) for x in rng.normal(size=4)]) for i in range(240)]
    return spark.createDataFrame(rows, "id long, y int, v array<double>")


def test_smote_balances_exactly_and_interpolates(unbalanced):
    both = balance.oversample(unbalanced, "id", "y", "v").groupBy("y").count().collect()
    assert {r["y"]: r["count"] for r in both} == {0: 200, 1: 200}
    point = {r["id"]: np.array(r["v"]) for r in unbalanced.collect()}
    made = balance.smote(unbalanced, "id", "y", "v").collect()
    assert len(made) == 160
    for r in made:
        assert r["id"] % 6 == 0 and r["neighbour"] % 6 == 0 and 0 <= r["gap"] < 1
        want = point[r["id"]] + r["gap"] * (point[r["neighbour"]] - point[r["id"]])
        assert np.allclose(r["v"], want)
    draws = [r["id"] for r in made]
    assert max(draws.count(i) for i in set(draws)) - min(draws.count(i) for i in set(draws)) <= 1


def test_smote_is_repeatable(unbalanced):
    one = balance.smote(unbalanced, "id", "y", "v")
    two = balance.smote(unbalanced.repartition(5), "id", "y", "v")
    assert one.exceptAll(two).count() == 0


def test_smote_needs_enough_rows(spark):
    df = spark.createDataFrame([(i, int(i < 3), [float(i)]) for i in range(20)], "id long, y int, v array<double>")
    with pytest.raises(ValueError, match="neighbours"):
        balance.smote(df, "id", "y", "v")


# Training and serving


def test_draw_settings_without_listing_the_grid():
    drawn = training.draw_settings(training.BOOSTED_GRID, 100)
    assert len(drawn) == 100
    assert len({tuple(sorted(d.items())) for d in drawn}) == 100
    assert len(training.draw_settings({"a": [1, 2]}, 10)) == 2


def test_importance_names_must_match(spark, unbalanced):
    from pyspark.ml.functions import array_to_vector

    rows = unbalanced.select("id", "y", array_to_vector("v").alias("features"))
    model = training.fit("decision_tree", rows, label="y", maxDepth=2)
    with pytest.raises(ValueError, match="feature names"):
        training.importances(model, ["a"], rows)


def test_search_balances_inside_the_folds(spark, unbalanced):
    from pyspark.ml.functions import array_to_vector

    rows = cached(unbalanced.select("id", "y", array_to_vector("v").alias("features")))
    table, best, model = training.random_search(
        rows, "decision_tree", {"maxDepth": [2, 3]}, n_iter=2, k=2, key="id", label="y", balance=True
    )
    assert table.count() == 2 and set(best) == {"maxDepth"}
    assert training.predict(model, rows, ["id"]).count() == 240


def test_adaboost_beats_chance_and_stops_when_perfect(spark):
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(9)
    data = [(i, [float(a), float(b)]) for i, (a, b) in enumerate(rng.normal(size=(300, 2)))]
    df = spark.createDataFrame(data, "id long, v array<double>")
    diagonal = (F.col("v")[0] + F.col("v")[1] > 0).cast("int")
    rows = cached(df.select("id", diagonal.alias("y"), array_to_vector("v").alias("features")))
    model = training.fit("adaboost", rows, label="y", n=8)
    judged = training.predict(model, rows, ["y"])
    assert evaluate.binary_metrics(judged, "y", "prediction").first()["accuracy"] > 0.8
    assert evaluate.auc(judged, "y", "score").first()["auc"] > 0.9
    easy = cached(df.select((F.col("v")[0] > 0).cast("int").alias("y"), array_to_vector("v").alias("features")))
    assert len(training.fit("adaboost", easy, label="y", n=8).nodes()) < 8


def test_search_by_accuracy(spark, unbalanced):
    from pyspark.ml.functions import array_to_vector

    rows = cached(unbalanced.select("id", "y", array_to_vector("v").alias("features")))
    table, _, _ = training.random_search(
        rows, "decision_tree", {"maxDepth": [1, 2]}, n_iter=2, k=2, key="id", label="y",
        metric="accuracy",
    )
    assert all(0.5 < r["accuracy"] <= 1 for r in table.collect())
    with pytest.raises(ValueError, match="metric"):
        training.random_search(rows, "decision_tree", {"maxDepth": [1]}, key="id", label="y", metric="x")


def test_csv_nan_is_missing(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text("CustomerID,Age,Gender\n1,NaN,Male\n2,31,\n")
    schema = "CustomerID long, Age double, Gender string"
    from pyspark.sql import types as T

    rows = read_customers(spark, str(path), T._parse_datatype_string(schema)).collect()
    assert [(r["Age"], r["Gender"]) for r in rows] == [(None, "Male"), (31.0, None)]


def test_source_fallback_and_csv(spark, sf_dir, tmp_path):
    from propensa.sources.sinks import write_customers

    rows = customer_profile(spark, sf_dir)
    path = str(tmp_path / "customers")
    write_customers(rows, path)
    stored = customers_or_profile(spark, path, sf_dir)
    assert stored.schema == CUSTOMER
    assert stored.exceptAll(rows).count() == 0 and stored.count() == 150
    assert customers_or_profile(spark, str(tmp_path / "none.csv"), sf_dir).count() == 150
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_customers(spark, str(tmp_path / "none.csv")).count()


def test_cut_lineage_keeps_rows_and_schema(spark):
    df = spark.range(10).select("id", F.array(F.lit(1.5)).alias("v"))
    stored = cut_lineage(df)
    assert stored.dtypes == df.dtypes
    assert stored.exceptAll(df).count() == 0


def test_workbench(spark, sf_dir):
    from propensa.workbench import load_and_clean, train_models

    raw, cleaned = load_and_clean(spark, "/no/such/file.csv", sf_dir)
    assert "CustomerID" not in cleaned.columns
    assert cleaned.count() == raw.count()
    assert all(r["n_null"] == 0 for r in explore.null_counts(cleaned).collect())
    done = train_models(raw, {"decision_tree": {"maxDepth": 3}, "random_forest": {"numTrees": 5}})
    assert done.best_name in done.models
    scored = serve.score(raw.drop("ProdTaken"), done.bundle())
    assert scored.count() == 150
    assert scored.where((F.col("probability") >= done.threshold).cast("int") != F.col("decision")).count() == 0


def test_scoring_fills_missing_columns(spark, sf_dir):
    from propensa.plans.modelling import _bundle
    from propensa.sources.tables import customers_from_records

    made = _bundle(spark, sf_dir)
    people = [
        {"CustomerID": 1, "Age": 30, "MonthlyIncome": 70000, "Passport": 1, "NumberOfTrips": 6},
        {"CustomerID": 2, "Age": 55.0, "Occupation": "ASTRONAUT", "Gender": "Fe Male"},
    ]
    judged = serve.score(customers_from_records(spark, people), made, explain=True).collect()
    assert [r["CustomerID"] for r in judged] == [1, 2]
    assert "Has Passport" in [f["title"] for f in judged[0]["factors"]]
    assert all(0 <= r["probability"] <= 1 for r in judged)
    rows = customer_profile(spark, sf_dir).drop("ProdTaken", "OwnCar", "CityTier")
    assert serve.score(rows, made).count() == 150


# Searches that prune, sketches that bracket


def test_knn_compares_few_rows_and_survives_a_hot_vector(spark):
    rng = np.random.default_rng(12)
    scattered = np.hstack([rng.normal(size=(900, 2)), rng.integers(0, 2, (900, 8)), rng.integers(0, 6, (900, 2))])
    points = np.vstack([scattered, np.repeat(scattered[:1], 600, axis=0)]).astype(float)
    ids = [int(i) for i in rng.permutation(len(points))]
    assert found_neighbours(spark, points, ids) == brute_neighbours(points, ids, 5)
    rows = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in zip(ids, points)], "id long, v array<double>")
    cost = neighbours.search_cost(rows, "id", "v").first()
    assert cost["n"] == 1500 and 0 < cost["share"] < 0.2


def test_quantiles_shuffle_few_rows(spark):
    n = 40_000
    df = spark.range(n).select(
        (F.col("id") % 2).cast("int").alias("g"), F.sqrt(F.col("id")).alias("x"), (F.col("id") % 7).alias("d"),
        F.when(F.col("id") % 3 == 0, -F.col("id")).alias("y"), F.lit(None).cast("double").alias("none"),
    )
    shares = [0, 0.001, 0.25, 0.5, 0.999, 1]
    whole = {r["column"]: r for r in ordered.quantiles(df, ["x", "d", "y", "none"], shares).collect()}
    values = {"x": [math.sqrt(i) for i in range(n)], "d": [i % 7 for i in range(n)], "y": [-i for i in range(0, n, 3)]}
    assert set(whole) == set(values)
    for c, v in values.items():
        assert whole[c]["n"] == len(v)
        for q in shares:
            assert whole[c][ordered.quantile_name(q)] == pytest.approx(brute_quantile(v, q)), (c, q)
    parts = {(r["g"], r["column"]): r for r in ordered.quantiles(df, ["x", "y"], [0.25, 0.5], ["g"]).collect()}
    for g in (0, 1):
        assert parts[g, "x"]["q50"] == pytest.approx(brute_quantile(values["x"][g::2], 0.5))
        assert parts[g, "y"]["q25"] == pytest.approx(brute_quantile([-i for i in range(0, n, 3) if i % 2 == g], 0.25))
    plan = ordered.quantiles(df, ["x"], [0.5])._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan


def test_quantiles_rank_only_the_bracket(spark):
    known = spark.range(40_000).select(F.sqrt("id").alias("v0"))
    only = ordered._brackets(known, 1, [0.25, 0.5, 0.75], []).first()
    inside = sum(known.where(F.col("v0").between(a, b)).count() for a, b in zip(only["low0"], only["high0"]))
    assert 0 < inside < 0.05 * 40_000


def test_quantiles_order_nan_last(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (2.0,)], "x double")
    row = ordered.quantiles(df, ["x"], [0, 0.5]).first()
    assert (row["q0"], row["q50"], row["n"]) == (1.0, 2.0, 3)


def test_correlations_of_many_columns(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 100)) + 1e6
    x[:, 1] = 3 * x[:, 0] - 7
    x[:, 2] = 5.0
    holes = rng.random(x.shape) < 0.1
    rows = [[None if h else float(v) for v, h in zip(r, g)] for r, g in zip(x, holes)]
    names = [f"c{i}" for i in range(100)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names)).repartition(5)
    got = {(r["x"], r["y"]): r["r"] for r in explore.correlations(df, names).collect()}
    assert len(got) == 10_000
    for i, j in [(0, 0), (0, 1), (3, 4), (4, 3), (50, 99)]:
        both = ~holes[:, i] & ~holes[:, j]
        assert got[names[i], names[j]] == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], abs=1e-6)
    assert math.isnan(got["c2", "c3"])
    one = spark.createDataFrame([(1.0, 2.0), (None, 3.0)], "a double, b double")
    assert {r["r"] for r in explore.correlations(one, ["a", "b"]).where("x != y").collect()} == {None}
    plan = explore.correlations(df, names)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan


def test_discrete_columns_are_counted_without_copies_of_the_table(spark):
    df = spark.range(5_000).select(
        (F.col("id") % 25).alias("a"), (F.col("id") % 24).alias("b"), F.col("id").alias("c"),
        F.when(F.col("id") % 2 == 0, F.col("id") % 50).alias("d"), F.lit(None).cast("int").alias("e"),
    )
    found = explore.discrete_or_continuous(df, list("abcde"))
    assert {r["column"]: (r["n_distinct"], r["kind"]) for r in found.collect()} == {
        "a": (25, "discrete"), "b": (24, "discrete"), "c": (5_000, "continuous"), "d": (26, "continuous"), "e": (1, "discrete"),
    }
    assert "Expand" not in found._jdf.queryExecution().executedPlan().toString()
    rough = explore.discrete_or_continuous(df, ["a", "c"], exact=False).collect()
    assert {r["column"]: r["kind"] for r in rough} == {"a": "discrete", "c": "continuous"}


def test_density_adds_up_to_one(spark):
    df = spark.range(3_000).select((F.col("id") % 2).alias("g"), (F.sqrt("id") * F.lit(2.0)).alias("x"))
    curve = explore.density(df, "x", ["g"], grid=150).orderBy("g", "x").collect()
    assert len(curve) == 300
    for g in (0, 1):
        part = [r for r in curve if r["g"] == g]
        area = sum((b["x"] - a["x"]) * (a["density"] + b["density"]) / 2 for a, b in zip(part, part[1:]))
        assert area == pytest.approx(1, abs=0.02)


def test_box_of_a_whole_table(spark):
    df = spark.createDataFrame([(float(i),) for i in range(9)] + [(100.0,), (None,)], "x double")
    box = explore.box_stats(df, ["x"]).first()
    assert (box["n"], box["median"], box["whisker_low"], box["whisker_high"], box["n_outliers"]) == (10, 4.5, 0.0, 8.0, 1)


def test_cutoffs_are_found_once(spark):
    df = spark.range(100).select("id", (F.col("id") % 4 == 0).cast("int").alias("y"))
    parted = features.split(df, "id", "y")
    plan = parted._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "HashAggregate" not in plan
    assert parted.where("split = 'test'").groupBy("y").count().orderBy("y").collect() == [(0, 15), (1, 5)]
