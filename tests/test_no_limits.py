"""Any number of groups, columns and categories; inputs as they really arrive."""

import pytest
from pyspark.sql import functions as F

from propensa.operators import clean, features, training
from propensa.sources.schemas import CUSTOMER
from propensa.sources.tables import read_customers


def test_many_folds(spark):
    df = spark.range(3000).select(F.col("id"), (F.col("id") % 2).cast("int").alias("y"))
    sizes = features.folds(df, "id", "y", k=150).groupBy("y", "fold").count().collect()
    assert len(sizes) == 300 and all(r["count"] == 10 for r in sizes)


def test_rows_without_label_are_dealt_out(spark):
    df = spark.range(100).select("id", F.when(F.col("id") % 10 > 1, F.col("id") % 2).cast("int").alias("y"))
    dealt = features.folds(df, "id", "y", k=5)
    assert dealt.where("fold is null").count() == 0
    assert {r["count"] for r in dealt.where("y is null").groupBy("fold").count().collect()} == {4}
    assert features.split(df, "id", "y").groupBy("split").count().count() == 2
    assert features.split(df, "id", "y").where("y is null and split = 'test'").count() == 4


def test_stratified_by_many_values(spark):
    df = spark.range(3000).select("id", (F.col("id") % 300).cast("int").alias("y"))
    parted = features.split(df, "id", "y").groupBy("y", "split").count().collect()
    assert sorted({(r["split"], r["count"]) for r in parted}) == [("test", 2), ("train", 8)]


def test_blanking_many_columns(spark):
    names = [f"c{i}" for i in range(250)]
    df = spark.range(20).select("id", *[F.lit(1).alias(c) for c in names])
    out = clean.inject_missing(df, dict.fromkeys(names, 0.1), key="id")
    counts = out.agg(*[F.count(c).alias(c) for c in names]).first()
    assert set(counts) == {18}


def test_column_of_many_categories(spark):
    df = spark.range(20_000).select("id", (F.col("id") % 2).cast("int").alias("y"), F.format_string("v%05d", "id").alias("c"))
    pre = features.Preprocessor.fit(df, ["id", "y"])
    assert len(pre.feature_names()) == 19_999
    rows = pre.matrix(df.where("id in (0, 1, 19999)"), ["id"]).orderBy("id").collect()
    assert [r["features"].indices.tolist() for r in rows] == [[], [0], [19_998]]
    strange = pre.matrix(spark.createDataFrame([(1, 0, "new"), (2, 0, None)], "id bigint, y int, c string"), ["id"])
    assert [len(r["features"].indices) for r in strange.orderBy("id").collect()] == [0, 0]


def test_other_types_are_named(spark):
    df = spark.range(1).select("id", F.current_date().alias("d"))
    with pytest.raises(ValueError, match="d \\(date\\)"):
        clean.columns_by_type(df)


def test_mode_of_a_boolean(spark):
    df = spark.createDataFrame([(True,), (True,), (False,), (None,)], "b boolean")
    assert sorted(r["b"] for r in clean.impute(df, [], ["b"]).collect()) == [False, True, True, True]


def test_duplicates_with_and_without_key(spark):
    rows = [(None, "a"), (None, "a"), (3, "b"), (2, "b"), (2, "b"), (4, None), (5, None)]
    df = spark.createDataFrame(rows, "id bigint, t string")
    kept = clean.drop_duplicates(df, ["t"], "id").collect()
    assert sorted(((r["id"], r["t"]) for r in kept), key=repr) == [(2, "b"), (4, None), (None, "a")]
    assert clean.drop_duplicates(df).count() == 5
    assert clean.drop_duplicates(df.drop("id")).count() == 3


def test_missing_columns_get_their_type(spark):
    out = clean.align_columns(spark.createDataFrame([("5",)], "CityTier string"), CUSTOMER)
    assert out.dtypes == [(f.name, f.dataType.simpleString()) for f in CUSTOMER]
    row = out.first()
    assert (row["CityTier"], row["Gender"], row["Age"]) == (5, "0", 0.0)


def test_csv_columns_by_name(spark, tmp_path):
    names = CUSTOMER.fieldNames()[::-1]
    path = tmp_path / "customers.csv"
    values = {f.name: "7" if f.dataType.typeName() != "string" else "x" for f in CUSTOMER} | {"CustomerID": "31", "Age": "44.5"}
    path.write_text(",".join(["extra", *names]) + "\n" + ",".join(["e", *[values[n] for n in names]]) + "\n")
    row = read_customers(spark, str(path)).first()
    assert (row["CustomerID"], row["Age"], row["Gender"]) == (31, 44.5, "x")
    path.write_text(",".join(names) + "\n" + ",".join(["?" for _ in names]) + "\n")
    with pytest.raises(Exception, match="FAILFAST"):
        read_customers(spark, str(path)).collect()
    (tmp_path / "short.csv").write_text("Age\n1\n")
    with pytest.raises(ValueError, match="has no column"):
        read_customers(spark, str(tmp_path / "short.csv"))


def test_adaboost_uses_weights(spark):
    from pyspark.ml.functions import array_to_vector

    x = F.array((F.col("id") % 10).cast("double"), (F.col("id") % 3).cast("double"))
    y = ((F.col("id") % 10 > 6) & (F.col("id") % 4 > 0)).cast("int")
    df = spark.range(200).select("id", y.alias("y"), array_to_vector(x).alias("features"))
    df = df.withColumn("w", F.when(F.col("y") == 1, 8.0).otherwise(1.0))
    plain = training.fit("adaboost", df, "y", n=3)
    heavy = training.fit("adaboost", df, "y", "w", n=3)
    a = [r["score"] for r in training.predict(plain, df, ["id"]).orderBy("id").collect()]
    b = [r["score"] for r in training.predict(heavy, df, ["id"]).orderBy("id").collect()]
    assert a != b


def test_compare_leaves_the_callers_cache(spark):
    from pyspark.ml.functions import array_to_vector

    df = spark.range(60).select(
        (F.col("id") % 2).cast("int").alias("y"), array_to_vector(F.array((F.col("id") % 7).cast("double"))).alias("features")
    ).persist()
    training.compare(df, df, {"decision_tree": {"maxDepth": 2}}, label="y")
    assert df.storageLevel.useMemory
    df.unpersist()


def test_whole_line_up_is_the_default():
    import os
    import subprocess
    import sys

    code = "from propensa.plans import modelling as m; assert m._line_up() == {k: dict(v) for k, v in m.training.LINE_UP.items()}"
    env = {k: v for k, v in os.environ.items() if k != "PROPENSA_ROUNDS_SHARE"}
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], check=True, env=env, cwd=root)


def test_integer_columns_stay_integers(spark):
    big = 2**60 + 1
    df = spark.createDataFrame([(big, 1, 1.5), (big, 2, None), (None, None, 1.5)], "a bigint, b int, c double")
    assert clean.modes(df, ["a", "b", "c"]) == {"a": big, "b": 1, "c": 1.5}
    out = clean.impute(df, [], ["a", "b", "c"])
    assert dict(out.dtypes) == {"a": "bigint", "b": "int", "c": "double"}
    assert [r["a"] for r in out.collect()] == [big] * 3
    assert dict(clean.impute(df, ["b"], []).dtypes)["b"] == "double"


def test_kept_tables_are_released(spark):
    from propensa.session import cached, release

    release(spark)
    df = spark.range(10)
    kept = cached(df)
    assert cached(kept) is kept and kept.storageLevel.useMemory
    assert release(spark) == 1 and not kept.storageLevel.useMemory and release(spark) == 0


def test_remembered_until_a_table_changes(spark, tmp_path):
    from propensa.session import remembered

    path, calls = str(tmp_path / "t"), []
    spark.range(3).write.parquet(path)
    make = lambda: calls.append(1) or len(calls)
    assert [remembered(spark, "x", [path], make) for _ in range(2)] == [1, 1]
    assert remembered(spark, "y", [path], make) == 2
    spark.range(4).write.mode("append").parquet(path)
    assert remembered(spark, "x", [path], make) == 3


def test_published_versions(spark, tmp_path):
    from propensa.operators import serve

    rows = spark.range(60).select(
        (F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 7).cast("double").alias("x")
    )
    pre = features.Preprocessor.fit(rows, ["y"])
    ready = pre.matrix(rows, ["y"])
    root = str(tmp_path / "bundles")
    assert serve.versions(spark, root) == []
    with pytest.raises(ValueError, match="no such version"):
        serve.current(spark, root)
    for name, params in (("decision_tree", {"maxDepth": 2}), ("boosted_regularized", {"rounds": 2})):
        model = training.fit(name, ready, "y", **params)
        serve.publish(serve.bundle(pre, model, 0.4, name), spark, root)
    assert serve.versions(spark, root) == [1, 2]
    latest, first = serve.current(spark, root), serve.current(spark, root, 1)
    assert (latest.model, first.model, first.threshold) == ("boosted_regularized", "decision_tree", 0.4)
    assert latest.pipeline.transform(rows).select("score").count() == 60
