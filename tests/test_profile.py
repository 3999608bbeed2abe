import pytest
from pyspark.sql import functions as F

from runsight.operators import catalog, profile


def _profile(df, target):
    return profile.profile_dataset(df, target).first()


def _numbers(spark, n, distinct, kind="int"):
    return spark.range(n).select((F.col("id") % distinct).cast(kind).alias("y"), F.sin(F.col("id") * 7.3).alias("x"), F.lit("a").alias("s"))


@pytest.mark.parametrize("distinct, task, metric", [(2, "classification", "accuracy"), (3, "classification", "f1_weighted"), (20, "classification", "f1_weighted"), (21, "regression", "r2")])
def test_task_threshold(spark, distinct, task, metric):
    p = _profile(_numbers(spark, 400, distinct), "y")
    assert (p["task"], p["metric"], p["direction"]) == (task, metric, "maximize")
    if task == "classification":
        assert p["target_stats"]["n_classes"] == distinct
    else:
        assert p["target_stats"]["mean"] is not None and p["target_stats"]["n_classes"] is None
    counts = {r["value"]: r["n"] for r in profile.class_distribution(_numbers(spark, 400, distinct), "y").collect()}
    assert counts == ({str(i): len(range(i, 400, distinct)) for i in range(distinct)} if task == "classification" else {})


def test_text_target_with_many_values_is_classification(spark):
    df = spark.range(3000).select(F.col("id").cast("string").alias("y"), F.col("id").alias("x"))
    p = _profile(df, "y")
    assert p["task"] == "classification" and p["target_stats"]["n_classes"] == 3000
    assert profile.class_distribution(df, "y").count() == 3000
    assert profile.value_counts(df, "y").count() == 3000


def test_missing_share_counts_nan_null_and_target(spark):
    df = spark.createDataFrame([(1.0, float("nan"), "a"), (2.0, 1.0, None), (3.0, 2.0, "b"), (1.0, 5.0, "c")], "y double, x double, s string")
    assert abs(_profile(df, "y")["missing_pct"] - 100 * 2 / 12) < 1e-9
    assert abs(profile.missing_pct(df).first()[0] - 100 * 2 / 12) < 1e-9


def test_kinds_and_booleans(spark):
    df = spark.sql("SELECT 1 AS y, true AS b, 2.5 AS d, 'x' AS s, timestamp'2020-01-01' AS t FROM range(3)")
    assert profile.feature_types(df, "y") == {"b": "numeric", "d": "numeric", "s": "categorical", "t": "categorical"}
    assert profile.select_by_type(df, "number").columns == ["y", "d"]
    assert profile.detect_date_columns(df, ["t", "s", "gone"]) == ["t"]


@pytest.mark.parametrize(
    "values, found",
    [(["2020-01-05"] * 9 + ["x"], True), (["2020-01-05"] * 8 + ["x", "y"], False), (["01/31/2020", "Jan 5, 2021", "2020-01-01T10:00:00"], True), (["2020", "2021"], False), ([None, None], False), (["x"] * 3 + [None], False)],
)
def test_date_detection(spark, values, found):
    df = spark.createDataFrame([(v,) for v in values], "s string")
    assert profile.detect_date_columns(df) == (["s"] if found else [])


def test_leakage_by_name_and_correlation(spark):
    df = spark.range(200).select(F.col("id").cast("double").alias("price"), F.lit(1).alias("price_encoded"), (F.col("id") * 1.0001).alias("close"), F.rand(1).alias("noise"), F.when(F.col("id") > 500, 1.0).alias("empty"))
    warnings = profile.leakage_warnings(df, "price")
    assert len(warnings) == 2 and "price_encoded" in warnings[0] and "'close'" in warnings[1] and "1.000" in warnings[1]


def test_bad_inputs(spark):
    good = spark.createDataFrame([(1.0, 2.0)], "x double, y double")
    for df, target in [
        (good.limit(0), "y"), (good, "z"), (good.withColumn("y", F.lit(float("nan"))), "y"), (good.select("y"), "y"), (good.withColumn("x", F.lit(None).cast("double")), "y"),
    ]:
        with pytest.raises(ValueError):
            profile.validate_input(df, target)
    profile.validate_input(good, "y")


def test_distinct_up_to_is_exact_below_the_bound(spark):
    df = spark.createDataFrame([(float(i % 7) if i % 10 else None,) for i in range(500)] + [(float("nan"),)], "x double").repartition(6)
    assert profile.distinct_up_to(df, "x", 21) == 7
    assert profile.distinct_up_to(df, "x", 3) == 3


def test_summary_uses_ten_as_its_own_threshold(spark):
    kind = lambda n: {r["key"]: r["value"] for r in profile.data_summary(_numbers(spark, 100, n), "y").collect() if r["section"] == "target"}["type"]
    assert kind(10) == "categorical" and kind(11) == "continuous"


def test_directions():
    assert catalog.direction_of("rmse") == "minimize" and catalog.direction_of("mine", "maximize") == "maximize"
    with pytest.raises(ValueError):
        catalog.direction_of("mine")


@pytest.mark.parametrize("goal, label", [("predict price", "price"), ("Please PREDICT the target", "target"), ("improve sales", "sales"), ("unpredictable the odds", "odds")])
def test_label_from_goal(spark, goal, label):
    assert spark.createDataFrame([(goal,)], "g string").select(catalog.label_from_goal(F.col("g"))).first()[0] == label


def test_profile_queries_tell_the_rows_of_each_class(spark, tmp_path):
    from runsight.queries import profiling

    flags = spark.createDataFrame([("N", 1.0), ("A", 2.0), ("N", 3.0), (None, 4.0)] + [("R", float(i)) for i in range(30)], "l_returnflag string, l_extendedprice double")
    flags.write.parquet(str(tmp_path / "lineitem.parquet"))
    found = profiling.profile_classification(spark, str(tmp_path)).first()
    assert (found["n_classes"], found["distribution"]) == (3, "A=1,N=2,R=30")
    assert profiling.profile_regression(spark, str(tmp_path)).first()["distribution"] is None
