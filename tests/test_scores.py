import math
import random

import pytest
from pyspark.sql import functions as F

from runsight.operators import diagnostics, metrics
from runsight.plans import running

from .conftest import rows


def _pred(spark, y, p, kind="double"):
    cast = float if kind == "double" else int
    data = [(i, cast(a), cast(b)) for i, (a, b) in enumerate(zip(y, p))]
    return spark.createDataFrame(data, f"row_id long, y_true {kind}, y_pred {kind}")


def test_worst_prediction(spark):
    out = diagnostics.worst_predictions(_pred(spark, [1.0, 2, 3, 4, 5], [1.0, 2, 3, 4, 15]), 3).collect()
    assert (out[0]["row_id"], out[0]["abs_error"]) == (4, 10.0) and len(out) == 3


@pytest.mark.parametrize("y, p, wanted", [([1.0, 2, 3], [3.0, 4, 5], ("over", 2.0)), ([5.0, 6, 7], [3.0, 4, 5], ("under", -2.0)), ([1.0, 2], [1.0, 2], ("neutral", 0.0))])
def test_bias(spark, y, p, wanted):
    assert rows(diagnostics.bias(_pred(spark, y, p))) == [wanted]


def test_constant_features_have_no_correlation(spark):
    df = _pred(spark, [1.0, 2, 3], [1.0, 3, 5]).withColumn("one", F.lit(1.0)).withColumn("up", F.col("row_id").cast("double"))
    assert rows(diagnostics.feature_error_correlation(df, ["one", "up"])) == [("up", pytest.approx(1.0))]


def test_per_class_accuracy_and_pairs(spark):
    out = rows(diagnostics.per_class_accuracy(_pred(spark, [0, 0, 0, 1, 1, 1], [0, 0, 1, 1, 1, 0], "int")), "class", "accuracy")
    assert out == [(0, pytest.approx(2 / 3)), (1, pytest.approx(2 / 3))]
    pairs = diagnostics.confused_pairs(_pred(spark, [0, 0, 1, 1, 2, 2], [1, 1, 0, 0, 0, 2], "int")).collect()
    assert [(r["y_true"], r["y_pred"], r["n"]) for r in pairs] == [(0, 1, 2), (1, 0, 2), (2, 0, 1)]


def test_confident_mistakes_come_first(spark):
    df = spark.createDataFrame([(0, 0, 1, [0.1, 0.9]), (1, 0, 1, [0.4, 0.6]), (2, 0, 1, [0.3, 0.7]), (3, 1, 1, [0.0, 1.0])], "row_id long, y_true int, y_pred int, proba array<double>")
    assert [r["row_id"] for r in diagnostics.misclassified_samples(df).collect()] == [0, 2, 1]


def test_missing_labels_compare_like_values(spark):
    df = spark.createDataFrame([(0, None, None), (1, "a", None), (2, "a", "a")], "row_id long, y_true string, y_pred string")
    assert [r["row_id"] for r in diagnostics.misclassified(df).collect()] == [1]


def _auc(pairs):
    pos, neg = [s for y, s in pairs if y], [s for y, s in pairs if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_auc_equals_all_pairs_on_both_paths(spark, monkeypatch):
    draw = random.Random(4)
    data = [(g, draw.randint(0, 1), draw.choice([draw.random(), draw.randint(0, 3) / 3])) for _ in range(400) for g in ("a", "b")]
    df = spark.createDataFrame(data, "g string, y_true int, score double").repartition(6)
    wanted = {g: _auc([(y, s) for k, y, s in data if k == g]) for g in "ab"}
    check = lambda: {r["g"]: r["auc"] for r in metrics.auc(df, ["g"]).collect()} == pytest.approx(wanted)
    assert check()
    monkeypatch.setattr(running, "CHUNK_ROWS", 50)
    assert check()
    assert metrics.auc(df.where("g = 'a'")).first()["auc"] == pytest.approx(wanted["a"])


def test_weighted_f1_counts_classes_that_are_never_predicted(spark):
    df = _pred(spark, [0, 0, 1, 2], [0, 1, 1, 0], "int")
    f = {0: 2 * 1 / (2 + 2), 1: 2 * 1 / (1 + 2), 2: 0.0}
    assert metrics.score(df, "f1_weighted").first()["score"] == pytest.approx((2 * f[0] + f[1] + f[2]) / 4)


def test_r2_edges(spark):
    value = lambda y, p: metrics.score(_pred(spark, y, p), "r2").first()["score"]
    assert value([1.0, 1.0], [1.0, 1.0]) == 1.0 and value([1.0, 1.0], [1.0, 2.0]) == 0.0
    assert value([1.0, 2.0, 3.0], [1.0, 2.0, 4.0]) == pytest.approx(1 - 1 / 2)


def test_losses(spark):
    df = spark.createDataFrame([(1, 1.0), (0, 0.5)], "y int, p double")
    assert df.agg(metrics.log_loss(F.col("y"), F.col("p"))).first()[0] == pytest.approx(math.log(2) / 2)
    sure = spark.createDataFrame([(1, 0.0)], "y int, p double").agg(metrics.log_loss(F.col("y"), F.col("p"))).first()[0]
    assert sure == pytest.approx(-math.log(metrics.EPSILON))
    assert df.limit(0).agg(metrics.perplexity(F.col("p"))).first()[0] == 1.0


def test_cross_validation_uses_population_deviation(spark):
    df = spark.createDataFrame([(0, 1, 1), (0, 1, 0), (1, 1, 1), (1, 0, 0)], "fold int, y_true int, y_pred int")
    assert rows(metrics.cross_validate(df, "accuracy")) == [(0.75, 0.25)]


def test_undefined_binary_scores_are_zero(spark):
    out = metrics.binary_scores(metrics.confusion_counts(_pred(spark, [0, 0], [0, 0], "int"))).first()
    assert (out["accuracy"], out["precision"], out["recall"], out["f1"]) == (1.0, 0.0, 0.0, 0.0)
