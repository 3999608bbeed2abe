import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from runsight.operators import models, registry
from runsight.sources import snapshots


@pytest.fixture(scope="module")
def table(spark):
    """y follows from x and s; x has gaps."""
    return spark.range(300).select(
        "id",
        F.when(F.col("id") % 17 != 0, F.sin(F.col("id") * 1.7) * 10).alias("x"),
        F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("id") % 3 + 1).cast("int")).alias("s"),
        F.timestamp_seconds("id").alias("ignored"),
        (F.sin(F.col("id") * 1.7) * 20 + F.when(F.col("id") % 3 == 0, 100).otherwise(0)).alias("y"),
    ).cache()


def test_preprocessor_fits_on_training_rows_and_zeroes_unseen(spark, table):
    fitted = models.build_preprocessor(table, ["id", "y"]).fit(table.where("s <> 'c'"))
    row = fitted.transform(table.where("s = 'c' AND x IS NOT NULL")).select("features").first()["features"].toArray()
    assert len(row) == 3 and row[1:].tolist() == [0.0, 0.0]


def test_ridge_learns_and_survives_export(spark, table, tmp_path):
    train, test = models.train_test(table, "id", "y")
    model, predictions = models.retrain_and_predict(train, test, "id", models.linear("regression", 0.01))
    assert predictions.count() == 60
    assert predictions.agg(F.corr("y_true", "y_pred")).first()[0] > 0.95
    snapshots.export_best(model, spark.range(1), str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m" / "model")).transform(test).select(F.col("id").alias("row_id"), "prediction")
    both = again.join(predictions, "row_id").where(F.abs(F.col("prediction") - F.col("y_pred")) > 1e-9)
    assert both.count() == 0


def test_search_follows_the_metric_direction(spark, table):
    train, _ = models.train_test(table, "id", "y")
    candidates = [("linear", {"penalty": p}, models.linear("regression", p)) for p in (0.01, 1e6)]
    scores, best = models.search(train, "id", "regression", "rmse", candidates, k=2)
    assert best[1] == {"penalty": 0.01} and scores.count() == 2
    _, best = models.search(train, "id", "regression", "r2", candidates, k=2)
    assert best[1] == {"penalty": 0.01}


def test_search_states_prunes_and_scores_like_cross_validation(spark, table):
    train, _ = models.train_test(table, "id", "y")
    families = [("linear", {"penalty": p}, models.linear("regression", p)) for p in (0.01, 10.0, 1e5, 1e6)] + [("random_forest", {"trees": 3}, models.random_forest("regression", 3, 3))]
    plain, best = models.search(train, "id", "regression", "rmse", families, k=3)
    folded = models.with_folds(train, "id", "regression", 3)
    scores = {r["trial"]: r["score"] for r in plain.collect()}
    for i, (_, _, estimator) in enumerate(families):
        close = 1e-9 if i < 4 else 0.2  # forests draw by partition
        assert scores[i] == pytest.approx(models.cross_validated(folded, estimator, "rmse", ["id"], 3), rel=close)
    assert [r["state"] for r in plain.collect()] == ["complete"] * 5 and best[1] == families[min(scores, key=scores.get)][1]
    pruned, again = models.search(train, "id", "regression", "rmse", families, k=3, prune_after=1, parallel=2)
    states = {r["trial"]: (r["state"], r["folds"]) for r in pruned.collect()}
    assert again[1] == best[1] and states[3] == ("pruned", 1) and sum(s[0] == "complete" for s in states.values()) >= 2
    late, first = models.search(train, "id", "regression", "rmse", families, k=3, timeout_minutes=0)
    assert [r["state"] for r in late.orderBy("trial").collect()] == ["complete"] + ["skipped"] * 4 and first[1] == {"penalty": 0.01}


def test_search_goes_on_without_candidates_that_fail(spark, table):
    train, _ = models.train_test(table, "id", "y")
    bad = ("linear", {"iterations": -1}, models.boosted_trees("classification", classes=2, rounds=1))  # labels are not 0 and 1
    scores, best = models.search(train, "id", "regression", "rmse", [bad, ("linear", {"penalty": 1.0}, models.linear("regression"))], k=2)
    assert {r["trial"]: (r["state"], r["score"] is None) for r in scores.collect()} == {0: ("failed", True), 1: ("complete", False)} and best[1] == {"penalty": 1.0}
    with pytest.raises(ValueError):
        models.search(train, "id", "regression", "rmse", [bad], k=2)


def test_ridge_solves_its_equations(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 2))
    y = 100 * x[:, 0] - 7 * x[:, 1] + rng.normal(size=60) * 50 + 1000
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    df = spark.createDataFrame([(i, float(a), float(b), float(v)) for i, ((a, b), v) in enumerate(zip(x, y))], "id long, a double, b double, label double")
    for alpha in (0.5, 30.0):
        _, out = models.retrain_and_predict(df, df, "id", models.linear("regression", alpha))
        w = np.linalg.solve(z.T @ z + alpha * np.eye(2), z.T @ (y - y.mean()))
        assert [r["y_pred"] for r in out.orderBy("row_id").collect()] == pytest.approx((z @ w + y.mean()).tolist(), rel=1e-9)


def test_trials_repeat_and_stay_in_the_space():
    draws = lambda task: [(f, p) for f, p, _ in models.trials(task)]
    pytest.importorskip("pyspark")
    first = draws("regression")
    assert first == draws("regression") and len(first) == 20 and {f for f, _ in first} == {"linear", "random_forest"}
    assert all(50 <= p["trees"] <= 300 and 3 <= p["depth"] <= 15 for f, p in first if f == "random_forest")
    assert all(1e-3 <= p["penalty"] <= 100 for f, p in first if f == "linear")


def test_drafts_record_families_that_fail(spark, table):
    train, _ = models.train_test(table.withColumn("y", (F.col("y") > 50).cast("int")), "id", "y")

    def broken():
        raise ValueError("no such solver")

    drafts = models.draft_phase(train, "id", "classification", "accuracy", {"linear": lambda: models.linear("classification"), "bad": broken}, k=2)
    found = {r["name"]: (r["status"], r["metric_value"]) for r in drafts.collect()}
    assert found["linear"][0] == "draft-keep" and found["linear"][1] > 0.9 and found["bad"] == ("draft-discard", None)


def test_linear_machine_of_many_classes(spark, table):
    many = table.withColumn("y", (F.col("id") % 3).cast("int")).drop("x")
    train, test = models.train_test(many, "id", "y")
    _, predictions = models.retrain_and_predict(train.coalesce(1), test, "id", models.linear_svm(classes=3, rows=240, iterations=3))
    assert predictions.where("y_true = y_pred").count() == 60


def test_domains(spark):
    domain = registry.register(registry.Domain("mine"))

    @domain.step
    def double(df):
        return df.withColumn("id", F.col("id") * 2)

    assert registry.get("mine").run(spark.range(3)).agg(F.sum("id")).first()[0] == 6
    assert {"tabular", "deeplearning", "finetuning", "mine"} <= set(registry.names())
    with pytest.raises(KeyError):
        registry.get("nothing")


def test_drafts_prepare_each_fold_once(spark, table, monkeypatch):
    train, _ = models.train_test(table.withColumn("y", (F.col("y") > 50).cast("int")), "id", "y")
    fit, fits = models.ImputeAndScale._fit, []
    monkeypatch.setattr(models.ImputeAndScale, "_fit", lambda self, rows: (fits.append(1), fit(self, rows))[1])
    families = {f"linear-{c}": lambda c=c: models.linear("classification", c) for c in (0.1, 1.0, 10.0)}
    drafts = {r["name"]: r["metric_value"] for r in models.draft_phase(train, "id", "classification", "accuracy", families, k=2).collect()}
    assert len(fits) == 2
    folded = models.with_folds(train, "id", "classification", 2)
    assert drafts["linear-1.0"] == pytest.approx(models.cross_validated(folded, models.linear("classification"), "accuracy", ["id"], 2))


def test_folds_of_one_trial_run_side_by_side(spark, table, monkeypatch):
    import threading

    train, _ = models.train_test(table, "id", "y")
    both, score = threading.Barrier(2, timeout=60), models.fold_score
    monkeypatch.setattr(models, "fold_score", lambda *a: (both.wait(), score(*a))[1])
    scores, _ = models.search(train, "id", "regression", "rmse", [("linear", {"penalty": 1.0}, models.linear("regression"))], k=2)
    assert [(r["state"], r["folds"]) for r in scores.collect()] == [("complete", 2)]


def test_drafts_raise_what_is_no_fault_of_a_family(spark, table, monkeypatch):
    from pyspark.errors import PySparkException

    train, _ = models.train_test(table.withColumn("y", (F.col("y") > 50).cast("int")), "id", "y")
    families = {"linear": lambda: models.linear("classification")}
    drafts = lambda df: [(r["status"], r["metric_value"]) for r in models.draft_phase(df, "id", "classification", "accuracy", families, k=2).collect()]
    assert drafts(train.where("id < 0")) == [("draft-discard", None)]
    with pytest.raises(PySparkException):  # a text column without any value cannot be encoded
        drafts(train.withColumn("s", F.lit(None).cast("string")))
    folds = models.fold_vectors

    def lost(*a):
        """Tables whose files are gone when a family reads them."""
        tables = folds(*a)
        path = spark._jvm.org.apache.hadoop.fs.Path(tables[0].inputFiles()[0]).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        return tables

    monkeypatch.setattr(models, "fold_vectors", lost)
    with pytest.raises(models.SOLVER_ERRORS, match="does not exist"):
        drafts(train)

    def broken(*_):
        raise PySparkException("no space left")

    monkeypatch.setattr(models, "fold_vectors", broken)
    with pytest.raises(PySparkException):
        drafts(train)
