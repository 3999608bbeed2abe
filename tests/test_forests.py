import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import functions as F

from runsight.operators import forests, models


@pytest.fixture(scope="module")
def table(spark):
    """A step and a wave with noise; x is skewed, z has few values."""
    rng = np.random.default_rng(5)
    x, z = rng.exponential(size=1500) ** 2, rng.integers(0, 7, 1500)
    y = np.sin(3 * x) * 4 + np.where(z > 3, 10, 0) + rng.normal(size=1500) + 50
    raw = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(x, z, y)], "x double, z double, label double")
    return VectorAssembler(inputCols=["x", "z"], outputCol="features").transform(raw).repartition(3).cache()


def rmse(df):
    return df.agg(F.sqrt(F.avg((F.col("label") - F.col("prediction")) ** 2))).first()[0]


def test_a_forest_scans_its_rows_as_often_at_any_depth(spark, table):
    context, jobs = spark.sparkContext, []
    table.count()  # cached from here on
    for depth in (2, 12):
        context.setJobGroup(f"forest-{depth}", "")
        models.random_forest("regression", 10, depth).fit(table)
        jobs.append(len(context.statusTracker().getJobIdsForGroup(f"forest-{depth}")))
    context.setJobGroup("", "")
    assert jobs[0] == jobs[1] <= 5


def test_forests_predict_as_well_as_those_of_spark(table):
    for depth in (1, 4, 12):
        own = models.random_forest("regression", 60, depth).fit(table).transform(table)
        theirs = RandomForestRegressor(labelCol="label", numTrees=60, maxDepth=depth, seed=42).fit(table).transform(table)
        assert rmse(own) == pytest.approx(rmse(theirs), rel=0.1)
        assert own.count() == 1500 and own.columns == theirs.columns
        again = models.random_forest("regression", 60, depth).fit(table).transform(table)
        assert again.select("prediction").collect() == own.select("prediction").collect()


@pytest.mark.parametrize("column", ["x", "z"])
def test_one_tree_over_all_rows_is_that_of_spark(table, column):
    """Same splits, same cuts, same leaves."""
    one = VectorAssembler(inputCols=[column], outputCol="one").transform(table).select("label", F.col("one").alias("features"))
    (splits,), middle, _ = forests._candidates(one)
    rows = one.select("label", forests.vector_to_array("features")[0].alias("v")).toPandas()
    cell, bins = np.searchsorted(splits, rows["v"]), len(splits) + 1
    tables = np.stack([np.bincount(cell, minlength=bins), np.bincount(cell, rows["label"] - middle, bins)])[None].astype(float)
    for depth in (0, 1, 3, 10):
        grown = forests.grow(tables, [bins], depth, np.random.default_rng(1))[0] + middle
        found = DecisionTreeRegressor(labelCol="label", maxDepth=depth).fit(one).transform(one).select("prediction").toPandas()
        assert grown[cell] == pytest.approx(found["prediction"].to_numpy(), rel=1e-9)


def test_many_cells_and_missing_labels(spark, table):
    rows = spark.range(200).select(*[(F.rand(i) * 9).alias(f"c{i}") for i in range(3)], F.col("id").cast("double").alias("label"))
    wide = VectorAssembler(inputCols=["c0", "c1", "c2"], outputCol="features").transform(rows)
    assert isinstance(models.random_forest("regression", 2, 2).fit(wide), RandomForestRegressionModel)
    for bad in (F.lit(None).cast("double"), F.lit(float("nan")), F.lit(float("inf"))):
        with pytest.raises(models.SOLVER_ERRORS):
            models.random_forest("regression", 2, 2).fit(table.withColumn("label", F.when(F.col("z") == 2, bad).otherwise(F.col("label"))))
    with pytest.raises(models.SOLVER_ERRORS):
        models.random_forest("regression", 2, 2).fit(table.where("z < 0"))
    constant = VectorAssembler(inputCols=["c"], outputCol="features").transform(spark.range(50).select(F.lit(1.0).alias("c"), (F.col("id") % 2 * 1.0).alias("label")))
    assert models.random_forest("regression", 200, 3).fit(constant).transform(constant).agg(F.max("prediction")).first()[0] == pytest.approx(0.5, abs=0.02)


def test_thinned_points_keep_their_ranks():
    rng = np.random.default_rng(2)
    values, weights = forests._merged(rng.exponential(size=300_000), np.ones(300_000))
    few, n = forests._thinned(values, weights)
    assert len(few) <= forests.POINTS and n.sum() == 300_000
    assert np.searchsorted(values, few, side="right").tolist() == np.cumsum(n).tolist()  # each point with the rows up to it
    splits = forests._splits(few, n, forests.BINS - 1)
    shares = np.diff(np.concatenate([[0], np.searchsorted(values, splits), [300_000]])) / 300_000
    assert len(splits) == 31 and shares == pytest.approx(np.full(32, 1 / 32), rel=0.05)


def test_a_forest_survives_export(table, tmp_path):
    model = Pipeline(stages=[models.random_forest("regression", 5, 4)]).fit(table)
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m")).transform(table)
    assert again.select("prediction").collect() == model.transform(table).select("prediction").collect()
