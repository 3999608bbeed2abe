"""Models: fitting, search, refit, drafts. SQL solves linear ones by their normal equations; rows and quality of the others are checked in tests."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.ml import Estimator
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runsight.operators import baselines, catalog, models, runlog
from runsight.queries import query, r, table
from runsight.queries.inputs import folds_sql

CLASS_METRIC, VALUE_METRIC = "accuracy", "rmse"


def _orders(spark: SparkSession, d: str) -> DataFrame:
    """Order price next to customer facts."""
    orders, customer = table(spark, d, "orders"), table(spark, d, "customer")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority", "c_acctbal", "c_mktsegment", F.month("o_orderdate").alias("month")
    )


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    """Embedding labels next to the 64 places of the vector."""
    return table(spark, d, "embeddings").select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)])


def _binary(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).withColumn("label", (F.col("label") < 5).cast("int"))


def _parts(spark: SparkSession, d: str) -> DataFrame:
    """Price of a part next to its size and its shelf, which goes round with the key."""
    shelf = (F.col("p_partkey") % 500).cast("double")
    return table(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("label"), F.col("p_size").cast("double").alias("p_size"), shelf.alias("shelf"))


def ridge_sql(fitted_on: str, penalties: str) -> str:
    """CTEs up to ``w`` (fit, m1, s1, m2, s2, my, w1, w2): the normal equations of two scaled features, solved by hand. ``fitted_on``: rows (fit, x1, x2, y);
    ``penalties``: a query that adds alpha to ``gr``."""
    return f"""mo AS (SELECT fit, count(*) AS n, avg(x1) AS m1, stddev_pop(x1) AS s1, avg(x2) AS m2, stddev_pop(x2) AS s2, avg(y) AS my FROM {fitted_on} GROUP BY fit),
gr AS (SELECT fit, any_value(n) AS n, any_value(m1) AS m1, any_value(s1) AS s1, any_value(m2) AS m2, any_value(s2) AS s2, any_value(my) AS my,
  sum((x1 - m1) / s1 * (x1 - m1) / s1) AS a, sum((x2 - m2) / s2 * (x2 - m2) / s2) AS c, sum((x1 - m1) / s1 * (x2 - m2) / s2) AS b, sum((x1 - m1) / s1 * (y - my)) AS u, sum((x2 - m2) / s2 * (y - my)) AS v
  FROM {fitted_on} JOIN mo USING (fit) GROUP BY fit),
al AS ({penalties}),
w AS (SELECT *, (u * (c + alpha) - b * v) / ((a + alpha) * (c + alpha) - b * b) AS w1, (v * (a + alpha) - b * u) / ((a + alpha) * (c + alpha) - b * b) AS w2 FROM al)"""


def _fit(df: DataFrame, key: str, target: str, build: Callable[[DataFrame], Estimator]) -> DataFrame:
    """``build`` gets the training rows."""
    train, test = models.train_test(df, key, target)
    _, predictions = models.retrain_and_predict(train, test, key, build(train))
    return predictions.select("row_id", "y_true", r("y_pred").alias("y_pred"))


@query()
def fit_linear_classifier(spark: SparkSession, d: str) -> DataFrame:
    return _fit(_vectors(spark, d), "vec_id", "label", lambda _: models.linear("classification"))


@query()
def fit_ridge(spark: SparkSession, d: str) -> DataFrame:
    return _fit(_orders(spark, d), "o_orderkey", "o_totalprice", lambda _: models.linear("regression"))


_SPLIT_PARTS = """rows AS (SELECT p_partkey, p_size::DOUBLE AS x1, (p_partkey % 500)::DOUBLE AS x2, p_retailprice AS y,
  row_number() OVER (ORDER BY md5(p_partkey || ':42')) <= ceil(count(*) OVER () * 0.2) AS is_test FROM part)"""


@query(f"""WITH {_SPLIT_PARTS}, fitted AS (SELECT 0 AS fit, x1, x2, y FROM rows WHERE NOT is_test), {ridge_sql("fitted", "SELECT *, 1.0 AS alpha FROM gr")}
SELECT p_partkey AS row_id, y AS y_true, round(my + w1 * (x1 - m1) / s1 + w2 * (x2 - m2) / s2, 6) AS y_pred FROM rows, w WHERE is_test""")
def fit_ridge_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Two scaled numbers: the predictions of the normal equations."""
    return _fit(_parts(spark, d), "p_partkey", "label", lambda _: models.linear("regression"))


@query(f"""WITH {_SPLIT_PARTS}, train AS (SELECT x1, x2, y FROM rows WHERE NOT is_test),
vs AS (SELECT 'x1' AS f, x1 AS v FROM train UNION SELECT 'x2', x2 FROM train),
cuts AS (SELECT f, (v + lead(v) OVER (PARTITION BY f ORDER BY v)) / 2 AS cut FROM vs),
sides AS (SELECT f, cut, count(*) AS n, avg(y) FILTER (CASE f WHEN 'x1' THEN x1 ELSE x2 END <= cut) AS lo, avg(y) FILTER (CASE f WHEN 'x1' THEN x1 ELSE x2 END > cut) AS hi,
  count(*) FILTER (CASE f WHEN 'x1' THEN x1 ELSE x2 END <= cut) AS nl FROM cuts, train GROUP BY f, cut),
best AS (SELECT * FROM sides WHERE hi IS NOT NULL ORDER BY nl * (n - nl) / n::DOUBLE * (lo - hi) * (lo - hi) DESC LIMIT 1)
SELECT p_partkey AS row_id, y AS y_true, round(CASE WHEN CASE f WHEN 'x1' THEN x1 ELSE x2 END <= cut THEN lo ELSE hi END, 6) AS y_pred FROM rows, best WHERE is_test""")
def fit_one_split(spark: SparkSession, d: str) -> DataFrame:
    """A tree of one split, over as many bins as values: the best cut of all."""
    tree = DecisionTreeRegressor(labelCol="label", maxDepth=1, maxBins=512)
    return _fit(_parts(spark, d), "p_partkey", "label", lambda _: tree)


@query()
def fit_random_forest(spark: SparkSession, d: str) -> DataFrame:
    return _fit(_vectors(spark, d), "vec_id", "label", lambda _: models.random_forest("classification", 20, 5))


@query()
def fit_random_forest_regressor(spark: SparkSession, d: str) -> DataFrame:
    return _fit(_orders(spark, d), "o_orderkey", "o_totalprice", lambda _: models.random_forest("regression", 20, 5))


@query()
def fit_boosted_trees(spark: SparkSession, d: str) -> DataFrame:
    return _fit(_orders(spark, d), "o_orderkey", "o_totalprice", lambda _: models.boosted_trees("regression", rounds=5))


@query()
def fit_boosted_classifier(spark: SparkSession, d: str) -> DataFrame:
    return _fit(_binary(spark, d), "vec_id", "label", lambda _: models.boosted_trees("classification", rounds=5))


@query()
def fit_linear_svm(spark: SparkSession, d: str) -> DataFrame:
    return _fit(_binary(spark, d), "vec_id", "label", lambda train: models.linear_svm(rows=train.count()))


_TRIALS = ", ".join(f"({i}, '{family}', '{json.dumps(params, sort_keys=True)}', {params.get('penalty', 'NULL')})" for i, (family, params) in enumerate(models.draw_trials("regression")))


@query(f"""WITH rows AS (SELECT p_partkey, p_size::DOUBLE AS x1, (p_partkey % 500)::DOUBLE AS x2, p_retailprice AS y FROM part),
{folds_sql("part", "p_partkey")},
placed AS (SELECT rows.*, fold FROM rows JOIN folds USING (p_partkey)),
fitted AS (SELECT f AS fit, x1, x2, y FROM placed, range(5) t(f) WHERE fold <> f),
trials(trial, family, params, penalty) AS (VALUES {_TRIALS}),
{ridge_sql("fitted", "SELECT gr.*, trial, penalty AS alpha FROM gr, trials WHERE family = 'linear'")},
rmse AS (SELECT trial, fold, sqrt(avg((y - my - w1 * (x1 - m1) / s1 - w2 * (x2 - m2) / s2) ** 2)) AS e FROM placed JOIN w ON fit = fold GROUP BY ALL),
scores AS (SELECT trial, avg(e) AS score FROM rmse GROUP BY trial),
dummy AS (SELECT avg(e) AS score FROM (SELECT fold, sqrt(avg((y - my) ** 2)) AS e FROM placed JOIN mo ON fit = fold GROUP BY fold))
SELECT trial, family, params, 5 AS folds, 'complete' AS state, round(s.score, 6) AS score, coalesce(s.score < d.score, TRUE) AS beats_mean FROM trials LEFT JOIN scores s USING (trial), dummy d""")
def search_models(spark: SparkSession, d: str) -> DataFrame:
    """All trials of both families; the scores of linear ones follow from the normal equations, those of forests are held against the mean alone."""
    train = _parts(spark, d)
    scores, _ = models.search(train, "p_partkey", "regression", VALUE_METRIC, models.trials("regression"))
    folded = models.with_folds(train, "p_partkey", "regression")
    mean = baselines.constant_scores(folded, "label", baselines.mean_constants(folded, "label"), VALUE_METRIC).agg(F.avg("score").alias("mean"))  # one row
    held = scores.join(F.broadcast(mean))
    linear = F.when(F.col("family") == "linear", r("score")).alias("score")
    return held.select("trial", "family", "params", "folds", "state", linear, (F.col("score") < F.col("mean")).alias("beats_mean"))


@query()
def draft_phase(spark: SparkSession, d: str) -> DataFrame:
    """One run per family on the vectors; the best draft."""
    train, _ = models.train_test(_binary(spark, d), "vec_id", "label")
    n = train.count()
    builders = {
        "linear": lambda: models.linear("classification"),
        "random_forest": lambda: models.random_forest("classification", 20, 5),
        "xgboost": lambda: models.boosted_trees("classification", rounds=5),
        "lightgbm": lambda: models.boosted_trees("classification", rounds=5, depth=3),
        "svm": lambda: models.linear_svm(rows=n),
    }
    families = {name: builders[name] for name in catalog.FAMILIES["tabular"]}
    drafts = models.draft_phase(train, "vec_id", "classification", CLASS_METRIC, families, k=3)
    return runlog.best_draft(drafts, catalog.direction_of(CLASS_METRIC)).select("name", r("metric_value").alias("metric_value"), "status", "commit_hash")
