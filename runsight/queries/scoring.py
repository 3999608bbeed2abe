"""Metrics, diagnostics, folds, baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runsight.operators import baselines, catalog, diagnostics, metrics, prep
from runsight.operators.registry import get, score_batches
from runsight.plans.quantile import exact_medians
from runsight.queries import query, r, table
from runsight.queries.inputs import (
    PRICE_PREDICTIONS,
    PURCHASE_SCORES,
    RESULT_LOG,
    STATUS_PREDICTIONS,
    folds_sql,
    order_features,
    price_predictions,
    purchase_scores,
    result_log,
    status_predictions,
    strata_sql,
    value_baselines,
)

# --- diagnostics -------------------------------------------------------------------------------------


@query(f"WITH {PRICE_PREDICTIONS} SELECT row_id, round(y_pred - y_true, 2) AS error, round(abs(y_pred - y_true), 2) AS abs_error FROM pred")
def prediction_error(spark: SparkSession, d: str) -> DataFrame:
    out = diagnostics.prediction_error(price_predictions(spark, d))
    return out.select("row_id", r("error", 2).alias("error"), r("abs_error", 2).alias("abs_error"))


@query(f"""WITH {PRICE_PREDICTIONS} SELECT row_id, y_true, y_pred, round(abs(y_pred - y_true), 2) AS abs_error FROM pred
  ORDER BY abs(y_pred - y_true) DESC, row_id DESC LIMIT 5""")
def worst_predictions(spark: SparkSession, d: str) -> DataFrame:
    return diagnostics.worst_predictions(price_predictions(spark, d)).withColumn("abs_error", r("abs_error", 2))


@query(f"""WITH {PRICE_PREDICTIONS}, k AS (SELECT o_orderpriority, row_id, round(abs(y_pred - y_true), 2) AS abs_error,
  row_number() OVER (PARTITION BY o_orderpriority ORDER BY abs(y_pred - y_true) DESC, row_id DESC) AS rank FROM pred)
  SELECT * FROM k WHERE rank <= 5""")
def worst_predictions_by_priority(spark: SparkSession, d: str) -> DataFrame:
    out = diagnostics.worst_predictions(price_predictions(spark, d), by=["o_orderpriority"])
    return out.select("o_orderpriority", "row_id", r("abs_error", 2).alias("abs_error"), "rank")


@query(f"""WITH {PRICE_PREDICTIONS} SELECT CASE WHEN avg(y_pred - y_true) > 0 THEN 'over' WHEN avg(y_pred - y_true) < 0 THEN 'under' ELSE 'neutral' END
  AS direction, round(avg(y_pred - y_true), 4) AS magnitude FROM pred""")
def bias(spark: SparkSession, d: str) -> DataFrame:
    return diagnostics.bias(price_predictions(spark, d)).withColumn("magnitude", r("magnitude", 4))


_JOINED = f"""{PRICE_PREDICTIONS}, j AS (SELECT p.*, abs(y_pred - y_true) AS abs_error, c_acctbal, CAST(c_nationkey AS DOUBLE) AS c_nationkey
  FROM pred p JOIN orders ON o_orderkey = row_id JOIN customer ON c_custkey = o_custkey)"""
_FEATURES = ["c_acctbal", "c_nationkey", "constant"]


@query(f"WITH {_JOINED} SELECT row_id, y_true, y_pred, o_orderpriority, c_acctbal, c_nationkey, 1.0::DOUBLE AS constant FROM j")
def join_features(spark: SparkSession, d: str) -> DataFrame:
    return diagnostics.join_features(price_predictions(spark, d), order_features(spark, d))


@query(f"""WITH {_JOINED} SELECT 'c_acctbal' AS feature, round(corr(c_acctbal, abs_error), 6) AS correlation FROM j
  UNION ALL SELECT 'c_nationkey', round(corr(c_nationkey, abs_error), 6) FROM j""")
def feature_error_correlation(spark: SparkSession, d: str) -> DataFrame:
    joined = diagnostics.join_features(price_predictions(spark, d), order_features(spark, d))
    out = diagnostics.rank_correlations(diagnostics.feature_error_correlation(joined, _FEATURES))
    return out.select("feature", r("correlation").alias("correlation"))


@query(f"WITH {STATUS_PREDICTIONS} SELECT row_id, y_true, y_pred FROM pred WHERE y_true IS DISTINCT FROM y_pred")
def misclassified(spark: SparkSession, d: str) -> DataFrame:
    return diagnostics.misclassified(status_predictions(spark, d)).drop("proba")


@query(f"""WITH {STATUS_PREDICTIONS} SELECT row_id, y_true, y_pred, round(confidence, 6) AS confidence FROM pred WHERE y_true <> y_pred
  ORDER BY pred.confidence DESC, row_id DESC LIMIT 5""")
def confident_mistakes(spark: SparkSession, d: str) -> DataFrame:
    return diagnostics.misclassified_samples(status_predictions(spark, d)).withColumn("confidence", r("confidence"))


@query(f"WITH {STATUS_PREDICTIONS} SELECT row_id, y_true, y_pred FROM pred WHERE y_true <> y_pred ORDER BY row_id LIMIT 5")
def first_mistakes(spark: SparkSession, d: str) -> DataFrame:
    return diagnostics.misclassified_samples(status_predictions(spark, d).drop("proba"))


@query(f"WITH {STATUS_PREDICTIONS} SELECT y_true AS class, round(avg(CAST(y_true = y_pred AS INT)), 6) AS accuracy, count(*) AS n FROM pred GROUP BY 1")
def per_class_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return diagnostics.per_class_accuracy(status_predictions(spark, d)).withColumn("accuracy", r("accuracy"))


@query(f"""WITH {STATUS_PREDICTIONS} SELECT y_true, y_pred, count(*) AS n, min(row_id) AS first_row FROM pred WHERE y_true <> y_pred
  GROUP BY 1, 2 ORDER BY n DESC, first_row LIMIT 5""")
def confused_pairs(spark: SparkSession, d: str) -> DataFrame:
    return diagnostics.confused_pairs(status_predictions(spark, d))


@query(f"WITH {STATUS_PREDICTIONS} SELECT y_true, y_pred, count(*) AS n FROM pred GROUP BY 1, 2")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return diagnostics.confusion_matrix(status_predictions(spark, d))


@query(f"""WITH {STATUS_PREDICTIONS} SELECT y_true, count(*) FILTER (y_pred = 'F') AS "F", count(*) FILTER (y_pred = 'O') AS "O",
  count(*) FILTER (y_pred = 'P') AS "P" FROM pred GROUP BY 1""")
def confusion_matrix_wide(spark: SparkSession, d: str) -> DataFrame:
    return diagnostics.confusion_matrix(status_predictions(spark, d), ["F", "O", "P"])


@query("""SELECT e.vec_id AS row_id, n1.n_name AS y_true, n2.n_name AS y_pred FROM embeddings e
  LEFT JOIN nation n1 ON n1.n_nationkey = e.label LEFT JOIN nation n2 ON n2.n_nationkey = (e.label + e.vec_id) % 10""")
def apply_class_names(spark: SparkSession, d: str) -> DataFrame:
    pred = table(spark, d, "embeddings").select(
        F.col("vec_id").alias("row_id"), F.col("label").alias("y_true"), ((F.col("label") + F.col("vec_id")) % 10).cast("int").alias("y_pred")
    )
    names = table(spark, d, "nation").select(F.col("n_nationkey").alias("class_id"), F.col("n_name").alias("class_name"))
    return diagnostics.apply_class_names(pred, names)


@query(f"""WITH {_JOINED},
w AS (SELECT row_number() OVER (ORDER BY abs_error DESC, row_id DESC) AS rank, row_id, abs_error FROM j),
c AS (SELECT 'c_acctbal' AS f, corr(c_acctbal, abs_error) AS v FROM j UNION ALL SELECT 'c_nationkey', corr(c_nationkey, abs_error) FROM j)
SELECT 'worst_prediction' AS section, rank, CAST(row_id AS VARCHAR) AS key, printf('%.4f', abs_error) AS value FROM w WHERE rank <= 5
UNION ALL SELECT 'bias', 1, CASE WHEN avg(y_pred - y_true) > 0 THEN 'over' ELSE 'under' END, printf('%.4f', avg(y_pred - y_true)) FROM j
UNION ALL SELECT 'feature_correlation', row_number() OVER (ORDER BY abs(v) DESC, f), f, printf('%.4f', v) FROM c""")
def regression_report(spark: SparkSession, d: str) -> DataFrame:
    joined = diagnostics.join_features(price_predictions(spark, d), order_features(spark, d))
    return diagnostics.diagnostics_report(joined, catalog.is_classification("regression"), _FEATURES)


@query(f"""WITH {STATUS_PREDICTIONS},
m AS (SELECT row_number() OVER (ORDER BY confidence DESC, row_id DESC) AS rank, * FROM pred WHERE y_true <> y_pred),
p AS (SELECT y_true, y_pred, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, min(row_id)) AS rank FROM pred WHERE y_true <> y_pred GROUP BY 1, 2)
SELECT 'misclassified' AS section, rank, CAST(row_id AS VARCHAR) AS key, y_true || ' -> ' || y_pred AS value FROM m WHERE rank <= 5
UNION ALL SELECT 'class_accuracy', 0, y_true, printf('%.4f', avg(CAST(y_true = y_pred AS INT))) FROM pred GROUP BY y_true
UNION ALL SELECT 'confused_pair', rank, y_true || ' -> ' || y_pred, CAST(n AS VARCHAR) FROM p WHERE rank <= 5""")
def classification_report(spark: SparkSession, d: str) -> DataFrame:
    return diagnostics.diagnostics_report(status_predictions(spark, d), catalog.is_classification("classification"))


# --- metrics -----------------------------------------------------------------------------------------


def _quality(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").select(F.col("quality").alias("y_true"), F.col("toxic").alias("y_pred"))


@query("""WITH c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality = 0 AND toxic = 1) AS fp,
  count(*) FILTER (quality = 1 AND toxic = 0) AS fn, count(*) FILTER (quality = toxic) AS hit, count(*) AS n FROM labels)
SELECT round(hit / n, 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
  round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c""")
def binary_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics.binary_scores(metrics.confusion_counts(_quality(spark, d))).select(*[r(c).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


_CLASS_SCORES = f"""{STATUS_PREDICTIONS}, t AS (SELECT y_true AS class, count(*) AS support, count(*) FILTER (y_true = y_pred) AS hits FROM pred GROUP BY 1),
g AS (SELECT y_pred AS class, count(*) AS predicted FROM pred GROUP BY 1),
s AS (SELECT class, coalesce(support, 0) AS support, coalesce(hits / nullif(predicted, 0), 0) AS precision, coalesce(hits / nullif(support, 0), 0) AS recall,
  coalesce(2 * hits / (coalesce(support, 0) + coalesce(predicted, 0)), 0) AS f1 FROM t FULL JOIN g USING (class))"""


@query(f"WITH {_CLASS_SCORES} SELECT class, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM s")
def class_scores(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.class_scores(metrics.confusion_counts(status_predictions(spark, d)))
    return out.select("class", "support", *[r(c).alias(c) for c in ("precision", "recall", "f1")])


@query(f"WITH {_CLASS_SCORES} SELECT round(sum(support * f1) / sum(support), 6) AS score FROM s")
def f1_weighted(spark: SparkSession, d: str) -> DataFrame:
    return metrics.score(status_predictions(spark, d), "f1_weighted").select(r("score").alias("score"))


_AUC = """ranked AS (SELECT {by} y_true, rank() OVER ({part} ORDER BY score) + (count(*) OVER (PARTITION BY {by} score) - 1) / 2.0 AS rk FROM pred),
a AS (SELECT {by} sum(CASE WHEN y_true = 1 THEN rk END) AS s, sum(y_true) AS p, count(*) - sum(y_true) AS n FROM ranked {group})"""


@query(f"WITH {PURCHASE_SCORES}, {_AUC.format(by='', part='', group='')} SELECT round((s - p * (p + 1) / 2) / (CAST(p AS DOUBLE) * n), 6) AS auc FROM a")
def auc(spark: SparkSession, d: str) -> DataFrame:
    return metrics.auc(purchase_scores(spark, d)).select(r("auc").alias("auc"))


@query(f"""WITH {PURCHASE_SCORES}, {_AUC.format(by='user_id,', part='PARTITION BY user_id', group='GROUP BY user_id')}
SELECT user_id, round((s - p * (p + 1) / 2) / nullif(CAST(p AS DOUBLE) * n, 0), 6) AS auc FROM a""")
def auc_by_user(spark: SparkSession, d: str) -> DataFrame:
    return metrics.auc(purchase_scores(spark, d), ["user_id"]).select("user_id", r("auc").alias("auc"))


@query(f"WITH {PURCHASE_SCORES} SELECT round(-avg(ln(CASE WHEN y_true = 1 THEN probability ELSE 1 - probability END)), 6) AS log_loss FROM pred")
def log_loss(spark: SparkSession, d: str) -> DataFrame:
    out = purchase_scores(spark, d).agg(metrics.log_loss(F.col("y_true"), F.col("probability")).alias("log_loss"))
    return out.select(r("log_loss").alias("log_loss"))


@query(f"""WITH {PRICE_PREDICTIONS} SELECT round(avg((y_true - y_pred) ** 2) / 1e6, 4) AS mse_millions, round(sqrt(avg((y_true - y_pred) ** 2)), 4) AS rmse,
  round(avg(abs(y_true - y_pred)), 4) AS mae, round(1 - avg((y_true - y_pred) ** 2) / var_pop(y_true), 6) AS r2,
  round(avg(abs(y_true - y_pred) / abs(y_true)), 4) AS mape FROM pred""")
def regression_metrics(spark: SparkSession, d: str) -> DataFrame:
    y, p = F.col("y_true"), F.col("y_pred")
    return price_predictions(spark, d).agg(
        r(metrics.mse(y, p) / 1e6, 4).alias("mse_millions"),
        r(metrics.rmse(y, p), 4).alias("rmse"),
        r(metrics.mae(y, p), 4).alias("mae"),
        r(metrics.r2(y, p)).alias("r2"),
        r(metrics.mape(y, p), 4).alias("mape"),
    )


@query("SELECT event_type, round(avg(value / 100), 6) AS loss, round(exp(avg(value / 100)), 6) AS perplexity FROM events GROUP BY 1")
def loss_and_perplexity(spark: SparkSession, d: str) -> DataFrame:
    loss = F.col("value") / 100
    return table(spark, d, "events").groupBy("event_type").agg(
        r(metrics.mean_loss(loss)).alias("loss"), r(metrics.perplexity(loss)).alias("perplexity")
    )


@query(f"WITH {PRICE_PREDICTIONS} SELECT round(avg(CAST(abs(y_true - y_pred) < 100000 AS INT)), 6) AS score FROM pred")
def custom_metric(spark: SparkSession, d: str) -> DataFrame:
    domain = get("tabular")
    domain.metric("close_share", "maximize", lambda y, p: F.avg((F.abs(y - p) < 100_000).cast("int")))
    share = domain.custom_metrics["close_share"](F.col("y_true"), F.col("y_pred"))
    return price_predictions(spark, d).agg(r(share).alias("score"))


@query("SELECT o_orderkey, round(o_totalprice * 0.5 + 10, 3) AS y_pred FROM orders")
def score_with_model(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    out = score_batches(orders, lambda: lambda batch: batch["o_totalprice"] * 0.5 + 10, "o_orderkey long, o_totalprice double, y_pred double")
    return out.select("o_orderkey", r("y_pred", 3).alias("y_pred"))


# --- splits and folds ----------------------------------------------------------------------------------

_RANKED = "rk AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5(CAST(o_orderkey AS VARCHAR) || ':42')) AS rn, count(*) OVER () AS n FROM orders)"


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")


@query(f"WITH {_RANKED} SELECT o_orderkey, rn <= ceil(n * 0.2) AS is_test FROM rk")
def split_train_test(spark: SparkSession, d: str) -> DataFrame:
    return prep.split_train_test(_orders(spark, d), "o_orderkey").select("o_orderkey", "is_test")


@query(f"WITH {_RANKED} SELECT o_orderkey, rn <= floor(n * 0.1) AS is_eval FROM rk")
def split_train_eval(spark: SparkSession, d: str) -> DataFrame:
    return prep.split_train_eval(_orders(spark, d), "o_orderkey").select("o_orderkey", "is_eval")


@query("""SELECT vec_id, row_number() OVER (ORDER BY md5(CAST(vec_id AS VARCHAR) || ':42')) <= floor(count(*) OVER () * 0.2) AS is_val FROM embeddings""")
def random_split_val(spark: SparkSession, d: str) -> DataFrame:
    return prep.random_split_val(table(spark, d, "embeddings").select("vec_id"), "vec_id")


@query("""SELECT CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'listed' ELSE 'other' END AS part, count(*) AS n FROM documents GROUP BY 1
  UNION ALL SELECT 'common', 0""")
def partition_by_membership(spark: SparkSession, d: str) -> DataFrame:
    inside, outside = prep.partition_by_membership(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")
    tag = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
    common = prep.common_keys(inside, outside, "doc_id")
    return tag(inside, "listed").unionByName(tag(outside, "other")).unionByName(tag(common, "common"))


@query(f"WITH {folds_sql('orders', 'o_orderkey')} SELECT o_orderkey, fold FROM folds")
def kfold(spark: SparkSession, d: str) -> DataFrame:
    return prep.kfold(_orders(spark, d), "o_orderkey").select("o_orderkey", "fold")


@query(f"WITH {strata_sql('orders', 'o_orderkey', 'o_orderstatus')} SELECT o_orderkey, o_orderstatus, fold FROM folds")
def stratified_kfold(spark: SparkSession, d: str) -> DataFrame:
    return prep.stratified_kfold(_orders(spark, d), "o_orderkey", "o_orderstatus").select("o_orderkey", "o_orderstatus", "fold")


@query(f"WITH {strata_sql('embeddings', 'vec_id', 'label')} SELECT vec_id, label, fold FROM folds")
def stratified_kfold_classes(spark: SparkSession, d: str) -> DataFrame:
    return prep.stratified_kfold(table(spark, d, "embeddings").select("vec_id", "label"), "vec_id", "label").select("vec_id", "label", "fold")


@query("""WITH t AS (SELECT o_orderdate AS cut, sum(count(*)) OVER (ORDER BY o_orderdate DESC) AS later FROM orders GROUP BY 1)
SELECT o_orderkey, o_orderdate >= (SELECT max(cut) FROM t WHERE later >= ceil((SELECT count(*) FROM orders) * 0.2)) AS is_test FROM orders""")
def temporal_split(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return prep.temporal_split(orders, "o_orderdate").select("o_orderkey", "is_test")


@query(f"""WITH {PRICE_PREDICTIONS}, {folds_sql('orders', 'o_orderkey')},
s AS (SELECT fold, sqrt(avg((y_true - y_pred) ** 2)) AS score FROM pred JOIN folds ON o_orderkey = row_id GROUP BY 1)
SELECT round(avg(score), 4) AS score, round(stddev_pop(score), 4) AS std FROM s""")
def cross_validate_rmse(spark: SparkSession, d: str) -> DataFrame:
    folded = prep.kfold(price_predictions(spark, d), "row_id")
    return metrics.cross_validate(folded, "rmse").select(r("score", 4).alias("score"), r("std", 4).alias("std"))


@query(f"""WITH {STATUS_PREDICTIONS}, {folds_sql('orders', 'o_orderkey')},
s AS (SELECT fold, avg(CAST(y_true = y_pred AS INT)) AS score FROM pred JOIN folds ON o_orderkey = row_id GROUP BY 1)
SELECT round(avg(score), 6) AS score, round(stddev_pop(score), 6) AS std FROM s""")
def cross_validate_accuracy(spark: SparkSession, d: str) -> DataFrame:
    folded = prep.kfold(status_predictions(spark, d), "row_id")
    return metrics.cross_validate(folded, "accuracy").select(r("score").alias("score"), r("std").alias("std"))


# --- baselines -------------------------------------------------------------------------------------------


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select("name", r("score", digits).alias("score"), r("std", digits).alias("std"))


def _draw(key: str, seed: int = 42) -> str:
    return f"CAST('0x' || substr(md5(CAST({key} AS VARCHAR) || ':{seed}:draw'), 1, 8) AS BIGINT) / 4294967296.0"


_CLASS_COUNTS = """fc AS (SELECT f.fold, c.label, count(*) FILTER (s.fold = f.fold) AS in_fold, count(*) FILTER (s.fold <> f.fold) AS in_train
  FROM (SELECT DISTINCT fold FROM folds) f, (SELECT DISTINCT {label} AS label FROM folds) c, folds s WHERE s.{label} = c.label GROUP BY 1, 2),
mode AS (SELECT fold, arg_max(label, ROW(in_train, -r)) AS m FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY label) AS r FROM fc) GROUP BY 1)"""
_ORDER_STRATA = f"{strata_sql('orders', 'o_orderkey', 'o_orderstatus')}, {_CLASS_COUNTS.format(label='o_orderstatus')}"
_DRAWN = """cum AS (SELECT fold, label, sum(in_train) OVER (PARTITION BY fold ORDER BY label) / sum(in_train) OVER (PARTITION BY fold) AS hi,
  (sum(in_train) OVER (PARTITION BY fold ORDER BY label) - in_train) / sum(in_train) OVER (PARTITION BY fold) AS lo FROM fc),
drawn AS (SELECT s.fold, s.{label} AS y_true, c.label AS y_pred FROM (SELECT *, {draw} AS u FROM folds) s JOIN cum c ON c.fold = s.fold AND u >= lo AND u < hi)"""


@query(f"""WITH {_ORDER_STRATA}, {_DRAWN.format(label='o_orderstatus', draw=_draw('o_orderkey'))},
a AS (SELECT fold, avg(CAST(o_orderstatus = m AS INT)) AS s FROM folds JOIN mode USING (fold) GROUP BY 1),
b AS (SELECT fold, avg(CAST(y_true = y_pred AS INT)) AS s FROM drawn GROUP BY 1)
SELECT 'most_frequent' AS name, round(avg(s), 6) AS score, round(stddev_pop(s), 6) AS std FROM a
UNION ALL SELECT 'stratified', round(avg(s), 6), round(stddev_pop(s), 6) FROM b""")
def baselines_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(baselines.compute_baselines(_orders(spark, d), "o_orderkey", "o_orderstatus", "classification", "accuracy"))


@query(f"""WITH {_ORDER_STRATA}, p AS (SELECT fold, o_orderstatus = m AS hit FROM folds JOIN mode USING (fold)),
a AS (SELECT fold, count(*) FILTER (hit) / count(*) AS share FROM p GROUP BY 1)
SELECT 'most_frequent' AS name, round(avg(share * 2 * share / (1 + share)), 6) AS score, round(stddev_pop(share * 2 * share / (1 + share)), 6) AS std FROM a""")
def baseline_most_frequent_f1(spark: SparkSession, d: str) -> DataFrame:
    folded = prep.stratified_kfold(_orders(spark, d), "o_orderkey", "o_orderstatus")
    scores = metrics.over_folds(baselines.most_frequent_scores(baselines.fold_class_counts(folded, "o_orderstatus"), "f1_weighted"))
    return _rounded(scores.withColumn("name", F.lit("most_frequent")))


_EXPECTED = "t AS (SELECT fold, {guess} * in_fold / sum(in_fold) OVER (PARTITION BY fold) AS s FROM fc) SELECT fold, round(sum(s), 6) AS score FROM t GROUP BY 1"


@query(f"WITH {_ORDER_STRATA}, {_EXPECTED.format(guess='in_train / sum(in_train) OVER (PARTITION BY fold)')}")
def baseline_stratified_expected(spark: SparkSession, d: str) -> DataFrame:
    folded = prep.stratified_kfold(_orders(spark, d), "o_orderkey", "o_orderstatus")
    return baselines.expected_accuracy(baselines.fold_class_counts(folded, "o_orderstatus")).withColumn("score", r("score"))


@query(f"WITH {_ORDER_STRATA}, {_EXPECTED.format(guess='1.0 / count(*) OVER (PARTITION BY fold)')}")
def baseline_uniform_expected(spark: SparkSession, d: str) -> DataFrame:
    folded = prep.stratified_kfold(_orders(spark, d), "o_orderkey", "o_orderstatus")
    return baselines.expected_accuracy(baselines.fold_class_counts(folded, "o_orderstatus"), "uniform").withColumn("score", r("score"))


@query(f"""WITH {strata_sql('embeddings', 'vec_id', 'label')}, {_CLASS_COUNTS.format(label='label')},
ids AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS i, count(*) OVER () AS k FROM (SELECT DISTINCT label FROM embeddings)),
drawn AS (SELECT s.fold, s.label AS y_true, i.label AS y_pred FROM (SELECT *, {_draw('vec_id')} AS u FROM folds) s JOIN ids i ON floor(u * k) = i),
a AS (SELECT fold, avg(CAST(label = m AS INT)) AS s FROM folds JOIN mode USING (fold) GROUP BY 1),
b AS (SELECT fold, avg(CAST(y_true = y_pred AS INT)) AS s FROM drawn GROUP BY 1)
SELECT 'most_frequent' AS name, round(avg(s), 6) AS score, round(stddev_pop(s), 6) AS std FROM a
UNION ALL SELECT 'random', round(avg(s), 6), round(stddev_pop(s), 6) FROM b""")
def baselines_image(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings").select("vec_id", "label")
    return _rounded(baselines.compute_baselines(vectors, "vec_id", "label", "image_classification", "accuracy"))


_OTHERS = "c AS (SELECT f.fold, {f}(o.o_totalprice) AS p FROM (SELECT DISTINCT fold FROM folds) f JOIN folds g ON g.fold <> f.fold JOIN orders o ON o.o_orderkey = g.o_orderkey GROUP BY 1)"


def _constant_sql(name: str, aggregate: str, score: str) -> str:
    return f"""WITH {folds_sql('orders', 'o_orderkey')}, {_OTHERS.format(f=aggregate)},
s AS (SELECT fold, {score} AS s FROM folds JOIN c USING (fold) JOIN orders USING (o_orderkey) GROUP BY fold)
SELECT '{name}' AS name, round(avg(s), 3) AS score, round(stddev_pop(s), 3) AS std FROM s"""


_RMSE, _MAE = "sqrt(avg((o_totalprice - p) ** 2))", "avg(abs(o_totalprice - p))"


@query(f"SELECT * FROM ({_constant_sql('mean', 'avg', _RMSE)}) UNION ALL SELECT * FROM ({_constant_sql('median', 'median', _RMSE)})")
def baselines_rmse(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(baselines.compute_baselines(_orders(spark, d), "o_orderkey", "o_totalprice", "regression", "rmse"), 3)


@query(_constant_sql("median", "median", _MAE))
def baseline_median_mae(spark: SparkSession, d: str) -> DataFrame:
    folded = prep.kfold(_orders(spark, d), "o_orderkey")
    scores = baselines.constant_scores(folded, "o_totalprice", baselines.median_constants(folded, "o_totalprice"), "mae")
    return _rounded(metrics.over_folds(scores).withColumn("name", F.lit("median")), 3)


@query("""WITH k AS (SELECT ln(count(DISTINCT label)) AS g FROM embeddings)
SELECT 'random_guess' AS name, round(g, 6) AS score, 0.0::DOUBLE AS std FROM k UNION ALL SELECT 'uniform_prediction', round(0.95 * g, 6), 0.0 FROM k""")
def baseline_loss_classes(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(baselines.compute_baselines(table(spark, d, "embeddings"), "vec_id", "label", "image_classification", "loss"))


@query(f"""WITH {RESULT_LOG}, b AS (SELECT max(avg) AS bar FROM (SELECT avg(value) / 2 AS avg FROM events WHERE event_type IN ('view', 'click') GROUP BY event_type))
SELECT run_id, experiment_id, coalesce(metric_value > bar, FALSE) AS passes_gate FROM log, b""")
def baseline_gate(spark: SparkSession, d: str) -> DataFrame:
    out = baselines.baseline_gate(result_log(spark, d), value_baselines(spark, d))
    return out.select("run_id", "experiment_id", "passes_gate")


@query("""SELECT event_type AS name, round(avg(value) / 2, 6) AS score, 25.0 > avg(value) / 2 AS beaten FROM events WHERE event_type IN ('view', 'click') GROUP BY 1""")
def beats_baselines(spark: SparkSession, d: str) -> DataFrame:
    return baselines.beats_baselines(value_baselines(spark, d), 25.0).withColumn("score", r("score"))


@query("SELECT bool_and(25.0 > s) AS beats_all FROM (SELECT avg(value) / 2 AS s FROM events WHERE event_type IN ('view', 'click') GROUP BY event_type)")
def beats_all(spark: SparkSession, d: str) -> DataFrame:
    return baselines.beats_all(baselines.beats_baselines(value_baselines(spark, d), 25.0))


@query("""WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN o_orderdate END AS day FROM orders),
c AS (SELECT max(day) AS cut FROM (SELECT day, (SELECT count(*) FROM o AS l WHERE l.day >= x.day) AS later FROM (SELECT DISTINCT day FROM o WHERE day IS NOT NULL) AS x)
  WHERE later >= ceil((SELECT count(day) FROM o) * 0.2))
SELECT o_orderkey, coalesce(day >= cut, FALSE) AS is_test FROM o, c""")
def temporal_split_without_dates(spark: SparkSession, d: str) -> DataFrame:
    day = F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderdate")).alias("day")
    return prep.temporal_split(table(spark, d, "orders").select("o_orderkey", day), "day").select("o_orderkey", "is_test")


@query("SELECT median(l_extendedprice) AS price, median(CASE WHEN l_returnflag = 'R' THEN l_discount END) AS discount, median(l_quantity) AS quantity FROM lineitem")
def narrow_medians(spark: SparkSession, d: str) -> DataFrame:
    """Medians with heavy ties and with many distinct values, some of them hidden."""
    columns = {"price": F.col("l_extendedprice"), "discount": F.when(F.col("l_returnflag") == "R", F.col("l_discount")), "quantity": F.col("l_quantity")}
    found = exact_medians(table(spark, d, "lineitem"), columns)
    return spark.createDataFrame([tuple(found.values())], "price double, discount double, quantity double")
