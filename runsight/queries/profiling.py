"""Profiles, missing values, leakage, dates, validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runsight.operators import catalog, profile
from runsight.queries import query, r, table
from runsight.queries.inputs import WITH_GAPS, with_gaps

NUMERIC_TYPES = "('INTEGER', 'BIGINT', 'DOUBLE', 'FLOAT')"


def _flat(p: DataFrame, classes: DataFrame) -> DataFrame:
    """A profile in plain columns, with its few classes in one text; NULL where there are none."""
    pairs = F.collect_list(F.struct("value", F.col("n").cast("string").alias("n")))
    texts = F.transform(F.array_sort(pairs), lambda e: F.concat_ws("=", e["value"], e["n"]))
    distribution = classes.agg(F.when(F.count("value") > 0, F.array_join(texts, ",")).alias("distribution"))  # one row
    return p.join(F.broadcast(distribution)).select(
        "task",
        "metric",
        "direction",
        "n_rows",
        "n_features",
        F.array_join(F.array_sort("numeric_features"), ",").alias("numeric_features"),
        F.array_join(F.array_sort("categorical_features"), ",").alias("categorical_features"),
        F.array_join("date_columns", ",").alias("date_columns"),
        F.size("leakage_warnings").cast("long").alias("n_warnings"),
        r("target_stats.mean", 2).alias("target_mean"),
        r("target_stats.std", 2).alias("target_std"),
        F.col("target_stats.n_classes").alias("n_classes"),
        "distribution",
        r("missing_pct").alias("missing_pct"),
    )


def _profiled(df: DataFrame, target: str) -> DataFrame:
    return _flat(profile.profile_dataset(df, target), profile.class_distribution(df, target))


def _columns(source: str, target: str, test: str) -> str:
    return f"""(SELECT string_agg(column_name, ',' ORDER BY column_name) FROM (DESCRIBE {source})
      WHERE column_name <> '{target}' AND {test})"""


@query(f"""SELECT 'regression' AS task, 'r2' AS metric, 'maximize' AS direction, count(*) AS n_rows, CAST(10 AS BIGINT) AS n_features,
  {_columns('lineitem', 'l_extendedprice', f'column_type IN {NUMERIC_TYPES}')} AS numeric_features,
  {_columns('lineitem', 'l_extendedprice', f'column_type NOT IN {NUMERIC_TYPES}')} AS categorical_features,
  'l_shipdate' AS date_columns, CAST(0 AS BIGINT) AS n_warnings, round(avg(l_extendedprice), 2) AS target_mean,
  round(stddev_samp(l_extendedprice), 2) AS target_std, CAST(NULL AS BIGINT) AS n_classes, CAST(NULL AS VARCHAR) AS distribution,
  0.0 AS missing_pct FROM lineitem""")
def profile_regression(spark: SparkSession, d: str) -> DataFrame:
    return _profiled(table(spark, d, "lineitem"), "l_extendedprice")


@query(f"""SELECT 'classification' AS task, 'f1_weighted' AS metric, 'maximize' AS direction, count(*) AS n_rows, CAST(10 AS BIGINT) AS n_features,
  {_columns('lineitem', 'l_returnflag', f'column_type IN {NUMERIC_TYPES}')} AS numeric_features,
  {_columns('lineitem', 'l_returnflag', f'column_type NOT IN {NUMERIC_TYPES}')} AS categorical_features,
  'l_shipdate' AS date_columns, CAST(0 AS BIGINT) AS n_warnings, CAST(NULL AS DOUBLE) AS target_mean,
  CAST(NULL AS DOUBLE) AS target_std, count(DISTINCT l_returnflag) AS n_classes,
  (SELECT string_agg(l_returnflag || '=' || n, ',' ORDER BY l_returnflag) FROM
    (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1)) AS distribution,
  0.0 AS missing_pct FROM lineitem""")
def profile_classification(spark: SparkSession, d: str) -> DataFrame:
    return _profiled(table(spark, d, "lineitem"), "l_returnflag")


@query(f"""WITH {WITH_GAPS} SELECT round(100.0 * (5 * count(*) - count(p_partkey) - count(p_size) - count(p_retailprice)
  - count(p_brand) - count(p_type)) / (5 * count(*)), 6) AS missing_pct FROM gaps""")
def missing_pct(spark: SparkSession, d: str) -> DataFrame:
    return profile.missing_pct(with_gaps(spark, d)).select(r("missing_pct").alias("missing_pct"))


@query("SELECT event_type AS value, count(*) AS n FROM events GROUP BY 1")
def value_counts(spark: SparkSession, d: str) -> DataFrame:
    return profile.value_counts(table(spark, d, "events"), "event_type")


@query(f"WITH {WITH_GAPS} SELECT count(DISTINCT p_retailprice) AS n_unique FROM gaps")
def n_unique(spark: SparkSession, d: str) -> DataFrame:
    return profile.n_unique(with_gaps(spark, d), "p_retailprice")


@query("SELECT count(DISTINCT label) AS n_classes FROM embeddings")
def class_count(spark: SparkSession, d: str) -> DataFrame:
    return profile.class_count(table(spark, d, "embeddings"), "label")


_SUMMARY = """SELECT 'shape' AS section, 'rows' AS key, CAST(count(*) AS VARCHAR) AS value FROM orders
UNION ALL SELECT 'shape', 'columns', '6'
UNION ALL SELECT 'feature', column_name, CASE WHEN column_type IN ('INTEGER', 'BIGINT', 'DOUBLE') THEN 'numeric' ELSE 'categorical' END
  FROM (DESCRIBE orders) WHERE column_name <> '{t}'"""


@query(
    _SUMMARY.format(t="o_totalprice")
    + """ UNION ALL SELECT 'target', 'type', 'continuous'
UNION ALL SELECT 'target', 'mean', printf('%.4f', avg(o_totalprice)) FROM orders
UNION ALL SELECT 'target', 'std', printf('%.4f', stddev_samp(o_totalprice)) FROM orders
UNION ALL SELECT 'target', 'min', printf('%.4f', min(o_totalprice)) FROM orders
UNION ALL SELECT 'target', 'max', printf('%.4f', max(o_totalprice)) FROM orders"""
)
def data_summary_continuous(spark: SparkSession, d: str) -> DataFrame:
    return profile.data_summary(table(spark, d, "orders"), "o_totalprice")


@query(
    _SUMMARY.format(t="o_orderstatus")
    + """ UNION ALL SELECT 'target', 'type', 'categorical'
UNION ALL SELECT 'target', 'n_classes', CAST(count(DISTINCT o_orderstatus) AS VARCHAR) FROM orders
UNION ALL SELECT 'class', o_orderstatus, CAST(count(*) AS VARCHAR) FROM orders GROUP BY o_orderstatus"""
)
def data_summary_categorical(spark: SparkSession, d: str) -> DataFrame:
    return profile.data_summary(table(spark, d, "orders"), "o_orderstatus")


@query("SELECT round(avg(o_totalprice), 2) AS mean, round(stddev_samp(o_totalprice), 2) AS std, min(o_totalprice) AS min, max(o_totalprice) AS max FROM orders")
def target_stats(spark: SparkSession, d: str) -> DataFrame:
    out = profile.target_stats(table(spark, d, "orders"), "o_totalprice")
    return out.select(r("mean", 2).alias("mean"), r("std", 2).alias("std"), "min", "max")


@query("""SELECT 'text_length' AS feature, round(corr(length(text), n_chars), 6) AS correlation FROM documents
UNION ALL SELECT 'doc_id', round(corr(doc_id, n_chars), 6) FROM documents""")
def target_correlations(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents").select("doc_id", "n_chars", F.length("text").alias("text_length"), F.lit(1).alias("constant"))
    return profile.target_correlations(documents, "n_chars").select("feature", r("correlation").alias("correlation"))


@query("""SELECT '''n_chars_copy'' has the target''s name ''n_chars'' in its own' AS warning
UNION ALL SELECT '''text_length'' correlates with the target at ' || printf('%.3f', corr(length(text), n_chars)) FROM documents
UNION ALL SELECT '''n_chars_copy'' correlates with the target at 1.000'""")
def leakage(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents").select("doc_id", "n_chars", F.length("text").alias("text_length"), (F.col("n_chars") * 2).alias("n_chars_copy"))
    warnings = profile.leakage_warnings(documents, "n_chars")
    return spark.createDataFrame([(w,) for w in warnings], "warning string")


@query("SELECT 'as_text' AS column_name UNION ALL SELECT 'o_orderdate'")
def date_columns(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").withColumn("as_text", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return spark.createDataFrame([(c,) for c in profile.detect_date_columns(orders)], "column_name string")


@query("""SELECT column_name AS feature, CASE WHEN column_type IN ('INTEGER', 'BIGINT', 'DOUBLE') THEN 'numeric' ELSE 'categorical' END AS kind
FROM (DESCRIBE customer) WHERE column_name <> 'c_mktsegment'""")
def feature_types(spark: SparkSession, d: str) -> DataFrame:
    kinds = profile.feature_types(table(spark, d, "customer"), "c_mktsegment")
    return spark.createDataFrame(list(kinds.items()), "feature string, kind string")


@query("SELECT c_custkey, c_nationkey, round(c_acctbal, 2) AS c_acctbal FROM customer")
def select_numbers(spark: SparkSession, d: str) -> DataFrame:
    return profile.select_by_type(profile.drop_target(table(spark, d, "customer"), "c_mktsegment"), "number")


_METRIC_CASE = "CASE event_type WHEN 'click' THEN 'accuracy' WHEN 'view' THEN 'rmse' WHEN 'signup' THEN 'perplexity' WHEN 'error' THEN 'my_metric' ELSE 'rougeL' END"
_DOMAIN_CASE = "CASE user_id % 3 WHEN 0 THEN 'tabular' WHEN 1 THEN 'deeplearning' ELSE 'finetuning' END"
_TASK_CASE = "CASE event_id % 3 WHEN 0 THEN 'classification' WHEN 1 THEN 'regression' END"
_MODEL_CASE = "CASE WHEN event_id % 2 = 0 THEN 'm' END"


def _configs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").selectExpr(
        "event_id AS config_id", f"{_METRIC_CASE} AS metric", f"{_DOMAIN_CASE} AS domain", f"{_TASK_CASE} AS task",
        f"{_MODEL_CASE} AS model_name", "CAST(NULL AS STRING) AS direction",
    )


_CONFIGS = f"""cfg AS (SELECT event_id AS config_id, {_METRIC_CASE} AS metric, {_DOMAIN_CASE} AS domain, {_TASK_CASE} AS task,
  {_MODEL_CASE} AS model_name FROM events)"""


@query(f"""WITH {_CONFIGS} SELECT config_id, CASE metric WHEN 'accuracy' THEN 'maximize' WHEN 'rougeL' THEN 'maximize'
  WHEN 'rmse' THEN 'minimize' WHEN 'perplexity' THEN 'minimize' END AS direction FROM cfg""")
def metric_direction(spark: SparkSession, d: str) -> DataFrame:
    return catalog.metric_direction(_configs(spark, d)).select("config_id", "direction")


@query(f"""WITH {_CONFIGS}
SELECT config_id, 'Unknown ' || domain || ' metric: ' || metric AS error FROM cfg
  WHERE (domain = 'tabular' AND metric NOT IN ('accuracy', 'rmse')) OR (domain = 'deeplearning' AND metric <> 'accuracy')
     OR (domain = 'finetuning' AND metric NOT IN ('perplexity', 'rougeL'))
UNION ALL SELECT config_id, 'Unknown deeplearning task: ' || task FROM cfg WHERE domain = 'deeplearning' AND task IS NOT NULL
UNION ALL SELECT config_id, 'model_name is required for finetuning' FROM cfg WHERE domain = 'finetuning' AND model_name IS NULL""")
def validate_metric(spark: SparkSession, d: str) -> DataFrame:
    return catalog.validate_metric(_configs(spark, d))


@query(f"""WITH {_CONFIGS} SELECT config_id,
  CASE WHEN domain = 'finetuning' AND metric NOT IN ('perplexity', 'rougeL') THEN 'loss' ELSE metric END AS metric,
  CASE WHEN domain = 'finetuning' AND metric NOT IN ('perplexity', 'rougeL') THEN 'minimize' END AS direction,
  CASE WHEN domain = 'finetuning' AND task IS NOT NULL THEN 'sft' WHEN domain = 'deeplearning' AND task = 'classification' THEN 'image_classification'
    WHEN domain = 'deeplearning' AND task = 'regression' THEN 'custom' ELSE task END AS task FROM cfg""")
def map_task(spark: SparkSession, d: str) -> DataFrame:
    return catalog.map_task(_configs(spark, d)).select("config_id", "metric", "direction", "task")


@query("""SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'of ' || event_type END AS goal_kind,
  CASE WHEN event_type = 'click' THEN 'price' WHEN event_type = 'view' THEN 'target' ELSE event_type END AS label FROM events""")
def label_from_goal(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    goal = F.when(kind == "click", "please PREDICT price now").when(kind == "view", "predict the  target well").otherwise(F.concat(F.lit(" find values of "), kind, F.lit(" ")))
    events = table(spark, d, "events").select("event_id", "event_type", goal.alias("goal"))
    shown = F.when(kind.isin("click", "view"), kind).otherwise(F.concat(F.lit("of "), kind))
    return events.select("event_id", shown.alias("goal_kind"), catalog.label_from_goal(F.col("goal")).alias("label"))


@query("""SELECT user_id, CASE WHEN NOT list_contains(f, 'linear') THEN 'linear' WHEN NOT list_contains(f, 'random_forest') THEN 'random_forest'
  WHEN NOT list_contains(f, 'xgboost') THEN 'xgboost' WHEN NOT list_contains(f, 'lightgbm') THEN 'lightgbm' WHEN NOT list_contains(f, 'svm') THEN 'svm' END AS next_family
FROM (SELECT user_id, list(DISTINCT CASE event_type WHEN 'click' THEN 'linear' WHEN 'view' THEN 'random_forest' WHEN 'error' THEN 'xgboost' WHEN 'signup' THEN 'lightgbm' ELSE 'svm' END) AS f
  FROM events WHERE value > 100 GROUP BY 1)""")
def untried_families(spark: SparkSession, d: str) -> DataFrame:
    family = F.expr("CASE event_type WHEN 'click' THEN 'linear' WHEN 'view' THEN 'random_forest' WHEN 'error' THEN 'xgboost' WHEN 'signup' THEN 'lightgbm' ELSE 'svm' END")
    # at most five families per run
    tried = table(spark, d, "events").where(F.col("value") > 100).groupBy("user_id").agg(F.collect_set(family).alias("tried_families"))
    return catalog.untried(tried.withColumn("domain", F.lit("tabular"))).select("user_id", "next_family")


@query("""SELECT 'good' AS name, CASE WHEN count(o_totalprice) > 0 AND count(*) > 0 THEN 'ok' END AS verdict FROM orders
UNION ALL SELECT 'no target', 'no target column' UNION ALL SELECT 'no rows', 'the dataset has no rows'
UNION ALL SELECT 'no values', 'every value of target' UNION ALL SELECT 'no feature', 'no feature column besides the target'
UNION ALL SELECT 'empty features', 'every value of every feature is missing'""")
def validate_input(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts on the orders and on spoiled forms of them."""
    orders = table(spark, d, "orders").select("o_totalprice", "o_orderstatus")
    none = F.lit(None).cast("double")
    cases = {
        "good": (orders, "o_totalprice"),
        "no target": (orders, "gone"),
        "no rows": (orders.where("o_totalprice < 0"), "o_totalprice"),
        "no values": (orders.withColumn("o_totalprice", none), "o_totalprice"),
        "no feature": (orders.select("o_totalprice"), "o_totalprice"),
        "empty features": (orders.withColumn("o_orderstatus", none), "o_totalprice"),
    }
    verdicts = []
    for name, (df, target) in cases.items():
        try:
            profile.validate_input(df, target)
            verdicts.append((name, "ok"))
        except ValueError as error:
            text = str(error)
            verdicts.append((name, next((t for t in ("no target column", "every value of target") if text.startswith(t)), text)))
    return spark.createDataFrame(verdicts, "name string, verdict string")


@query("SELECT c_name AS value, count(*) AS n, (SELECT count(DISTINCT c_name) FROM customer) AS n_classes, (SELECT count(*) FROM customer) AS n_rows FROM customer GROUP BY c_name")
def profile_many_classes(spark: SparkSession, d: str) -> DataFrame:
    """A target in which every row is a class of its own: the profile beside its classes, a row each."""
    customer = table(spark, d, "customer")
    facts = profile.profile_dataset(customer, "c_name").select("target_stats.n_classes", "n_rows")  # one row
    return profile.class_distribution(customer, "c_name").join(F.broadcast(facts)).select("value", "n", "n_classes", "n_rows")


@query("SELECT l_returnflag AS value, count(*) AS n FROM lineitem GROUP BY 1 UNION ALL SELECT 'n' || l_linenumber, count(*) FROM lineitem GROUP BY 1")
def class_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Classes of a text and of a number with few values; a continuous target adds no row."""
    lineitem = table(spark, d, "lineitem")
    few = profile.class_distribution(lineitem, "l_linenumber").select(F.concat(F.lit("n"), "value").alias("value"), "n")
    return profile.class_distribution(lineitem, "l_returnflag").unionByName(few).unionByName(profile.class_distribution(lineitem, "l_extendedprice"))


@query(f"""WITH {_CONFIGS} SELECT config_id, CASE WHEN model_name IS NULL AND domain = 'finetuning' THEN 'meta-llama/Llama-3.2-1B' ELSE model_name END AS model_name FROM cfg""")
def map_task_model_name(spark: SparkSession, d: str) -> DataFrame:
    return catalog.map_task(_configs(spark, d)).select("config_id", "model_name")
