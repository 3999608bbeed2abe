"""Experiment logs, predictions and features derived from the given tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runsight.queries import table


def _number_in(column: str):
    return F.regexp_extract(column, r"(\d+)", 1).cast("int")


def result_log(spark: SparkSession, d: str) -> DataFrame:
    """Users are runs, events are experiments."""
    kind = F.col("event_type")
    status = F.when(kind == "error", "crash").when(kind == "purchase", "keep").otherwise("revert")
    return table(spark, d, "events").select(
        F.col("user_id").alias("run_id"),
        F.col("event_id").alias("experiment_id"),
        F.when(kind == "purchase", F.concat(F.lit("c"), F.col("event_id").cast("string"))).alias("commit_hash"),
        F.lit("score").alias("metric_name"),
        F.when(kind != "error", F.col("value")).alias("metric_value"),
        status.alias("status"),
        F.concat(kind, F.lit(" "), F.col("props")).alias("description"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        (F.floor("value") / 64).alias("cost_usd"),
    )


RESULT_LOG = """log AS (
  SELECT user_id AS run_id, event_id AS experiment_id,
    CASE WHEN event_type = 'purchase' THEN 'c' || event_id END AS commit_hash,
    'score' AS metric_name,
    CASE WHEN event_type <> 'error' THEN value END AS metric_value,
    CASE event_type WHEN 'error' THEN 'crash' WHEN 'purchase' THEN 'keep' ELSE 'revert' END AS status,
    event_type || ' ' || props AS description, ts, floor(value) / 64 AS cost_usd
  FROM events)"""


def attempts(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    memory = F.when(_number_in("props") % 3 == 0, "CUDA OOM").otherwise("ValueError")
    return table(spark, d, "events").select(
        F.col("user_id").alias("run_id"),
        F.col("event_id").alias("experiment_id"),
        F.when(kind == "error", "crash").when(kind == "signup", "timeout").otherwise("ok").alias("status"),
        F.when(kind == "error", memory).alias("error"),
        F.col("value").alias("metric_value"),
    )


def timed_attempts(spark: SparkSession, d: str) -> DataFrame:
    """Attempts with the time at which they were logged."""
    times = table(spark, d, "events").select(F.col("event_id").alias("experiment_id"), F.col("ts").cast("timestamp").alias("timestamp"))
    return attempts(spark, d).join(times, "experiment_id").select("run_id", "experiment_id", "status", "error", "metric_value", "timestamp")


def value_baselines(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").where(F.col("event_type").isin("view", "click"))
    return events.groupBy(F.col("event_type").alias("name")).agg(
        (F.avg("value") / 2).alias("score"), F.stddev_pop("value").alias("std")
    )


ATTEMPTS = """att AS (
  SELECT user_id AS run_id, event_id AS experiment_id,
    CASE event_type WHEN 'error' THEN 'crash' WHEN 'signup' THEN 'timeout' ELSE 'ok' END AS status,
    CASE WHEN event_type = 'error' THEN
      CASE WHEN CAST(regexp_extract(props, '(\\d+)', 1) AS INT) % 3 = 0 THEN 'CUDA OOM' ELSE 'ValueError' END END AS error,
    value AS metric_value
  FROM events),
bar AS (SELECT max(score) AS bar FROM (
  SELECT event_type, avg(value) / 2 AS score FROM events WHERE event_type IN ('view', 'click') GROUP BY 1))"""


def decided_sql(gate: bool) -> str:
    """CTEs up to ``decided``: the loop's action per attempt until a stop."""
    passes = "metric_value > (SELECT bar FROM bar)" if gate else "TRUE"
    return f"""{ATTEMPTS},
ran AS (SELECT *, status = 'ok' AS ran, {passes} AS passes, status = 'crash' AND error LIKE '%OOM%' AS oom FROM att),
bst AS (SELECT *, max(CASE WHEN ran AND passes THEN metric_value END)
  OVER (PARTITION BY run_id ORDER BY experiment_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM ran),
imp AS (SELECT *, ran AND (best_before IS NULL OR metric_value > best_before) AS improved FROM bst),
isl AS (SELECT *, sum(improved::INT) OVER (PARTITION BY run_id ORDER BY experiment_id) AS island FROM imp),
cnt AS (SELECT *, CAST(sum(oom::INT) OVER (PARTITION BY run_id, island ORDER BY experiment_id) AS BIGINT) AS out_of_memory_count FROM isl),
act AS (SELECT *, CASE WHEN oom AND out_of_memory_count > 2 THEN 'stop' WHEN oom THEN 'retry'
  WHEN improved AND passes THEN 'keep' ELSE 'revert' END AS action, improved AND NOT passes AS gated FROM cnt),
stp AS (SELECT run_id, min(experiment_id) AS stopped_at FROM act WHERE action = 'stop' GROUP BY 1),
decided AS (SELECT a.*, s.stopped_at FROM act a LEFT JOIN stp s USING (run_id)
  WHERE s.stopped_at IS NULL OR a.experiment_id <= s.stopped_at)"""


def price_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Order prices predicted by the mean of the order's priority, 100 too high."""
    orders = table(spark, d, "orders")
    means = orders.groupBy("o_orderpriority").agg((F.round(F.avg("o_totalprice"), 0) + 100).alias("y_pred"))
    return orders.join(means, "o_orderpriority").select(
        F.col("o_orderkey").alias("row_id"), F.col("o_totalprice").alias("y_true"), "y_pred", "o_orderpriority"
    )


PRICE_PREDICTIONS = """pm AS (SELECT o_orderpriority, round(avg(o_totalprice), 0) + 100 AS y_pred FROM orders GROUP BY 1),
pred AS (SELECT o_orderkey AS row_id, o_totalprice AS y_true, y_pred, o_orderpriority FROM orders JOIN pm USING (o_orderpriority))"""


def order_features(spark: SparkSession, d: str) -> DataFrame:
    orders, customer = table(spark, d, "orders"), table(spark, d, "customer")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("row_id"),
        "c_acctbal",
        F.col("c_nationkey").cast("double").alias("c_nationkey"),
        F.lit(1.0).alias("constant"),
    )


def status_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Order status guessed from the priority, with made-up confidences that follow from the key."""
    p = F.substring("o_orderpriority", 1, 1)
    guess = F.when(p == "1", "F").when(p == "2", "O").when(p == "3", "P").otherwise("O")
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("row_id"),
        F.col("o_orderstatus").alias("y_true"),
        guess.alias("y_pred"),
        F.array((F.col("o_orderkey") % 101) / 101.0, (F.col("o_orderkey") % 97) / 97.0).alias("proba"),
    )


STATUS_PREDICTIONS = """pred AS (SELECT o_orderkey AS row_id, o_orderstatus AS y_true,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'F' WHEN '2' THEN 'O' WHEN '3' THEN 'P' ELSE 'O' END AS y_pred,
  greatest((o_orderkey % 101) / 101.0, (o_orderkey % 97) / 97.0) AS confidence FROM orders)"""


def purchase_scores(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        (F.col("event_type") == "purchase").cast("int").alias("y_true"),
        F.col("value").alias("score"),
        (F.col("value") / (F.col("value") + 200)).alias("probability"),
        F.col("event_id").alias("row_id"),
        F.col("user_id"),
    )


PURCHASE_SCORES = """pred AS (SELECT CAST(event_type = 'purchase' AS INT) AS y_true, value AS score,
  value / (value + 200) AS probability, event_id AS row_id, user_id FROM events)"""


def with_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Parts with missing sizes, prices and brands."""
    k = F.col("p_partkey")
    return table(spark, d, "part").select(
        "p_partkey",
        F.when(k % 7 != 0, F.col("p_size").cast("double")).alias("p_size"),
        F.when(k % 5 == 0, F.lit(float("nan"))).otherwise(F.col("p_retailprice")).alias("p_retailprice"),
        F.when(k % 11 != 0, F.col("p_brand")).alias("p_brand"),
        F.when(k % 13 != 0, F.col("p_type")).alias("p_type"),
    )


WITH_GAPS = """gaps AS (SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN CAST(p_size AS DOUBLE) END AS p_size,
  CASE WHEN p_partkey % 5 <> 0 THEN p_retailprice END AS p_retailprice,
  CASE WHEN p_partkey % 11 <> 0 THEN p_brand END AS p_brand,
  CASE WHEN p_partkey % 13 <> 0 THEN p_type END AS p_type FROM part)"""


def folds_sql(source: str, key: str, k: int = 5, seed: int = 42) -> str:
    """CTE ``folds`` (key, fold): consecutive blocks of the hash order."""
    past = " + ".join(f"CAST(rn > {i + 1} * (n // {k}) + least({i + 1}, n % {k}) AS INT)" for i in range(k - 1))
    return f"""hs AS (SELECT {key}, row_number() OVER (ORDER BY md5(CAST({key} AS VARCHAR) || ':{seed}')) AS rn,
  count(*) OVER () AS n FROM {source}),
folds AS (SELECT {key}, {past} AS fold FROM hs)"""


def strata_sql(source: str, key: str, label: str, k: int = 5, seed: int = 42) -> str:
    """CTE ``folds`` (key, label, fold): blocks per class, sizes dealt round robin over the sorted classes."""
    dealt = [f"(floor((o + n - 1 - {i}) / {k}) - floor((o - 1 - {i}) / {k}))" for i in range(k - 1)]
    past = " + ".join(f"CAST(rn > {' + '.join(dealt[: i + 1])} AS INT)" for i in range(k - 1))
    return f"""cs AS (SELECT {label} AS l, count(*) AS n, sum(count(*)) OVER (ORDER BY {label}) - count(*) AS o FROM {source} GROUP BY 1),
hs AS (SELECT {key}, {label} AS l, row_number() OVER (PARTITION BY {label} ORDER BY md5(CAST({key} AS VARCHAR) || ':{seed}')) AS rn FROM {source}),
folds AS (SELECT {key}, l AS {label}, {past} AS fold FROM hs JOIN cs USING (l))"""
