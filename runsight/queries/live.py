"""The log operators over streams of the events; each stream is drained once and compared with the batch answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runsight.queries import SQL, logs as _logs, query, r, scratch, table  # noqa: F401  _logs registers the SQL used here
from runsight.queries.inputs import RESULT_LOG, attempts, decided_sql, result_log, timed_attempts, value_baselines
from runsight.session import materialize
from runsight.sources import logs
from runsight.streaming import live, ordered

FAMILIES = ["linear", "random_forest", "xgboost", "lightgbm", "svm"]


def _stream(spark: SparkSession, d: str, batch: DataFrame) -> DataFrame:
    """A derived log, written as JSON files and followed as a stream."""
    path = scratch(spark)
    batch.write.json(path)
    return live.follow(spark, path, batch.schema)


@query(SQL["best_result"])
def live_best(spark: SparkSession, d: str) -> DataFrame:
    stream = live.live_best(_stream(spark, d, result_log(spark, d)))
    return live.drain(stream, "complete").select("run_id", "experiment_id", "commit_hash", "metric_value", "status")


@query(SQL["scoreboard_best"])
def live_scoreboard(spark: SparkSession, d: str) -> DataFrame:
    """Best over all agents of a tab-separated scoreboard that is being appended to."""
    path = scratch(spark)
    board = table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("agent"), F.col("event_id").cast("string").alias("commit"), F.col("value").alias("metric_value"),
        F.lit(1.0).alias("elapsed_sec"), F.lit("keep").alias("status"), F.lit("x").alias("description"), F.col("ts").cast("timestamp").alias("timestamp"),
    )
    logs.append_scoreboard(board, path)
    stream = live.follow(spark, path, logs.SCOREBOARD_SCHEMA, "csv", sep="\t", header=True)
    best = live.live_best(stream.withColumn("experiment_id", F.col("commit").cast("long")).withColumn("board", F.lit(1)), by=["board"])
    return live.drain(best, "complete").select(F.col("metric_value").alias("best_metric"), F.col("agent").cast("long").alias("best_agent"))


@query(SQL["log_summary"])
def live_summary(spark: SparkSession, d: str) -> DataFrame:
    return live.drain(live.live_summary(_stream(spark, d, result_log(spark, d))), "complete")


@query(SQL["cost_summary"])
def live_cost(spark: SparkSession, d: str) -> DataFrame:
    out = live.drain(live.live_cost(_stream(spark, d, result_log(spark, d))), "complete")
    return out.select("run_id", r("total", 4).alias("total"), "count", r("avg").alias("avg"), r("min", 4).alias("min"), r("max", 4).alias("max"))


@query(f"WITH {decided_sql(gate=True)} SELECT run_id, experiment_id, action, gated, best_before FROM decided")
def live_decisions(spark: SparkSession, d: str) -> DataFrame:
    bar = value_baselines(spark, d).agg(F.max("score").alias("bar")).first()["bar"]
    out = live.drain(live.live_decisions(_stream(spark, d, attempts(spark, d)), bar=bar), "append")
    return out.select("run_id", "experiment_id", "action", "gated", "best_before")


@query(SQL["stagnation_events"])
def live_stagnation(spark: SparkSession, d: str) -> DataFrame:
    bar = value_baselines(spark, d).agg(F.max("score").alias("bar")).first()["bar"]
    out = live.drain(live.live_decisions(_stream(spark, d, attempts(spark, d)), bar=bar, families=FAMILIES), "append")
    return out.where(F.col("family").isNotNull()).select("run_id", "experiment_id", "family")


def _backwards(spark: SparkSession, d: str, delay: str, parts: int = 4) -> DataFrame:
    """Decisions over a log whose latest stretch is written first, with a last row that closes it by moving the clock on."""
    path, log = scratch(spark), materialize(timed_attempts(spark, d))  # read once per part
    bar = value_baselines(spark, d).agg(F.max("score").alias("bar")).first()["bar"]
    top = log.agg(F.max("experiment_id").alias("top")).first()["top"] + 1
    for i in reversed(range(parts)):
        log.where((F.col("experiment_id") >= top * i // parts) & (F.col("experiment_id") < top * (i + 1) // parts)).write.mode("append").json(path)
    spark.sql("SELECT timestamp'2100-01-01' AS timestamp").write.mode("append").json(path)
    files = spark.read.format("binaryFile").load(path).count()
    ordered.use_state_store(spark)
    stream = live.follow(spark, path, log.schema, files_per_batch=max(1, files // parts))
    return live.drain(ordered.ordered_decisions(stream, delay, bar=bar, families=FAMILIES), "append")


@query(f"WITH {decided_sql(gate=True)} SELECT run_id, experiment_id, action, gated, best_before, FALSE AS late FROM decided")
def ordered_decisions(spark: SparkSession, d: str) -> DataFrame:
    """A log read back to front, within a delay that covers it: the decisions of the batch."""
    return _backwards(spark, d, "60 days").select("run_id", "experiment_id", "action", "gated", "best_before", "late")


@query(SQL["stagnation_events"])
def ordered_stagnation(spark: SparkSession, d: str) -> DataFrame:
    return _backwards(spark, d, "60 days").where(F.col("family").isNotNull()).select("run_id", "experiment_id", "family")


@query("SELECT user_id AS run_id, max(event_id) AS experiment_id, 'time' AS reason FROM events GROUP BY user_id")
def silent_runs(spark: SparkSession, d: str) -> DataFrame:
    """Every run has used up a budget of 40 days by the time of the last row, which only moves the clock."""
    log = result_log(spark, d).select("run_id", "experiment_id", "cost_usd", "timestamp")
    path = scratch(spark)
    log.write.json(path)
    spark.sql("SELECT -1L AS run_id, -1L AS experiment_id, 0D AS cost_usd, timestamp'2100-01-01' AS timestamp").write.mode("append").json(path)
    files = spark.read.format("binaryFile").load(path).count()
    stream = live.follow(spark, path, log.schema, files_per_batch=max(1, files - 1))
    return live.drain(live.silent_runs(stream, minutes=40 * 24 * 60), "append")


@query(f"WITH {RESULT_LOG} SELECT run_id, experiment_id, metric_value FROM log")
def without_repeats(spark: SparkSession, d: str) -> DataFrame:
    """Every row written twice comes through once."""
    log = result_log(spark, d)
    out = live.drain(live.without_repeats(_stream(spark, d, log.unionByName(log)), delay="60 days"), "append")
    return out.select("run_id", "experiment_id", "metric_value")


@query(f"""WITH {RESULT_LOG}, s AS (SELECT run_id, experiment_id, row_number() OVER (PARTITION BY run_id ORDER BY experiment_id) AS n,
  sum(cost_usd) OVER (PARTITION BY run_id ORDER BY experiment_id) AS c, epoch(ts) - min(epoch(ts)) OVER (PARTITION BY run_id ORDER BY experiment_id) AS e FROM log),
h AS (SELECT run_id, experiment_id, CASE WHEN n >= 60 THEN 'experiments' WHEN c >= 30 THEN 'cost' WHEN e >= 25 * 86400 THEN 'time' END AS reason FROM s)
SELECT run_id, min(experiment_id) AS experiment_id, arg_min(reason, experiment_id) AS reason FROM h WHERE reason IS NOT NULL GROUP BY 1""")
def budget_alarm(spark: SparkSession, d: str) -> DataFrame:
    stream = _stream(spark, d, result_log(spark, d))
    return live.drain(live.budget_alarm(stream, experiments=60, usd=30.0, minutes=25 * 24 * 60), "append")
