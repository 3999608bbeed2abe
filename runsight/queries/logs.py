"""Experiment logs: best, decisions, streaks, budgets, summaries, reports, agents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runsight.operators import agents, baselines, runlog, training
from runsight.plans.running import Running, hot_keys, running, running_global
from runsight.queries import query, r, table
from runsight.queries.inputs import RESULT_LOG, attempts, decided_sql, result_log, value_baselines

_BEFORE = "OVER (PARTITION BY run_id ORDER BY experiment_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_UPTO = "OVER (PARTITION BY run_id ORDER BY experiment_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def _first(direction: str) -> str:
    order = "DESC" if direction == "maximize" else "ASC"
    return f"row_number() OVER (PARTITION BY run_id ORDER BY metric_value {order} NULLS LAST, experiment_id) AS rn"


@query(f"WITH {RESULT_LOG} SELECT run_id, experiment_id, metric_value FROM log WHERE status = 'keep'")
def filter_status(spark: SparkSession, d: str) -> DataFrame:
    return runlog.filter_status(result_log(spark, d), "keep").select("run_id", "experiment_id", "metric_value")


@query(f"WITH {RESULT_LOG} SELECT run_id, experiment_id, metric_value FROM log WHERE metric_value IS NOT NULL")
def filter_valid_metric(spark: SparkSession, d: str) -> DataFrame:
    return runlog.filter_valid_metric(result_log(spark, d)).select("run_id", "experiment_id", "metric_value")


@query(f"WITH {RESULT_LOG} SELECT run_id, experiment_id, commit_hash, metric_value, status FROM (SELECT *, {_first('maximize')} FROM log) WHERE rn = 1 AND metric_value IS NOT NULL")
def best_result(spark: SparkSession, d: str) -> DataFrame:
    return runlog.best_result(result_log(spark, d)).select("run_id", "experiment_id", "commit_hash", "metric_value", "status")


@query(f"WITH {RESULT_LOG} SELECT run_id, experiment_id, metric_value FROM (SELECT *, {_first('minimize')} FROM log) WHERE rn = 1 AND metric_value IS NOT NULL")
def best_result_minimize(spark: SparkSession, d: str) -> DataFrame:
    return runlog.best_result(result_log(spark, d), "minimize").select("run_id", "experiment_id", "metric_value")


@query(f"""WITH {RESULT_LOG}, dr AS (SELECT l_suppkey AS run_id, l_returnflag AS name, avg(l_quantity) AS metric_value,
  CAST(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS BIGINT) AS position FROM lineitem GROUP BY 1, 2)
SELECT run_id, name, position, round(metric_value, 6) AS metric_value FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY round(metric_value, 9) DESC, position) AS rn FROM dr) WHERE rn = 1""")
def best_draft(spark: SparkSession, d: str) -> DataFrame:
    flag = F.col("l_returnflag")
    drafts = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("run_id"), flag.alias("name")).agg(F.round(F.avg("l_quantity"), 9).alias("metric_value"))
    placed = drafts.withColumn("position", F.when(F.col("name") == "A", 0).when(F.col("name") == "N", 1).otherwise(2).cast("long"))
    return runlog.best_draft(placed).select("run_id", "name", "position", r("metric_value").alias("metric_value"))


def _board(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        F.col("event_type").alias("run_id"), F.col("event_id").alias("position"), F.col("user_id").alias("agent"), F.col("value").alias("metric_value")
    )


@query("SELECT value AS best_metric, user_id AS best_agent FROM events ORDER BY value DESC, event_id LIMIT 1")
def scoreboard_best(spark: SparkSession, d: str) -> DataFrame:
    return runlog.scoreboard_best(_board(spark, d))


@query("""SELECT event_type AS run_id, event_id AS position, user_id AS agent, coalesce(value > max(value) OVER (PARTITION BY event_type ORDER BY event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE) AS is_new_best FROM events""")
def new_global_best(spark: SparkSession, d: str) -> DataFrame:
    return runlog.new_global_best(_board(spark, d)).select("run_id", "position", "agent", "is_new_best")


@query(f"WITH {RESULT_LOG} SELECT run_id, experiment_id, min(metric_value) {_BEFORE} AS best_before, min(metric_value) {_UPTO} AS best_after FROM log")
def running_best(spark: SparkSession, d: str) -> DataFrame:
    return runlog.running_best(result_log(spark, d), "minimize").select("run_id", "experiment_id", "best_before", "best_after")


@query(f"""WITH {RESULT_LOG} SELECT run_id, experiment_id, round(metric_value - max(CASE WHEN status = 'keep' THEN metric_value END) {_BEFORE}, 2) AS metric_delta FROM log""")
def metric_delta(spark: SparkSession, d: str) -> DataFrame:
    return runlog.metric_delta(result_log(spark, d)).select("run_id", "experiment_id", r("metric_delta", 2).alias("metric_delta"))


@query(f"WITH {decided_sql(gate=False)} SELECT run_id, experiment_id, action FROM decided")
def classify_outcome(spark: SparkSession, d: str) -> DataFrame:
    return runlog.classify_outcome(attempts(spark, d)).select("run_id", "experiment_id", "action")


@query(f"WITH {decided_sql(gate=False)} SELECT run_id, stopped_at, out_of_memory_count FROM decided WHERE action = 'stop'")
def retry_limit(spark: SparkSession, d: str) -> DataFrame:
    return runlog.retry_limit(attempts(spark, d))


def _decided(spark: SparkSession, d: str) -> DataFrame:
    return runlog.decide(baselines.baseline_gate(attempts(spark, d), value_baselines(spark, d)))


@query(f"WITH {decided_sql(gate=True)} SELECT run_id, experiment_id, action, gated, best_before, improved, out_of_memory_count FROM decided")
def decide_keep_revert(spark: SparkSession, d: str) -> DataFrame:
    return _decided(spark, d).select("run_id", "experiment_id", "action", "gated", "best_before", "improved", "out_of_memory_count")


# The event chain of a run is a recursion over its steps: reverts and the streak are carried from row to row.
@query(f"""WITH RECURSIVE {decided_sql(gate=True)},
st AS (SELECT run_id, experiment_id, action, gated, row_number() OVER (PARTITION BY run_id ORDER BY experiment_id) AS i FROM decided WHERE action IN ('keep', 'revert')),
w AS (
  SELECT run_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS experiment_id, 0 AS streak, FALSE AS kept, 0 AS tried, FALSE AS fired FROM (SELECT DISTINCT run_id FROM st)
  UNION ALL
  SELECT s.run_id, s.i, s.experiment_id,
    CASE WHEN s.action = 'keep' THEN 0 WHEN NOT s.gated AND w.kept AND w.streak + 1 >= 3 AND w.tried < 5 THEN 0 ELSE w.streak + 1 END,
    w.kept OR s.action = 'keep',
    CASE WHEN s.action = 'revert' AND NOT s.gated AND w.kept AND w.streak + 1 >= 3 AND w.tried < 5 THEN w.tried + 1 ELSE w.tried END,
    s.action = 'revert' AND NOT s.gated AND w.kept AND w.streak + 1 >= 3 AND w.tried < 5
  FROM w JOIN st s ON s.run_id = w.run_id AND s.i = w.i + 1)
SELECT run_id, experiment_id, CASE tried WHEN 1 THEN 'linear' WHEN 2 THEN 'random_forest' WHEN 3 THEN 'xgboost' WHEN 4 THEN 'lightgbm' ELSE 'svm' END AS family
FROM w WHERE fired""")
def stagnation_events(spark: SparkSession, d: str) -> DataFrame:
    families = ["linear", "random_forest", "xgboost", "lightgbm", "svm"]
    return runlog.stagnation_events(_decided(spark, d), families)


_STREAK = f"""{RESULT_LOG}, isl AS (SELECT *, sum(CAST(status <> 'revert' AS INT)) OVER (PARTITION BY run_id ORDER BY experiment_id) AS island FROM log),
streak AS (SELECT run_id, experiment_id, CAST(sum(CAST(status = 'revert' AS INT)) OVER (PARTITION BY run_id, island ORDER BY experiment_id) AS BIGINT) AS consecutive_reverts FROM isl)"""


@query(f"WITH {_STREAK} SELECT * FROM streak")
def consecutive_reverts(spark: SparkSession, d: str) -> DataFrame:
    return runlog.consecutive_reverts(result_log(spark, d)).select("run_id", "experiment_id", "consecutive_reverts")


@query(f"WITH {_STREAK} SELECT run_id, max(consecutive_reverts) AS max_streak FROM streak GROUP BY 1")
def max_revert_streak(spark: SparkSession, d: str) -> DataFrame:
    return runlog.max_revert_streak(result_log(spark, d))


@query(f"WITH {_STREAK} SELECT run_id, experiment_id, consecutive_reverts >= 3 AS is_stagnated FROM streak")
def stagnated(spark: SparkSession, d: str) -> DataFrame:
    return runlog.stagnated(result_log(spark, d)).select("run_id", "experiment_id", "is_stagnated")


@query(f"WITH {RESULT_LOG} SELECT run_id, experiment_id, round(sum(cost_usd) {_UPTO}, 4) AS cost_so_far FROM log")
def cumulative_cost(spark: SparkSession, d: str) -> DataFrame:
    return runlog.cumulative_cost(result_log(spark, d)).select("run_id", "experiment_id", r("cost_so_far", 4).alias("cost_so_far"))


@query(f"""WITH {RESULT_LOG} SELECT run_id, round(sum(cost_usd), 4) AS total, count(*) AS count, round(avg(cost_usd), 6) AS avg,
  round(min(cost_usd), 4) AS min, round(max(cost_usd), 4) AS max FROM log GROUP BY 1""")
def cost_summary(spark: SparkSession, d: str) -> DataFrame:
    out = runlog.cost_summary(result_log(spark, d))
    return out.select("run_id", r("total", 4).alias("total"), "count", r("avg").alias("avg"), r("min", 4).alias("min"), r("max", 4).alias("max"))


def _config(spark: SparkSession, d: str) -> DataFrame:
    """Budgets per user, from what the user's events look like."""
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").groupBy(F.col("user_id").alias("run_id")).agg(
        (F.floor(F.count(F.lit(1)) * 0.8)).cast("long").alias("budget_experiments"),
        (F.floor(F.max("value")) / 8).alias("budget_usd"),
        F.floor(F.max(seconds) / 60 - F.min(seconds) / 60 - 2000).cast("long").alias("budget_minutes"),
    )


_CONFIG = """cfg AS (SELECT user_id AS run_id, CAST(floor(count(*) * 0.8) AS BIGINT) AS budget_experiments, floor(max(value)) / 8 AS budget_usd,
  CAST(floor(max(floor(epoch(ts))) / 60 - min(floor(epoch(ts))) / 60 - 2000) AS BIGINT) AS budget_minutes FROM events GROUP BY 1)"""


@query(f"""WITH {RESULT_LOG}, {_CONFIG}, s AS (SELECT l.run_id, experiment_id, row_number() OVER (PARTITION BY l.run_id ORDER BY experiment_id) AS n,
  sum(cost_usd) OVER (PARTITION BY l.run_id ORDER BY experiment_id) AS c, epoch(ts) - min(epoch(ts)) OVER (PARTITION BY l.run_id ORDER BY experiment_id) AS e,
  budget_experiments AS bn, budget_usd AS bc, budget_minutes AS bm FROM log l JOIN cfg USING (run_id)),
h AS (SELECT run_id, experiment_id, CASE WHEN n >= bn THEN printf('Experiment count limit reached: %d/%d', n, bn)
  WHEN c >= bc THEN printf('Cost cap reached: $%.2f/$%.2f', c, bc) WHEN e >= bm * 60 THEN printf('Time budget exceeded: %.1fmin/%dmin', e / 60, bm) END AS reason FROM s)
SELECT run_id, min(experiment_id) AS stopped_at, arg_min(reason, experiment_id) AS reason FROM h WHERE reason IS NOT NULL GROUP BY 1""")
def budget_stop(spark: SparkSession, d: str) -> DataFrame:
    return runlog.budget_stop(result_log(spark, d), _config(spark, d))


@query(f"""WITH {RESULT_LOG}, {_CONFIG} SELECT l.run_id, count(*) AS experiment_count, max(CASE WHEN status = 'keep' THEN metric_value END) AS best_metric,
  round(sum(cost_usd), 4) AS cost_spent_usd, count(*) FILTER (status = 'keep') AS keeps, count(*) FILTER (status = 'revert') AS reverts,
  any_value(budget_experiments) AS budget_experiments, any_value(budget_usd) AS budget_usd, any_value(budget_minutes) AS budget_minutes
  FROM log l JOIN cfg USING (run_id) GROUP BY 1""")
def live_status(spark: SparkSession, d: str) -> DataFrame:
    out = runlog.live_status(result_log(spark, d), _config(spark, d))
    return out.withColumn("cost_spent_usd", r("cost_spent_usd", 4))


_SUMMARY = f"""{RESULT_LOG}, best AS (SELECT run_id, metric_value, commit_hash FROM (SELECT *, {_first('maximize')} FROM log) WHERE rn = 1),
sm AS (SELECT run_id, count(*) AS total_experiments, count(*) FILTER (status = 'keep') AS keeps, count(*) FILTER (status = 'revert') AS reverts,
  count(*) FILTER (status = 'crash') AS crashes FROM log GROUP BY 1),
summary AS (SELECT sm.*, metric_value AS best_metric, commit_hash AS best_commit FROM sm JOIN best USING (run_id)),
advice AS (SELECT run_id, CASE WHEN keeps = 0 THEN 'No improvements found. Consider different model families or feature engineering.'
  WHEN reverts > 3 * keeps THEN 'High revert rate. Consider narrower search space or more budget.'
  ELSE 'Best approach committed at ' || coalesce(best_commit, 'unknown') || '. Consider longer budget for further improvement.' END AS recommendation FROM summary)"""


@query(f"WITH {_SUMMARY} SELECT * FROM summary")
def log_summary(spark: SparkSession, d: str) -> DataFrame:
    return runlog.log_summary(result_log(spark, d))


@query(f"WITH {_SUMMARY} SELECT * FROM advice")
def recommendation(spark: SparkSession, d: str) -> DataFrame:
    return runlog.recommendation(result_log(spark, d))


@query(f"WITH {_SUMMARY} SELECT run_id, total_experiments, keeps FROM summary")
def keep_count(spark: SparkSession, d: str) -> DataFrame:
    return runlog.keep_count(result_log(spark, d))


@query(f"""WITH {_SUMMARY} SELECT run_id, total_experiments, keeps, CASE WHEN total_experiments >= 60 AND keeps >= 10 THEN 'pass'
  WHEN total_experiments >= 60 THEN 'partial' ELSE 'fail' END AS verdict FROM summary""")
def eval_assertions(spark: SparkSession, d: str) -> DataFrame:
    return runlog.eval_assertions(result_log(spark, d), 60, 10)


@query(f"WITH {RESULT_LOG} SELECT run_id, experiment_id, metric_value FROM log WHERE metric_value IS NOT NULL ORDER BY metric_value, run_id, experiment_id LIMIT 10")
def top_by_metric(spark: SparkSession, d: str) -> DataFrame:
    return runlog.top_by_metric(result_log(spark, d), 10).select("run_id", "experiment_id", "metric_value")


def _journal(spark: SparkSession, d: str) -> DataFrame:
    rows = runlog.metric_delta(result_log(spark, d))
    long = F.repeat(F.concat(F.col("description"), F.lit(" ")), F.when(F.col("status") == "keep", 30).when(F.col("status") == "revert", 4).otherwise(1))
    return rows.select(
        "run_id", "experiment_id", long.alias("hypothesis"), "metric_value", F.round("metric_delta", 2).alias("metric_delta"), "commit_hash", "status",
        F.when(F.col("status") == "keep", long).alias("diff"),
    )


@query(f"""WITH {RESULT_LOG}, j AS (SELECT *, round(metric_value - max(CASE WHEN status = 'keep' THEN metric_value END) {_BEFORE}, 2) AS metric_delta,
  repeat(description || ' ', CASE status WHEN 'keep' THEN 30 WHEN 'revert' THEN 4 ELSE 1 END) AS hyp FROM log)
SELECT run_id, experiment_id, status, coalesce(printf('%.4f', metric_value), '-') AS metric, coalesce(printf('%+.4f', metric_delta), '-') AS delta,
  CASE WHEN length(hyp) > 60 THEN substr(hyp, 1, 57) || '...' ELSE hyp END AS hypothesis, coalesce(commit_hash, '-') AS commit,
  CASE WHEN status = 'keep' THEN CASE WHEN length(hyp) > 500 THEN substr(hyp, 1, 500) || '...' ELSE hyp END END AS diff FROM j""")
def journal_table(spark: SparkSession, d: str) -> DataFrame:
    return runlog.journal_table(_journal(spark, d))


@query(f"""WITH {_SUMMARY}, cost AS (SELECT run_id, sum(cost_usd) AS c FROM log GROUP BY 1),
rv AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY experiment_id) AS nth FROM log WHERE status = 'revert')
SELECT run_id, 'summary' AS section, CAST(0 AS BIGINT) AS position, 'Total Experiments: ' || total_experiments AS line FROM summary
UNION ALL SELECT run_id, 'summary', 1, 'Keeps: ' || keeps FROM summary UNION ALL SELECT run_id, 'summary', 2, 'Reverts: ' || reverts FROM summary
UNION ALL SELECT run_id, 'summary', 3, 'Crashes: ' || crashes FROM summary UNION ALL SELECT run_id, 'summary', 4, 'Best score: ' || best_metric FROM summary
UNION ALL SELECT run_id, 'summary', 5, 'Total Cost (USD): ' || printf('%.2f', c) FROM cost
UNION ALL SELECT run_id, 'successful', experiment_id, 'Experiment ' || experiment_id || ' (score=' || metric_value || '): ' || description FROM log WHERE status = 'keep'
UNION ALL SELECT run_id, 'failed', experiment_id, 'Experiment ' || experiment_id || ': ' || description FROM rv WHERE nth <= 10
UNION ALL SELECT run_id, 'failed_more', 0, '...and ' || (reverts - 10) || ' more' FROM summary WHERE reverts > 10
UNION ALL SELECT run_id, 'recommendation', 0, recommendation FROM advice""")
def retrospective(spark: SparkSession, d: str) -> DataFrame:
    log = result_log(spark, d)
    costs = runlog.cost_summary(log).select("run_id", F.col("total").alias("cost_spent_usd"))
    return runlog.retrospective(log, costs, "score")


# --- training curves ------------------------------------------------------------------------------------


def _curves(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("epoch"), F.col("value").alias("val_loss"), (F.col("value") % 1).alias("val_accuracy")
    )


_CURVES = "ep AS (SELECT user_id AS run_id, event_id AS epoch, value AS val_loss, value % 1 AS val_accuracy FROM events)"


@query(f"""WITH {_CURVES}, lo AS (SELECT *, coalesce(val_loss < min(val_loss) OVER (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE) AS improved FROM ep),
isl AS (SELECT *, sum(improved::INT) OVER (PARTITION BY run_id ORDER BY epoch) AS island FROM lo),
wt AS (SELECT *, row_number() OVER (PARTITION BY run_id, island ORDER BY epoch) - 1 AS waited FROM isl),
st AS (SELECT run_id, min(epoch) AS stopped_at FROM wt WHERE waited >= 5 GROUP BY 1)
SELECT run_id, max(stopped_at) AS stopped_at, max(epoch) AS best_epoch, arg_max(val_loss, epoch) AS best_val_loss, round(arg_max(val_accuracy, epoch), 6) AS best_accuracy
FROM wt LEFT JOIN st USING (run_id) WHERE improved AND (stopped_at IS NULL OR epoch < stopped_at) GROUP BY 1""")
def early_stop(spark: SparkSession, d: str) -> DataFrame:
    return training.early_stop(_curves(spark, d)).withColumn("best_accuracy", r("best_accuracy"))


@query("""SELECT l_suppkey AS run_id, l_linenumber AS epoch, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS loss,
  round(sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) / sum(l_quantity), 6) AS accuracy FROM lineitem GROUP BY 1, 2""")
def epoch_averages(spark: SparkSession, d: str) -> DataFrame:
    batches = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("run_id"), F.col("l_linenumber").alias("epoch"), F.col("l_discount").alias("loss"),
        F.when(F.col("l_returnflag") == "A", F.col("l_quantity")).otherwise(0.0).alias("correct"), F.col("l_quantity").alias("total"),
    )
    return training.epoch_averages(batches).select("run_id", "epoch", r("loss").alias("loss"), r("accuracy").alias("accuracy"))


# The scheduler's own loop as a recursion over the epochs of each run.
@query(f"""WITH RECURSIVE {_CURVES}, o AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY epoch) AS i FROM ep),
w AS (
  SELECT run_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS epoch, CAST('inf' AS DOUBLE) AS best, 0 AS bad, CAST(0 AS BIGINT) AS cuts, FALSE AS fired FROM (SELECT DISTINCT run_id FROM o)
  UNION ALL
  SELECT o.run_id, o.i, o.epoch, CASE WHEN val_loss < best * (1 - 1e-4) THEN val_loss ELSE best END,
    CASE WHEN val_loss < best * (1 - 1e-4) OR bad = 3 THEN 0 ELSE bad + 1 END,
    CASE WHEN NOT val_loss < best * (1 - 1e-4) AND bad = 3 AND 1e-3 * 0.5 ** cuts * 0.5 > 1e-8 THEN cuts + 1 ELSE cuts END,
    NOT val_loss < best * (1 - 1e-4) AND bad = 3 AND 1e-3 * 0.5 ** cuts * 0.5 > 1e-8
  FROM w JOIN o ON o.run_id = w.run_id AND o.i = w.i + 1)
SELECT run_id, epoch, cuts AS reduction, round(1e6 * 1e-3 * 0.5 ** cuts, 6) AS rate_millionths FROM w WHERE fired""")
def plateau_lr(spark: SparkSession, d: str) -> DataFrame:
    out = training.plateau_lr(_curves(spark, d))
    return out.select("run_id", "epoch", "reduction", r(F.col("learning_rate") * 1e6).alias("rate_millionths"))


# --- agents ---------------------------------------------------------------------------------------------


@query(f"""WITH {_CONFIG} SELECT run_id, CAST(agent AS INT) AS agent, round(budget_usd / 3, 6) AS budget_usd, CAST(floor(budget_minutes / 3) AS BIGINT) AS budget_minutes,
  budget_experiments // 3 AS budget_experiments FROM cfg, range(3) t(agent)""")
def budget_split(spark: SparkSession, d: str) -> DataFrame:
    return agents.budget_split(_config(spark, d), 3).withColumn("budget_usd", r("budget_usd"))


@query("""WITH s AS (SELECT user_id AS agent, max(CASE WHEN event_type = 'purchase' AND value > 100 THEN value END) AS m FROM events WHERE event_type <> 'error' GROUP BY 1),
c AS (SELECT user_id AS agent, max(CASE WHEN value > 60 THEN value END) AS m FROM events WHERE event_type = 'error' GROUP BY 1)
SELECT coalesce(s.agent, c.agent) AS agent, coalesce(s.m, c.m) AS best_metric,
  CASE WHEN s.m IS NOT NULL THEN 's' WHEN c.m IS NOT NULL THEN 'c' ELSE '' END AS best_commit,
  CASE WHEN s.m IS NOT NULL THEN 'state' WHEN c.m IS NOT NULL THEN 'checkpoint' ELSE 'none' END AS source FROM s FULL JOIN c ON s.agent = c.agent""")
def collect_agent_results(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").withColumnRenamed("user_id", "agent")
    kind, value = F.col("event_type"), F.col("value")
    side = lambda rows, when, tag: rows.groupBy("agent").agg(F.max(F.when(when, value)).alias("best_metric"), F.lit(tag).alias("best_commit"))
    states = side(events.where(kind != "error"), (kind == "purchase") & (value > 100), "s")
    return agents.collect_agent_results(states, side(events.where(kind == "error"), value > 60, "c"))


@query("""WITH c AS (SELECT user_id AS run_id, 'c' || event_id AS commit_hash, value AS claimed_metric, event_type FROM events),
v AS (SELECT run_id, commit_hash, claimed_metric + CASE event_type WHEN 'view' THEN 0.0005 ELSE 0.5 END AS verified_metric FROM c WHERE event_type <> 'error')
SELECT run_id, commit_hash, claimed_metric, round(verified_metric, 6) AS verified_metric, coalesce(abs(claimed_metric - verified_metric) < 0.001, FALSE) AS match FROM c LEFT JOIN v USING (run_id, commit_hash)""")
def verify_claims(spark: SparkSession, d: str) -> DataFrame:
    claimed = table(spark, d, "events").select(
        F.col("user_id").alias("run_id"), F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("commit_hash"), F.col("value").alias("metric_value"), "event_type"
    )
    measured = claimed.where(F.col("event_type") != "error").withColumn("metric_value", F.col("metric_value") + F.when(F.col("event_type") == "view", 0.0005).otherwise(0.5))
    return agents.verify_claims(claimed, measured).withColumn("verified_metric", r("verified_metric"))


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """Events as agents' answers: prose, a broken line, and for most a result line."""
    good = F.format_string('  {"metric_value": %s, "best_commit": "c%d"}', F.col("value").cast("string"), "event_id")
    kind = F.col("event_type")
    last = F.when(kind == "error", '{"metric_value": oops').when(kind == "view", '{"metric_value": null}').otherwise("done")
    lines = F.concat_ws("\n", F.lit("I tried things."), F.lit('{"metric_value": 1.5}'), F.when(kind != "signup", good), last)
    return table(spark, d, "events").select("event_id", "props", kind, "value", F.when(kind == "click", F.lit("no result")).otherwise(lines).alias("result"))


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN NULL WHEN 'signup' THEN 1.5 ELSE value END AS metric_value,
  CASE WHEN event_type IN ('click', 'signup') THEN '' ELSE 'c' || event_id END AS best_commit FROM events""")
def metric_from_text(spark: SparkSession, d: str) -> DataFrame:
    return agents.metric_from_text(_answers(spark, d)).select("event_id", "metric_value", "best_commit")


@query("""SELECT event_id, CASE WHEN event_type <> 'click' THEN value END AS metric_value, CASE WHEN event_type <> 'click' THEN 2.5 END AS naive_baseline,
  CASE WHEN event_type = 'view' THEN 3.5 END AS seasonal_naive_baseline, CASE WHEN event_type <> 'click' THEN value < 2.5 END AS beats_naive,
  CASE WHEN event_type = 'view' THEN value < 3.5 END AS beats_seasonal_naive FROM events""")
def tagged_line_metrics(spark: SparkSession, d: str) -> DataFrame:
    kind, value = F.col("event_type"), F.col("value").cast("string")
    plain = F.format_string('json_output: {"metric_value": %s, "naive_mape": 2.5, "beats_naive": %s}', value, (F.col("value") < 2.5).cast("string"))
    full = F.format_string(
        'json_output:{"metric_value": %s, "naive_baseline": 2.5, "naive_mape": 9, "seasonal_naive_baseline": 3.5, "beats_naive": %s, "beats_seasonal_naive": %s}',
        value, (F.col("value") < 2.5).cast("string"), (F.col("value") < 3.5).cast("string"),
    )
    text = F.concat_ws("\n", F.lit("epoch 1"), F.lit('json_output: {"metric_value": 77}'), F.when(kind == "view", full).otherwise(plain), F.lit("bye"))
    logs = table(spark, d, "events").select("event_id", F.when(kind == "click", F.lit("nothing here")).otherwise(text).alias("log_text"))
    return agents.tagged_line_metrics(logs).drop("log_text")


@query("""SELECT event_id, CASE WHEN event_type <> 'error' THEN event_type END AS stop_reason, CASE WHEN event_type NOT IN ('error', 'view') THEN CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) END AS num_turns,
  CASE WHEN event_type <> 'error' THEN value END AS total_cost_usd, CASE WHEN event_type <> 'error' THEN value > 50 END AS is_error FROM events""")
def parse_run_envelope(spark: SparkSession, d: str) -> DataFrame:
    turns = F.when(F.col("event_type") != "view", F.regexp_extract("props", r"(\d+)", 1).cast("int"))
    body = F.to_json(F.struct(F.col("event_type").alias("stop_reason"), turns.alias("num_turns"), F.col("value").alias("total_cost_usd"), (F.col("value") > 50).alias("is_error")))
    texts = table(spark, d, "events").select("event_id", F.when(F.col("event_type") == "error", "{broken").otherwise(body).alias("value"))
    return agents.parse_run_envelope(texts).drop("value", "result")


_SOME_CURVES = _CURVES.replace("value AS val_loss", "CASE WHEN user_id % 4 > 0 THEN value END AS val_loss")


@query(f"""WITH {_SOME_CURVES}, lo AS (SELECT *, coalesce(val_loss < coalesce(min(val_loss) OVER (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'inf'::DOUBLE), FALSE) AS improved FROM ep),
isl AS (SELECT *, sum(improved::INT) OVER (PARTITION BY run_id ORDER BY epoch) AS island FROM lo),
wt AS (SELECT *, sum((NOT improved)::INT) OVER (PARTITION BY run_id, island ORDER BY epoch) AS waited FROM isl),
st AS (SELECT run_id, min(CASE WHEN waited >= 5 THEN epoch END) AS stopped_at FROM wt GROUP BY 1),
b AS (SELECT run_id, max(epoch) AS best_epoch, arg_max(val_loss, epoch) AS best_val_loss FROM wt JOIN st USING (run_id) WHERE improved AND (stopped_at IS NULL OR epoch < stopped_at) GROUP BY 1)
SELECT run_id, stopped_at, best_epoch, best_val_loss FROM st LEFT JOIN b USING (run_id)""")
def early_stop_without_losses(spark: SparkSession, d: str) -> DataFrame:
    """Some runs have no loss at all."""
    curves = _curves(spark, d).withColumn("val_loss", F.when(F.col("run_id") % 4 > 0, F.col("val_loss")))
    return training.early_stop(curves).select("run_id", "stopped_at", "best_epoch", "best_val_loss")


@query(f"""WITH {RESULT_LOG} SELECT run_id % 3 AS run_id, experiment_id, round(sum(cost_usd) OVER w, 4) AS cost, max(metric_value) OVER w AS best,
  count(*) OVER (PARTITION BY run_id % 3 ORDER BY experiment_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier
FROM log WINDOW w AS (PARTITION BY run_id % 3 ORDER BY experiment_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def running_in_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Running values of three long runs, cut into chunks of 64 ids."""
    log = result_log(spark, d).select((F.col("run_id") % 3).alias("run_id"), "experiment_id", "cost_usd", "metric_value")
    measures = [Running("cost", "sum", F.col("cost_usd")), Running("best", "max", F.col("metric_value")), Running("earlier", "count", F.lit(True), before=True)]
    out = running(log, ["run_id"], "experiment_id", measures, F.shiftright("experiment_id", 6))
    return out.select("run_id", "experiment_id", r("cost", 4).alias("cost"), "best", "earlier")


@query(f"""WITH {RESULT_LOG} SELECT run_id % 3 AS run_id, experiment_id, round(sum(cost_usd) OVER w, 4) AS cost, max(metric_value) OVER w AS best,
  count(*) OVER (PARTITION BY run_id % 3 ORDER BY ts, experiment_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier
FROM log WINDOW w AS (PARTITION BY run_id % 3 ORDER BY ts, experiment_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def running_by_time(spark: SparkSession, d: str) -> DataFrame:
    """Running values of three long runs in the order of their time stamps, as hot keys from 500 rows on, in chunks of 200 rows at most."""
    log = result_log(spark, d).select((F.col("run_id") % 3).alias("run_id"), "experiment_id", "cost_usd", "metric_value", F.struct("timestamp", "experiment_id").alias("at"))
    measures = [Running("cost", "sum", F.col("cost_usd")), Running("best", "max", F.col("metric_value")), Running("earlier", "count", F.lit(True), before=True)]
    out = running(log, ["run_id"], "at", measures, hot=hot_keys(log, ["run_id"], 500), chunk_rows=200)
    return out.select("run_id", "experiment_id", r("cost", 4).alias("cost"), "best", "earlier")


@query("SELECT event_id, count(*) OVER (ORDER BY ts, event_id) AS position, max(value) OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM events")
def running_in_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Running values of the whole table in ranges of 1,000 rows."""
    events = table(spark, d, "events").select("event_id", "value", F.struct("ts", "event_id").alias("at"))
    measures = [Running("position", "count", F.lit(True)), Running("best_before", "max", F.col("value"), before=True)]
    return running_global(events, "at", measures, chunk_rows=1_000).select("event_id", "position", "best_before")


@query(f"WITH {RESULT_LOG} SELECT time_bucket(INTERVAL 1 DAY, ts) AS started, status, count(*) AS n, count(DISTINCT run_id) AS runs, max(metric_value) AS best FROM log GROUP BY 1, 2")
def results_per_window(spark: SparkSession, d: str) -> DataFrame:
    return runlog.results_per_window(result_log(spark, d), "1 day")
