"""Results of several agents working on one experiment: budgets, collected results, checked claims, output texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runsight.operators.runlog import CLAIM_TOLERANCE

# Names under which a result line may carry its baselines.
RESULT_TAG = "json_output:"
NAIVE_KEYS = ("naive_baseline", "naive_mape")
SEASONAL_KEYS = ("seasonal_naive_baseline", "seasonal_naive_mape")


def budget_split(config: DataFrame, agents: int | Column) -> DataFrame:
    """Equal share of every run's budget per agent; whole minutes and experiments, the rest is not handed out.

    Config: run_id, budget_usd, budget_minutes, budget_experiments.
    """
    n = F.lit(agents) if isinstance(agents, int) else agents
    return config.select(
        "run_id",
        F.explode(F.sequence(F.lit(0), n - 1)).alias("agent"),
        (F.col("budget_usd") / n).alias("budget_usd"),
        F.floor(F.col("budget_minutes") / n).cast("long").alias("budget_minutes"),
        F.floor(F.col("budget_experiments") / n).cast("long").alias("budget_experiments"),
    )


def collect_agent_results(states: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Best metric and commit per agent: from its state if that has a metric, else from its checkpoint.

    Both inputs: agent, best_metric, best_commit.
    """
    side = lambda df, p: df.select("agent", F.col("best_metric").cast("double").alias(f"{p}_metric"), F.col("best_commit").alias(f"{p}_commit"))
    both = side(states, "s").join(side(checkpoints, "c"), "agent", "full_outer")
    metric = F.coalesce("s_metric", "c_metric")
    commit = F.when(F.col("s_metric").isNotNull(), F.col("s_commit")).when(F.col("c_metric").isNotNull(), F.col("c_commit"))
    source = F.when(F.col("s_metric").isNotNull(), "state").when(F.col("c_metric").isNotNull(), "checkpoint").otherwise("none")
    return both.select("agent", metric.alias("best_metric"), F.coalesce(commit, F.lit("")).alias("best_commit"), source.alias("source"))


def verify_claims(claimed: DataFrame, verified: DataFrame, tolerance: float = CLAIM_TOLERANCE) -> DataFrame:
    """Claimed against measured metric per (run_id, commit_hash); nothing measured is no match."""
    both = claimed.select("run_id", "commit_hash", F.col("metric_value").alias("claimed_metric")).join(
        verified.select("run_id", "commit_hash", F.col("metric_value").alias("verified_metric")), ["run_id", "commit_hash"], "left"
    )
    close = F.abs(F.col("claimed_metric") - F.col("verified_metric")) < F.lit(tolerance)
    return both.withColumn("match", F.coalesce(close, F.lit(False)))


def parse_run_envelope(df: DataFrame, text: str = "value") -> DataFrame:
    """Key facts of a run's JSON envelope; absent or unreadable ones are NULL."""
    schema = "stop_reason string, num_turns long, total_cost_usd double, is_error boolean, result string"
    return df.withColumn("_e", F.from_json(F.col(text), schema)).select(*df.columns, "_e.*")


def _last(lines: Column) -> Column:
    return F.try_element_at(lines, F.lit(-1))


def metric_from_text(df: DataFrame, text: str = "result") -> DataFrame:
    """Metric and commit from the last line of an agent's answer that is a JSON object with a metric."""
    trimmed = F.transform(F.split(F.col(text), r"\r\n|\r|\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    lines = F.filter(trimmed, lambda x: x.startswith("{") & x.contains("metric_value"))
    parsed = F.transform(lines, lambda x: F.from_json(x, "metric_value string, best_commit string"))
    usable = F.filter(parsed, lambda x: x["metric_value"].try_cast("double").isNotNull())
    with_last = df.withColumn("_m", _last(usable))
    return with_last.select(
        *df.columns,
        F.col("_m.metric_value").try_cast("double").alias("metric_value"),
        F.coalesce("_m.best_commit", F.lit("")).alias("best_commit"),
    )


def tagged_line_metrics(df: DataFrame, text: str = "log_text", tag: str = RESULT_TAG) -> DataFrame:
    """Metric, baselines and flags from the last tagged line of a run's log."""
    keys = ["metric_value", *NAIVE_KEYS, *SEASONAL_KEYS]
    schema = ", ".join(f"{k} double" for k in keys) + ", beats_naive boolean, beats_seasonal_naive boolean"
    line = _last(F.filter(F.split(F.col(text), r"\r\n|\r|\n"), lambda x: x.startswith(tag)))
    body = F.from_json(F.trim(F.substring(line, len(tag) + 1, 2_147_483_647)), schema)
    found = df.withColumn("_m", body)
    first = lambda names: F.coalesce(*[F.col(f"_m.{n}") for n in names])
    return found.select(
        *df.columns,
        F.col("_m.metric_value").alias("metric_value"),
        first(NAIVE_KEYS).alias("naive_baseline"),
        first(SEASONAL_KEYS).alias("seasonal_naive_baseline"),
        F.col("_m.beats_naive").alias("beats_naive"),
        F.col("_m.beats_seasonal_naive").alias("beats_seasonal_naive"),
    )
