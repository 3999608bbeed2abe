"""Experiment logs of many runs: best so far, keep or revert, streaks, budgets, summaries.

A log has one row per experiment: ``run_id``, a whole-number ``experiment_id`` unique within
the run and rising in time, and ``metric_value``. Per-run totals are plain aggregates (combined
on the map side); everything that depends on earlier rows uses chunked running aggregates, so a
run may hold any share of the log.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runsight.functions.values import better, check_direction, fixed, is_finite, shorten
from runsight.plans.running import Running, between, hot_keys, running, since_reset
from runsight.plans.sizing import broadcast_if_small
from runsight.session import materialize

RUN = "run_id"
ORDER = "experiment_id"
#: Rows of a run that may be a stagnation event and are gone through as one list.
FOLDED = 1024

# Limits and texts whose effect on results is part of the behaviour.
MAX_RETRIES = 2
STAGNATION_THRESHOLD = 3
OUT_OF_MEMORY_MARKS = ("MemoryError", "OOM")
CLAIM_TOLERANCE = 0.001
HYPOTHESIS_LIMIT, HYPOTHESIS_KEEP = 60, 57
DIFF_LIMIT = 500
LISTED_REVERTS = 10
NO_IMPROVEMENT = "No improvements found. Consider different model families or feature engineering."
HIGH_REVERT_RATE = "High revert rate. Consider narrower search space or more budget."
BEST_AT = "Best approach committed at %s. Consider longer budget for further improvement."


def _number(metric: str) -> Column:
    return F.nanvl(F.col(metric).cast("double"), F.lit(None))


def _first_best(columns: list[str], metric: str, order: str, direction: str) -> Column:
    """Aggregate: struct of ``columns`` from the best row, the earliest of equals."""
    value, row = _number(metric), F.struct(*columns)
    if check_direction(direction) == "maximize":
        return F.max_by(row, F.when(value.isNotNull(), F.struct(value, -F.col(order))))
    return F.min_by(row, F.when(value.isNotNull(), F.struct(value, F.col(order))))


# --- filters -----------------------------------------------------------------------------


def filter_status(log: DataFrame, status: str) -> DataFrame:
    return log.where(F.col("status") == status)


def filter_valid_metric(log: DataFrame, metric: str = "metric_value") -> DataFrame:
    return log.where(is_finite(F.col(metric)))


# --- per-run totals -------------------------------------------------------------------------


def best_result(log: DataFrame, direction: str = "maximize", by: list[str] | None = None) -> DataFrame:
    """Whole best row per run; runs without any metric give no row."""
    by = [RUN] if by is None else by
    rest = [c for c in log.columns if c not in by]
    best = log.groupBy(*by).agg(_first_best(rest, "metric_value", ORDER, direction).alias("_best"))
    return best.where(F.col("_best").isNotNull()).select(*by, "_best.*")


def best_draft(drafts: DataFrame, direction: str = "maximize") -> DataFrame:
    """Best draft per run. Drafts: run_id, position, name, metric_value, status, commit_hash."""
    return best_result(drafts.withColumnRenamed("position", ORDER), direction).withColumnRenamed(ORDER, "position")


def scoreboard_best(board: DataFrame, direction: str = "maximize", by: list[str] | None = None) -> DataFrame:
    """Best (metric, agent) per board. Board rows: position, agent, metric_value."""
    best = _first_best(["metric_value", "agent"], "metric_value", "position", direction).alias("_best")
    grouped = board.groupBy(*(by or [])).agg(best)
    return grouped.select(*(by or []), F.col("_best.metric_value").alias("best_metric"), F.col("_best.agent").alias("best_agent"))


def cost_summary(log: DataFrame, cost: str = "cost_usd", by: list[str] | None = None) -> DataFrame:
    c = F.col(cost)
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return log.groupBy(*([RUN] if by is None else by)).agg(
        zero(F.sum(c)).alias("total"),
        F.count(c).alias("count"),
        zero(F.avg(c)).alias("avg"),
        zero(F.min(c)).alias("min"),
        zero(F.max(c)).alias("max"),
    )


def log_summary(log: DataFrame, direction: str = "maximize") -> DataFrame:
    """Counts per status and the best row, reverted rows included."""
    best = _first_best(["metric_value", "commit_hash"], "metric_value", ORDER, direction)
    return (
        log.groupBy(RUN)
        .agg(
            F.count(F.lit(1)).alias("total_experiments"),
            F.count_if(F.col("status") == "keep").alias("keeps"),
            F.count_if(F.col("status") == "revert").alias("reverts"),
            F.count_if(F.col("status") == "crash").alias("crashes"),
            best.alias("_best"),
        )
        .select("*", F.col("_best.metric_value").alias("best_metric"), F.col("_best.commit_hash").alias("best_commit"))
        .drop("_best")
    )


def keep_count(log: DataFrame) -> DataFrame:
    """Rows kept in the loop or in the draft phase."""
    return log.groupBy(RUN).agg(
        F.count(F.lit(1)).alias("total_experiments"), F.count_if(F.col("status").contains("keep")).alias("keeps")
    )


def recommendation(log: DataFrame, direction: str = "maximize") -> DataFrame:
    return _advice(log_summary(log, direction))


def _advice(summary: DataFrame) -> DataFrame:
    commit = F.when(F.col("best_commit").isNull() | (F.col("best_commit") == ""), "unknown").otherwise(F.col("best_commit"))
    return summary.select(
        RUN,
        F.when(F.col("keeps") == 0, F.lit(NO_IMPROVEMENT))
        .when(F.col("reverts") > F.col("keeps") * 3, F.lit(HIGH_REVERT_RATE))
        .otherwise(F.format_string(BEST_AT, commit))
        .alias("recommendation"),
    )


def eval_assertions(log: DataFrame, min_experiments: int = 5, min_keeps: int = 1) -> DataFrame:
    enough = F.col("total_experiments") >= min_experiments
    return keep_count(log).withColumn(
        "verdict",
        F.when(enough & (F.col("keeps") >= min_keeps), "pass").when(enough, "partial").otherwise("fail"),
    )


def top_by_metric(log: DataFrame, n: int, direction: str = "minimize") -> DataFrame:
    metric = F.col("metric_value")
    first = metric.asc() if check_direction(direction) == "minimize" else metric.desc()
    return log.where(_number("metric_value").isNotNull()).orderBy(first, F.col(RUN), F.col(ORDER)).limit(n)


def live_status(log: DataFrame, config: DataFrame, direction: str = "maximize") -> DataFrame:
    """Progress per run next to its budget. Config: run_id, budget_experiments, budget_usd."""
    status = log.groupBy(RUN).agg(
        F.count(F.lit(1)).alias("experiment_count"),
        _kept(direction).alias("best_metric"),
        F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_spent_usd"),
        F.count_if(F.col("status") == "keep").alias("keeps"),
        F.count_if(F.col("status") == "revert").alias("reverts"),
    )
    return status.join(config, RUN, "left")


def _kept(direction: str) -> Column:
    kept = F.when(F.col("status") == "keep", _number("metric_value"))
    return F.max(kept) if check_direction(direction) == "maximize" else F.min(kept)


# --- rows that depend on earlier rows -------------------------------------------------------


def running_best(log: DataFrame, direction: str = "maximize", key: str = RUN, order: str = ORDER) -> DataFrame:
    """Best metric before and after each experiment."""
    how = "max" if check_direction(direction) == "maximize" else "min"
    return running(
        log,
        [key],
        order,
        [
            Running("best_before", how, _number("metric_value"), before=True),
            Running("best_after", how, _number("metric_value")),
        ],
    )


def new_global_best(board: DataFrame, direction: str = "maximize", key: str = RUN, order: str = "position") -> DataFrame:
    """Per published row: strictly better than all earlier rows of its board; the first is."""
    how = "max" if check_direction(direction) == "maximize" else "min"
    out = running(board, [key], order, [Running("best_before", how, _number("metric_value"), before=True)])
    first = F.col("best_before").isNull()
    return out.withColumn("is_new_best", first | better(F.col("metric_value"), F.col("best_before"), direction))


def metric_delta(log: DataFrame, direction: str = "maximize") -> DataFrame:
    """Change against the best kept before; NULL where either side is missing."""
    kept = F.when(F.col("status") == "keep", _number("metric_value"))
    how = "max" if check_direction(direction) == "maximize" else "min"
    out = running(log, [RUN], ORDER, [Running("best_before", how, kept, before=True)])
    return out.withColumn("metric_delta", F.col("metric_value") - F.col("best_before"))


def cumulative_cost(log: DataFrame, cost: str = "cost_usd") -> DataFrame:
    return running(log, [RUN], ORDER, [Running("cost_so_far", "sum", F.col(cost))])


def is_out_of_memory(status: Column, error: Column) -> Column:
    marked = F.lit(False)
    for mark in OUT_OF_MEMORY_MARKS:
        marked = marked | F.coalesce(error.contains(mark), F.lit(False))
    return (status == "crash") & marked


def decide(attempts: DataFrame, direction: str = "maximize", max_retries: int = MAX_RETRIES) -> DataFrame:
    """Replay the loop's decision for every attempt of every run.

    Attempts: run_id, experiment_id, status ('ok', 'crash', 'timeout'), error, metric_value and
    optionally ``passes_gate`` (see ``baselines.baseline_gate``) and ``seed`` (best draft metric
    of the run). Gives run_id, experiment_id, status, metric_value, best_before, improved,
    out_of_memory_count, action ('keep', 'revert', 'retry', 'stop') and gated (an improvement turned
    down by the gate). Rows after a stop are dropped. Error texts are read once and not carried along.

    Only rows that pass the gate can become the best, and a row that passes but does not improve
    cannot raise it, so the running best of passing rows is the best the loop held.
    The out-of-memory counter restarts at each improvement, also one the gate then turns down.
    """
    how = "max" if check_direction(direction) == "maximize" else "min"
    gate = F.col("passes_gate") if "passes_gate" in attempts.columns else F.lit(True)
    seed = F.col("seed").cast("double") if "seed" in attempts.columns else F.lit(None).cast("double")
    ran = ~F.col("status").isin("crash", "timeout") & is_finite(F.col("metric_value"))
    narrow = attempts.select(
        RUN,
        ORDER,
        "status",
        F.col("metric_value").cast("double").alias("metric_value"),
        F.coalesce(ran, F.lit(False)).alias("_ran"),
        gate.alias("_gate"),
        seed.alias("_seed"),
        F.coalesce(is_out_of_memory(F.col("status"), F.col("error")), F.lit(False)).alias("_oom"),
    )
    hot = hot_keys(narrow, [RUN])
    eligible = F.when(F.col("_ran") & F.col("_gate"), F.col("metric_value"))
    best = running(narrow, [RUN], ORDER, [Running("best_before", how, eligible, before=True)], hot=hot)
    best = best.withColumn("best_before", (F.greatest if how == "max" else F.least)("best_before", "_seed"))
    improves = F.col("best_before").isNull() | better(F.col("metric_value"), F.col("best_before"), direction)
    best = between(best.withColumn("improved", F.coalesce(F.col("_ran") & improves, F.lit(False))).drop("_ran", "_seed"), hot)

    counted = since_reset(best, [RUN], ORDER, "out_of_memory_count", F.col("_oom").cast("int"), F.col("improved"), hot=hot)
    action = (
        F.when(F.col("_oom") & (F.col("out_of_memory_count") > max_retries), "stop")
        .when(F.col("_oom"), "retry")
        .when(F.col("improved") & F.col("_gate"), "keep")
        .otherwise("revert")
    )
    gated = F.col("improved") & ~F.col("_gate")
    acted = between(counted.select("*", action.alias("action"), gated.alias("gated")).drop("_oom", "_gate"), hot)
    stopped = F.when(F.col("action") == "stop", F.lit(1)).otherwise(F.lit(0))
    marked = running(acted, [RUN], ORDER, [Running("_stopped", "sum", stopped, before=True)], hot=hot)
    return marked.where(F.col("_stopped") == 0).drop("_stopped")


def results_per_window(log: DataFrame, width: str) -> DataFrame:
    """(started, status, n, runs, best): experiments of all runs per time window and status."""
    window = F.window("timestamp", width)
    counted = log.groupBy(window.alias("w"), "status").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct(RUN).alias("runs"), F.max(F.when(is_finite(F.col("metric_value")), F.col("metric_value"))).alias("best")
    )
    return counted.select(F.col("w.start").alias("started"), "status", "n", "runs", "best")


def classify_outcome(attempts: DataFrame, direction: str = "maximize") -> DataFrame:
    """Action of the loop for every attempt before the gate has its say."""
    without_gate = attempts.drop("passes_gate") if "passes_gate" in attempts.columns else attempts
    return decide(without_gate, direction).drop("gated")


def retry_limit(attempts: DataFrame, direction: str = "maximize", max_retries: int = MAX_RETRIES) -> DataFrame:
    """Runs that stopped on repeated out-of-memory crashes, and where."""
    decided = decide(attempts, direction, max_retries)
    return decided.where(F.col("action") == "stop").select(RUN, F.col(ORDER).alias("stopped_at"), "out_of_memory_count")


def consecutive_reverts(log: DataFrame) -> DataFrame:
    """Length of the revert streak each row stands in: (run_id, experiment_id, consecutive_reverts)."""
    revert = F.col("status").contains("revert")
    narrow = log.select(RUN, ORDER, F.coalesce(revert, F.lit(False)).alias("_revert"))
    counted = since_reset(narrow, [RUN], ORDER, "consecutive_reverts", F.col("_revert").cast("int"), ~F.col("_revert"))
    return counted.drop("_revert")


def max_revert_streak(log: DataFrame) -> DataFrame:
    return consecutive_reverts(log).groupBy(RUN).agg(F.max("consecutive_reverts").alias("max_streak"))


def stagnated(log: DataFrame, threshold: int = STAGNATION_THRESHOLD) -> DataFrame:
    return consecutive_reverts(log).withColumn("is_stagnated", F.col("consecutive_reverts") >= threshold)


def stagnation_events(
    decided: DataFrame, families: list[str], threshold: int = STAGNATION_THRESHOLD, seeded: bool = False
) -> DataFrame:
    """Where each run branches to its next untried family: (run_id, experiment_id, family).

    ``decided`` comes from ``decide``; ``families`` are the untried ones in catalogue order. A revert by the
    gate lengthens the streak without being checked, and without a kept commit there is no event. An event restarts the streak, so
    which row is one depends on the one before. Runs with up to ``FOLDED`` rows that may be an event are one list each, gone through once; for longer ones the chain of resets is as many
    rounds of one aggregate as there are families.
    """
    revert, keep = F.col("action") == "revert", F.col("action") == "keep"
    steps = decided.where(F.col("action").isin("keep", "revert")).select(RUN, ORDER, "action", "gated")
    hot = hot_keys(steps, [RUN])
    streaks = since_reset(steps, [RUN], ORDER, "streak", revert.cast("int"), keep, total="reverts", hot=hot)
    # A streak that starts before the first keep has nothing to branch from.
    kept = Running("kept", "sum", F.when(keep, F.lit(1)).otherwise(F.lit(0)))
    ready = running(between(streaks, hot), [RUN], ORDER, [kept], hot=hot).where(
        revert & ~F.col("gated") & (F.col("streak") >= threshold) & (F.lit(seeded) | (F.col("kept") > 0))
    )
    ready = materialize(ready.select(RUN, ORDER, "streak", "reverts"))
    long = materialize(ready.groupBy(RUN).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > FOLDED).select(RUN))
    if long.isEmpty():
        return _folded_events(ready, families, threshold)
    some = broadcast_if_small(long, stored=True)
    return _folded_events(ready.join(some, RUN, "left_anti"), families, threshold).unionByName(_chained_events(ready.join(some, RUN, "left_semi"), families, threshold))


def _folded_events(ready: DataFrame, families: list[str], threshold: int) -> DataFrame:
    lists = ready.groupBy(RUN).agg(F.array_sort(F.collect_list(F.struct(ORDER, "streak", "reverts"))).alias("_rows"))
    start = F.struct(F.lit(None).cast("long").alias("at"), F.array().cast("array<bigint>").alias("events"))

    def step(state: Column, row: Column) -> Column:
        since = F.least(row["streak"], row["reverts"] - F.coalesce(state["at"], F.lit(0)))
        event = (F.size(state["events"]) < len(families)) & (state["at"].isNull() | (since >= threshold))
        return F.when(event, F.struct(row["reverts"].alias("at"), F.concat(state["events"], F.array(row[ORDER].cast("long"))).alias("events"))).otherwise(state)

    events = lists.select(RUN, F.posexplode(F.aggregate("_rows", start, step)["events"]).alias("_k", ORDER))
    return events.select(RUN, ORDER, F.get(F.array(*[F.lit(f) for f in families]), F.col("_k")).alias("family"))


def _chained_events(ready: DataFrame, families: list[str], threshold: int) -> DataFrame:
    first = F.min_by(F.struct(ORDER, "reverts"), F.col(ORDER)).alias("_e")
    events, last = [], None
    for family in families:
        left = ready
        if last is not None:
            since = F.least(F.col("streak"), F.col("reverts") - F.col("_at"))
            left = ready.join(last, RUN).where((F.col(ORDER) > F.col("_id")) & (since >= threshold))
        found = left.groupBy(RUN).agg(first).select(RUN, F.col(f"_e.{ORDER}").alias("_id"), F.col("_e.reverts").alias("_at"))
        last = broadcast_if_small(found)
        events.append(last.select(RUN, F.col("_id").cast("long").alias(ORDER), F.lit(family).alias("family")))
    return reduce(DataFrame.unionByName, events)


def budget_stop(log: DataFrame, config: DataFrame) -> DataFrame:
    """First experiment after which a budget is used up, and why.

    Log: cost_usd and timestamp. Config: run_id, budget_experiments, budget_usd, budget_minutes.
    """
    seen = running(
        log.select(RUN, ORDER, "cost_usd", "timestamp"),
        [RUN],
        ORDER,
        [
            Running("count", "count", F.lit(True)),
            Running("cost", "sum", F.col("cost_usd")),
            Running("started", "min", F.col("timestamp")),
        ],
    ).join(broadcast_if_small(config), RUN)
    elapsed = F.col("timestamp").cast("double") - F.col("started").cast("double")
    spent, allowed = fixed(F.col("cost"), 2), fixed(F.col("budget_usd"), 2)
    reason = (
        F.when(
            F.col("count") >= F.col("budget_experiments"),
            F.format_string("Experiment count limit reached: %d/%d", "count", "budget_experiments"),
        )
        .when(F.col("cost") >= F.col("budget_usd"), F.format_string("Cost cap reached: $%s/$%s", spent, allowed))
        .when(
            elapsed >= F.col("budget_minutes") * 60,
            F.format_string("Time budget exceeded: %smin/%dmin", fixed(elapsed / 60, 1), "budget_minutes"),
        )
    )
    hit = seen.withColumn("reason", reason).where(F.col("reason").isNotNull())
    return hit.groupBy(RUN).agg(F.min(ORDER).alias("stopped_at"), F.min_by("reason", ORDER).alias("reason"))


# --- reports ---------------------------------------------------------------------------------


def journal_table(journal: DataFrame) -> DataFrame:
    """Journal rows as the texts of the report table."""
    commit = F.when(F.col("commit_hash").isNull() | (F.col("commit_hash") == ""), "-").otherwise(F.col("commit_hash"))
    diff = F.when(F.length("diff") > 0, shorten(F.col("diff"), DIFF_LIMIT, DIFF_LIMIT))
    return journal.select(
        RUN,
        ORDER,
        F.coalesce("status", F.lit("?")).alias("status"),
        fixed(F.col("metric_value"), 4).alias("metric"),
        fixed(F.col("metric_delta"), 4, signed=True).alias("delta"),
        shorten(F.coalesce("hypothesis", F.lit("")), HYPOTHESIS_LIMIT, HYPOTHESIS_KEEP).alias("hypothesis"),
        commit.alias("commit"),
        diff.alias("diff"),
    )


def retrospective(log: DataFrame, costs: DataFrame, metric: str = "metric", direction: str = "maximize") -> DataFrame:
    """Report lines per run: (run_id, section, position, line). Costs: run_id, cost_spent_usd.

    The kept list stays one row per line, so a run with very many keeps is never gathered.
    """
    head = materialize(log_summary(log, direction).join(costs, RUN, "left"))  # one row per run, used three times
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("N/A"))
    facts = [
        ("Total Experiments", text("total_experiments")),
        ("Keeps", text("keeps")),
        ("Reverts", text("reverts")),
        ("Crashes", text("crashes")),
        (f"Best {metric}", text("best_metric")),
        ("Total Cost (USD)", fixed(F.coalesce("cost_spent_usd", F.lit(0.0)), 2)),
    ]
    entries = [
        F.struct(F.lit(i).cast("long").alias("position"), F.concat(F.lit(f"{name}: "), value).alias("line"))
        for i, (name, value) in enumerate(facts)
    ]
    line = lambda section, position, body: (F.lit(section).alias("section"), position.alias("position"), body.alias("line"))
    summary = head.select(RUN, F.lit("summary").alias("section"), F.inline(F.array(*entries)))

    title = F.concat(F.lit("Experiment "), F.col(ORDER).cast("string"))
    described = F.coalesce("description", F.lit(""))
    value = F.concat(F.lit(f" ({metric}="), F.coalesce(F.col("metric_value").cast("string"), F.lit("N/A")), F.lit("): "))
    keeps = filter_status(log, "keep").select(RUN, *line("successful", F.col(ORDER), F.concat(title, value, described)))

    reverted = filter_status(log, "revert")
    nth = F.row_number().over(Window.partitionBy(RUN).orderBy(ORDER))
    first = reverted.withColumn("_nth", nth).where(F.col("_nth") <= LISTED_REVERTS)
    listed = first.select(RUN, *line("failed", F.col(ORDER), F.concat(title, F.lit(": "), described)))
    more = head.where(F.col("reverts") > LISTED_REVERTS).select(
        RUN,
        *line(
            "failed_more",
            F.lit(0).cast("long"),
            F.format_string("...and %d more", F.col("reverts") - LISTED_REVERTS),
        ),
    )
    advice = _advice(head).select(RUN, *line("recommendation", F.lit(0).cast("long"), F.col("recommendation")))
    return summary.unionByName(keeps).unionByName(listed).unionByName(more).unionByName(advice)
