import random

import pytest
from pyspark.sql import functions as F

from runsight.operators import agents, runlog, training
from runsight.operators.baselines import baseline_gate

from .conftest import rows


def _log(spark, metrics, statuses=None):
    statuses = statuses or ["keep"] * len(metrics)
    data = [("r", i + 1, f"c{i + 1}", m, s, f"d{i + 1}") for i, (m, s) in enumerate(zip(metrics, statuses))]
    return spark.createDataFrame(data, "run_id string, experiment_id long, commit_hash string, metric_value double, status string, description string")


@pytest.mark.parametrize("metrics, direction, best", [([0.8, 0.95, 0.9], "maximize", 2), ([0.8, 0.3, 0.5], "minimize", 2), ([0.5, 0.5], "maximize", 1), ([None, None], "maximize", None)])
def test_best_of_log(spark, metrics, direction, best):
    found = [r["experiment_id"] for r in runlog.best_result(_log(spark, metrics), direction).collect()]
    assert found == ([] if best is None else [best])


def test_best_ignores_nan(spark):
    assert runlog.best_result(_log(spark, [float("nan"), 0.4])).first()["experiment_id"] == 2


def test_log_summary_counts_reverted_rows_as_best(spark):
    log = _log(spark, [0.7, 0.8, None, 0.9], ["keep", "keep", "crash", "revert"])
    r = runlog.log_summary(log).first()
    assert (r["total_experiments"], r["keeps"], r["reverts"], r["crashes"], r["best_metric"]) == (4, 2, 1, 1, 0.9)


@pytest.mark.parametrize("values, direction, flags", [([0.85, 0.9], "maximize", [True, True]), ([0.9, 0.8], "maximize", [True, False]), ([0.85, 0.9], "minimize", [True, False]), ([0.9, 0.8], "minimize", [True, True])])
def test_new_global_best(spark, values, direction, flags):
    board = spark.createDataFrame([("b", i, v) for i, v in enumerate(values)], "run_id string, position long, metric_value double")
    assert [r[1] for r in rows(runlog.new_global_best(board, direction), "position", "is_new_best")] == flags


def _attempts(spark, data):
    return spark.createDataFrame(data, "run_id int, experiment_id long, status string, error string, metric_value double")


@pytest.mark.parametrize(
    "status, error, metric, action",
    [
        ("ok", None, 0.9, "keep"), ("crash", "CUDA OOM", None, "retry"), ("crash", "MemoryError: x", None, "retry"), ("crash", "boom", None, "revert"), ("crash", None, None, "revert"),
        ("timeout", None, 0.9, "revert"), ("ok", None, None, "revert"), ("ok", None, float("nan"), "revert"), ("ok", None, float("inf"), "revert"),
    ],
)
def test_outcome_routing(spark, status, error, metric, action):
    assert runlog.classify_outcome(_attempts(spark, [(1, 1, status, error, metric)])).first()["action"] == action


def naive_loop(attempts, direction, bar, families, threshold=3, seed=None):
    """The decision loop of one run, step by step."""
    better = (lambda a, b: a > b) if direction == "maximize" else (lambda a, b: a < b)
    best, commit, streak, errors, tried, out, events = seed, seed is not None, 0, 0, 0, [], []
    for number, status, error, metric in attempts:
        if status == "crash" and error and ("OOM" in error or "MemoryError" in error):
            errors += 1
            out.append((number, "stop" if errors > 2 else "retry"))
            if errors > 2:
                break
            continue
        valid = status == "ok" and metric is not None and metric == metric and abs(metric) != float("inf")
        if valid and (best is None or better(metric, best)):
            errors = 0
            if bar is not None and not better(metric, bar):
                streak += 1
                out.append((number, "revert"))
                continue
            best, commit, streak = metric, True, 0
            out.append((number, "keep"))
            continue
        streak += 1
        out.append((number, "revert"))
        if streak >= threshold and commit and tried < len(families):
            events.append((number, families[tried]))
            tried, streak = tried + 1, 0
    return out, events


def random_attempts(seed, runs=40, length=60):
    draw = random.Random(seed)
    data = []
    for run in range(runs):
        top, number = 0.0, 0
        for _ in range(draw.randint(1, length)):
            number += draw.randint(1, 3)
            status = draw.choices(["ok", "crash", "timeout"], [8, 3, 1])[0]
            top += draw.random() * 0.05
            metric = draw.choice([None, float("nan"), float("inf"), top, top, draw.random(), draw.random(), draw.random()])
            data.append((run, number, status, draw.choice(["OOM", "x", "MemoryError", None]) if status == "crash" else None, metric))
    return data


@pytest.mark.parametrize("direction, bar, folded", [("maximize", None, 1024), ("maximize", 0.6, 4), ("minimize", 0.4, 0)])
def test_decisions_and_stagnation_equal_the_loop(spark, small_chunks, monkeypatch, direction, bar, folded):
    monkeypatch.setattr(runlog, "FOLDED", folded)
    data = random_attempts(7)
    df = _attempts(spark, data).repartition(4)
    scores = spark.createDataFrame([("a", bar), ("b", bar)] if bar is not None else [], "name string, score double")
    decided = runlog.decide(baseline_gate(df, scores, direction), direction)
    families = ["a", "b", "c"]
    wanted, events = [], []
    for run in {d[0] for d in data}:
        out, ev = naive_loop([d[1:] for d in data if d[0] == run], direction, bar, families)
        wanted += [(run, *o) for o in out]
        events += [(run, *e) for e in ev]
    assert rows(decided, "run_id", "experiment_id", "action") == sorted(wanted)
    assert rows(runlog.stagnation_events(decided, families), "run_id", "experiment_id", "family") == sorted(events)


def test_draft_seed_is_the_first_best(spark):
    data = random_attempts(11, runs=10)
    df = _attempts(spark, data).withColumn("seed", F.lit(0.5))
    wanted = [(run, *o) for run in range(10) for o in naive_loop([d[1:] for d in data if d[0] == run], "maximize", None, [], seed=0.5)[0]]
    assert rows(runlog.decide(df), "run_id", "experiment_id", "action") == sorted(wanted)


def test_third_out_of_memory_stops_and_an_improvement_starts_over(spark):
    oom = ("crash", "OOM", None)
    steps = [oom, oom, ("ok", None, 0.5), oom, oom, oom, ("ok", None, 0.9)]
    df = _attempts(spark, [(1, i, *s) for i, s in enumerate(steps)])
    assert rows(runlog.retry_limit(df)) == [(1, 5, 3)]


@pytest.mark.parametrize("streak, flag", [(2, False), (3, True), (5, True)])
def test_stagnation_threshold(spark, streak, flag):
    log = _log(spark, [0.5] * (streak + 1), ["keep"] + ["revert"] * streak)
    assert rows(runlog.stagnated(log), "experiment_id", "is_stagnated")[-1][1] is flag
    assert runlog.max_revert_streak(log).first()["max_streak"] == streak


def test_budget_stop_takes_the_first_reason(spark):
    log = spark.sql("SELECT 'r' AS run_id, id + 1 AS experiment_id, 1.0D AS cost_usd, timestamp_seconds(id * 60) AS timestamp FROM range(10)")
    limits = "run_id string, budget_experiments long, budget_usd double, budget_minutes long"
    stop = lambda *limit: rows(runlog.budget_stop(log, spark.createDataFrame([("r", *limit)], limits)))
    assert stop(5, 100.0, 100) == [("r", 5, "Experiment count limit reached: 5/5")]
    assert stop(50, 3.0, 100) == [("r", 3, "Cost cap reached: $3.00/$3.00")]
    assert stop(50, 99.0, 4) == [("r", 5, "Time budget exceeded: 4.0min/4min")]
    assert stop(50, 99.0, 400) == []


def test_empty_cost_summary_is_zero(spark):
    empty = spark.createDataFrame([], "run_id string, cost_usd double")
    assert rows(runlog.cost_summary(empty, by=[])) == [(0.0, 0, 0.0, 0.0, 0.0)]


@pytest.mark.parametrize("statuses, text", [(["revert"], "No improvements"), (["keep"] + ["revert"] * 4, "High revert rate"), (["keep", "revert"], "Best approach committed at c1")])
def test_recommendation(spark, statuses, text):
    log = _log(spark, [0.9] + [0.1] * (len(statuses) - 1), statuses)
    assert runlog.recommendation(log).first()["recommendation"].startswith(text)


def test_retrospective_lists_ten_reverts_and_counts_the_rest(spark):
    log = _log(spark, [0.9] + [0.1] * 13, ["keep"] + ["revert"] * 13)
    lines = rows(runlog.retrospective(log, spark.createDataFrame([("r", 1.5)], "run_id string, cost_spent_usd double"), "auc"), "section", "position", "line")
    assert sum(s == "failed" for s, _, _ in lines) == 10
    assert ("failed_more", 0, "...and 3 more") in lines
    assert ("successful", 1, "Experiment 1 (auc=0.9): d1") in lines
    assert ("summary", 5, "Total Cost (USD): 1.50") in lines


def test_journal_texts(spark):
    data = [("r", 1, "x" * 70, 0.12345, 0.5, None, "revert", "y" * 600), ("r", 2, None, None, None, "abc", "keep", None), ("r", 3, "z" * 60, 0.00015, -0.25, "", "keep", "")]
    df = spark.createDataFrame(data, "run_id string, experiment_id long, hypothesis string, metric_value double, metric_delta double, commit_hash string, status string, diff string")
    a, b, c = rows(runlog.journal_table(df), "experiment_id", "metric", "delta", "hypothesis", "commit", "diff")
    assert a == (1, "%.4f" % 0.12345, "+0.5000", "x" * 57 + "...", "-", "y" * 500 + "...")
    assert b == (2, "-", "-", "", "abc", None)
    assert c == (3, "%.4f" % 0.00015, "-0.2500", "z" * 60, "-", None)


def _epochs(spark, curves):
    data = [(run, i + 1, loss, float(i)) for run, curve in enumerate(curves) for i, loss in enumerate(curve)]
    return spark.createDataFrame(data, "run_id int, epoch long, val_loss double, val_accuracy double").repartition(3)


def _curves(seed, runs=12, length=70):
    draw = random.Random(seed)
    out = []
    for run in range(runs):
        level, curve = 1.0, []
        for _ in range(length):
            level *= draw.choice([1.0, 0.99995, 0.9999, 0.999, 1.00004, 0.95])
            curve.append(draw.choice([level, level, level + 0.1, float("nan")]) * (-1 if run % 5 == 4 else 1))
        out.append(curve)
    return out


def test_early_stop_equals_loop(spark, small_chunks):
    curves = _curves(1)
    wanted = []
    for run, curve in enumerate(curves):
        low, wait, best, stop = float("inf"), 0, None, None
        for i, loss in enumerate(curve):
            if loss < low:
                low, wait, best = loss, 0, (i + 1, loss, float(i))
            else:
                wait += 1
                if wait >= 5:
                    stop = i + 1
                    break
        if best:
            wanted.append((run, stop, *best))
    got = training.early_stop(_epochs(spark, curves))
    assert sorted(map(tuple, got.collect())) == sorted(wanted)


def test_plateau_equals_loop(spark, small_chunks):
    curves = _curves(2) + [[1.0] * 100]
    wanted = []
    for run, curve in enumerate(curves):
        best, bad, rate, cuts = float("inf"), 0, 1e-3, 0
        for i, loss in enumerate(curve):
            if loss < best * (1 - 1e-4):
                best, bad = loss, 0
            else:
                bad += 1
            if bad > 3:
                bad = 0
                if rate - rate * 0.5 > 1e-8:
                    rate, cuts = rate * 0.5, cuts + 1
                    wanted.append((run, i + 1, cuts))
    assert rows(training.plateau_lr(_epochs(spark, curves)), "run_id", "epoch", "reduction") == sorted(wanted)


def test_epoch_averages_guard_empty_batches(spark):
    df = spark.createDataFrame([("r", 1, 0.0, 0, 0), ("r", 2, 1.0, 1, 2), ("r", 2, 4.0, 1, 1)], "run_id string, epoch int, loss double, correct int, total int")
    assert rows(training.epoch_averages(df)) == [("r", 1, 0.0, 0.0), ("r", 2, 2.0, 2 / 3)]


def test_agent_fallback_chain(spark):
    s = spark.createDataFrame([("a", 0.9, "s1"), ("b", None, "s2"), ("d", None, None)], "agent string, best_metric double, best_commit string")
    c = spark.createDataFrame([("a", 0.1, "c1"), ("b", 0.2, None), ("c", 0.3, "c3")], "agent string, best_metric double, best_commit string")
    assert rows(agents.collect_agent_results(s, c)) == [("a", 0.9, "s1", "state"), ("b", 0.2, "", "checkpoint"), ("c", 0.3, "c3", "checkpoint"), ("d", None, "", "none")]


def test_budget_split_keeps_whole_units(spark):
    config = spark.createDataFrame([("r", 10.0, 100, 10)], "run_id string, budget_usd double, budget_minutes long, budget_experiments long")
    assert rows(agents.budget_split(config, 3), "agent", "budget_minutes", "budget_experiments") == [(0, 33, 3), (1, 33, 3), (2, 33, 3)]


@pytest.mark.parametrize("text, wanted", [('a\n{"metric_value": 0.5, "best_commit": "x"}\nb', (0.5, "x")), ('{"metric_value": 0.5}\n{"metric_value": bad', (0.5, "")), ('\t{"metric_value": "0.25"} ', (0.25, "")), ("nothing", (None, "")), (None, (None, ""))])
def test_metric_from_text(spark, text, wanted):
    df = spark.createDataFrame([(text,)], "result string")
    assert rows(agents.metric_from_text(df), "metric_value", "best_commit") == [wanted]


def test_claims(spark):
    claimed = spark.createDataFrame([("r", "a", 0.9), ("r", "b", 0.9), ("r", "c", 0.9)], "run_id string, commit_hash string, metric_value double")
    checked = spark.createDataFrame([("r", "a", 0.9005), ("r", "b", 0.902)], "run_id string, commit_hash string, metric_value double")
    assert [r[3:] for r in rows(agents.verify_claims(claimed, checked), "run_id", "commit_hash", "claimed_metric", "match")] == [(True,), (False,), (False,)]
