"""A stream drained over several batches gives what the batch operator gives."""

from pyspark.sql import functions as F

from runsight.operators import runlog
from runsight.operators.baselines import baseline_gate
from runsight.streaming import live

from .conftest import rows
from .test_runlog import random_attempts

ATTEMPT = "run_id int, experiment_id long, status string, error string, metric_value double"


def _files(spark, df, path, parts, by="experiment_id"):
    """Consecutive stretches of the log as files written one after the other."""
    import time

    top = df.agg(F.max(by)).first()[0] + 1
    for i in range(parts):
        part = df.where((F.col(by) >= top * i // parts) & (F.col(by) < top * (i + 1) // parts))
        part.coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)  # files are taken in order of their time


def test_decisions_carry_over_batches(spark, tmp_path):
    data = [d if d[4] == d[4] else (*d[:4], None) for d in random_attempts(21, runs=15)]
    df = spark.createDataFrame(data, ATTEMPT)
    path = str(tmp_path / "log")
    _files(spark, df, path, 3)
    stream = live.follow(spark, path, df.schema, "parquet", files_per_batch=1)
    out = live.drain(live.live_decisions(stream, bar=0.6, families=["a", "b"]), "append")
    scores = spark.createDataFrame([("x", 0.6)], "name string, score double")
    decided = runlog.decide(baseline_gate(df, scores))
    assert rows(out, "run_id", "experiment_id", "action", "gated") == rows(decided, "run_id", "experiment_id", "action", "gated")
    events = rows(out.where("family is not null"), "run_id", "experiment_id", "family")
    assert events == rows(runlog.stagnation_events(decided, ["a", "b"]), "run_id", "experiment_id", "family")


def test_totals_equal_the_batch(spark, tmp_path):
    log = spark.range(300).selectExpr(
        "id % 4 AS run_id", "id AS experiment_id", "concat('c', id) AS commit_hash", "sin(id) AS metric_value", "element_at(array('keep', 'revert', 'crash'), cast(id % 3 + 1 as int)) AS status", "0.5D AS cost_usd"
    )
    path = str(tmp_path / "log")
    _files(spark, log, path, 2)
    follow = lambda: live.follow(spark, path, log.schema, "parquet", files_per_batch=1)
    assert rows(live.drain(live.live_best(follow()), "complete")) == rows(runlog.best_result(log))
    assert rows(live.drain(live.live_summary(follow()), "complete")) == rows(runlog.log_summary(log))
    assert rows(live.drain(live.live_cost(follow()), "complete")) == rows(runlog.cost_summary(log))


def test_silent_run_is_alarmed_by_the_clock_of_the_stream(spark, tmp_path):
    at = lambda minute: F.timestamp_seconds(F.lit(minute * 60))
    first = spark.range(1).select(F.lit("quiet").alias("run_id"), F.lit(1).cast("long").alias("experiment_id"), F.lit(0.1).alias("cost_usd"), at(1).alias("timestamp"))
    later = [first.select(F.lit("busy").alias("run_id"), F.lit(i).cast("long").alias("experiment_id"), "cost_usd", at(100 * i).alias("timestamp")) for i in (1, 2, 3)]
    path = str(tmp_path / "log")
    import time

    for part in [first, *later]:
        part.coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    follow = lambda: live.follow(spark, path, first.schema, "parquet", files_per_batch=1)
    silent = rows(live.drain(live.silent_runs(follow(), minutes=30, delay="1 minute"), "append"))
    assert ("quiet", 1, "time") in silent and len(silent) == len({r[0] for r in silent})
    assert rows(live.drain(live.budget_alarm(follow(), experiments=3, usd=99.0, minutes=1000), "append")) == [("busy", 3, "experiments")]


def test_rows_of_a_run_are_combined_before_the_state(monkeypatch):
    import pyarrow as pa

    batch = lambda *rows: pa.RecordBatch.from_pylist([dict(zip(("run_id", "experiment_id", "at"), r)) for r in rows], pa.schema([("run_id", pa.int64()), ("experiment_id", pa.int64()), ("at", pa.int64())]))
    batches = [batch((1, 5, 70), (2, 1, None), (1, 4, 60)), batch(), batch((1, 9, 80), (None, 3, 5), (2, None, None))]
    expected = [(1, 9, 60), (2, 1, None), (None, 3, 5)]
    values = lambda found: [tuple(r.values()) for b in found for r in b.to_pylist()]
    assert sorted(values(live._combined(iter(batches))), key=str) == sorted(expected, key=str)
    monkeypatch.setattr(live, "COMBINED", 2)
    again = [batch(r) for r in values(live._combined(iter(batches)))]
    monkeypatch.setattr(live, "COMBINED", 100)
    assert sorted(values(live._combined(iter(again))), key=str) == sorted(expected, key=str)
    assert list(live._combined(iter([]))) == []


def test_late_rows_count_for_the_budget(spark, tmp_path):
    import time

    path = str(tmp_path / "log")
    for minute in (100, 101, 1, 102, 2):
        row = spark.sql(f"SELECT 'r' AS run_id, {minute}L AS experiment_id, 1.0D AS cost_usd, timestamp_seconds({minute * 60}) AS timestamp")
        row.coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    stream = live.follow(spark, path, row.schema, "parquet", files_per_batch=1)
    assert rows(live.drain(live.budget_alarm(stream, experiments=5, usd=99.0, minutes=1e6), "append")) == [("r", 2, "experiments")]


def test_repeats_are_dropped_across_batches(spark, tmp_path):
    log = spark.range(50).selectExpr("'r' AS run_id", "id AS experiment_id", "timestamp_seconds(id + 100000) AS timestamp")
    path = str(tmp_path / "log")
    for _ in range(2):
        log.coalesce(1).write.mode("append").parquet(path)
    stream = live.follow(spark, path, log.schema, "parquet", files_per_batch=1)
    assert rows(live.drain(live.without_repeats(stream, "1 hour"), "append"), "experiment_id") == [(i,) for i in range(50)]
