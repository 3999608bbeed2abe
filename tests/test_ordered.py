"""Decisions over rows in any order give what the batch operators give over the rows in order."""

import random

import numpy as np
import pytest

from runsight.operators import runlog
from runsight.operators.baselines import baseline_gate
from runsight.streaming import live, ordered

from .conftest import rows
from .test_runlog import random_attempts

ATTEMPT = "run_id int, experiment_id long, status string, error string, metric_value double, timestamp timestamp"


def _stamped(spark, data):
    """Rows with a time of their own: ten seconds from one experiment to the next."""
    plain = spark.createDataFrame([tuple(r[:5]) for r in data], "run_id int, experiment_id long, status string, error string, metric_value double")
    return plain.selectExpr("*", "timestamp_seconds(1000000 + 10 * experiment_id) AS timestamp")


def _decided(spark, tmp_path, parts, delay, **options):
    """All parts as files in the order given, one per batch, and a last row that only moves the clock."""
    path = str(tmp_path / "log")
    for part in [*parts, spark.createDataFrame([(None, None, None, None, None)], ATTEMPT.rsplit(",", 1)[0]).selectExpr("*", "timestamp'2100-01-01' AS timestamp")]:
        part.coalesce(1).write.mode("append").parquet(path)
    stream = live.follow(spark, path, parts[0].schema, "parquet", files_per_batch=1)
    ordered.use_state_store(spark)
    return live.drain(ordered.ordered_decisions(stream, delay, **options), "append")


def _clean(data):
    return [d if d[4] == d[4] else (*d[:4], None) for d in data]


@pytest.mark.parametrize("slot_ms", [1, 60_000, 10**9])
def test_reverse_order_gives_the_batch_result(spark, tmp_path, slot_ms):
    data = _clean(random_attempts(33, runs=6))
    df = _stamped(spark, data)
    top = max(d[1] for d in data) + 1
    parts = [df.where(f"experiment_id >= {top * i // 4} AND experiment_id < {top * (i + 1) // 4}") for i in reversed(range(4))]
    out = _decided(spark, tmp_path, parts, "30 days", bar=0.6, families=["a", "b"], slot_ms=slot_ms).persist()
    decided = runlog.decide(baseline_gate(df, spark.createDataFrame([("x", 0.6)], "name string, score double"))).persist()
    assert out.where("late").count() == 0
    assert rows(out, "run_id", "experiment_id", "action", "gated") == rows(decided, "run_id", "experiment_id", "action", "gated")
    assert rows(out.where("family IS NOT NULL"), "run_id", "experiment_id", "family") == rows(runlog.stagnation_events(decided, ["a", "b"]), "run_id", "experiment_id", "family")
    assert {r.run_id for r in out.collect()} >= {d[0] for d in data}


@pytest.mark.parametrize("slot_ms, chunk_rows", [(1, 1), (1, 7), (60_000, 7)])
def test_waiting_rows_in_chunks_that_are_cut(spark, tmp_path, slot_ms, chunk_rows):
    """Several rows to a time, rows before, between and behind the chunks that are there, and a clock that stops within one."""
    draw = random.Random(9)
    data = [(draw.randrange(2), i, "ok", None, draw.random()) for i in range(300)]
    df = _stamped(spark, data).selectExpr("* EXCEPT (timestamp)", "timestamp_seconds(1000000 + 20 * (experiment_id DIV 2)) AS timestamp")
    place = sorted(range(300), key=lambda i: 10 * i + draw.uniform(0, 1000))
    parts = [df.where(f"experiment_id IN ({', '.join(map(str, place[k : k + 75]))})") for k in range(0, 300, 75)]
    out = _decided(spark, tmp_path, parts, "1100 seconds", slot_ms=slot_ms, chunk_rows=chunk_rows).persist()
    assert out.where("late").count() == 0
    assert rows(out, "run_id", "experiment_id", "action") == rows(runlog.decide(df), "run_id", "experiment_id", "action")


class _Store:
    """State of one run that counts the calls."""

    def __init__(self):
        self.value, self.map, self.calls = None, {}, 0

    def __getattr__(self, name):
        def call(*args):
            self.calls += 1
            if name == "get":
                return self.value
            if name == "update":
                self.value = args[0]
            elif name == "getValue":
                return self.map[args[0]]
            elif name == "updateValue":
                self.map[args[0]] = args[1]
            elif name == "removeKey":
                del self.map[args[0]]

        return call


def test_calls_to_the_state_store_do_not_follow_the_rows():
    from types import SimpleNamespace

    import pandas as pd

    from runsight.streaming.loop import Rules

    store = _Store()
    work = ordered._InOrder(Rules(1.0, None, (), 3, 2), 60_000, 1000)
    work.handle = work.loop = work.waiting = store
    clock = lambda at: SimpleNamespace(getCurrentWatermarkInMs=lambda: at)
    ids = np.arange(5000)
    batch = pd.DataFrame({"at": ids * 60_000, "experiment_id": ids, "placed": True, "finished": True, "memory": False, "metric": 1.0})
    for part in (batch[4000:], batch[1000:4000], batch[:1000]):
        assert list(work.handleInputRows((1,), iter([part]), clock(-1))) == []
    out = pd.concat(work.handleExpiredTimer((1,), clock(10**12), None))
    assert out["experiment_id"].tolist() == ids.tolist() and not store.map
    assert store.calls < 100


def test_rows_come_out_once_the_clock_has_passed_them(spark, tmp_path):
    """Shuffled within the delay, in many batches: nothing is late, nothing is lost."""
    draw = random.Random(4)
    data = [(draw.randrange(3), i, "ok", None, draw.random()) for i in range(240)]
    df = _stamped(spark, data)
    place = sorted(range(240), key=lambda i: 10 * i + draw.uniform(0, 290))  # at most 290 seconds out of place
    batches = [place[k : k + 48] for k in range(0, 240, 48)]
    parts = [df.where(f"experiment_id IN ({', '.join(map(str, b))})") for b in batches]
    out = _decided(spark, tmp_path, parts, "300 seconds", direction="minimize").persist()
    assert out.where("late").count() == 0
    assert rows(out, "run_id", "experiment_id", "action") == rows(runlog.decide(df, "minimize"), "run_id", "experiment_id", "action")


def test_late_rows_are_flagged_and_change_nothing(spark, tmp_path):
    data = [(1, i, "ok", None, float(i)) for i in range(40)]
    df = _stamped(spark, data)
    late, rest = df.where("experiment_id IN (3, 7)"), df.where("experiment_id NOT IN (3, 7)")
    parts = [rest.where("experiment_id < 20"), rest.where("experiment_id >= 20"), late]
    out = _decided(spark, tmp_path, parts, "50 seconds").persist()
    assert rows(out.where("late"), "run_id", "experiment_id", "action") == [(1, 3, None), (1, 7, None)]
    assert rows(out.where("NOT late"), "run_id", "experiment_id", "action") == rows(runlog.decide(rest), "run_id", "experiment_id", "action")


def test_a_stop_ends_a_run_and_missing_times_have_no_place(spark, tmp_path):
    data = [(1, i, "crash", "CUDA OOM", None) for i in range(6)] + [(2, 0, "ok", None, float("nan")), (2, 1, "timeout", None, 9.0)]
    df = _stamped(spark, data)
    none = df.where("run_id = 2 AND experiment_id = 1").selectExpr("run_id", "5L AS experiment_id", "status", "error", "metric_value", "CAST(NULL AS timestamp) AS timestamp")
    out = _decided(spark, tmp_path, [df.where("experiment_id > 2"), df.where("experiment_id <= 2").unionByName(none)], "1 hour")
    assert rows(out, "run_id", "experiment_id", "action") == [(1, 0, "retry"), (1, 1, "retry"), (1, 2, "stop"), (2, 0, "revert"), (2, 1, "revert")]
