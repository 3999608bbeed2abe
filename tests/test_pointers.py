"""Chains by pointer doubling equal the loop over each sequence."""

import random

import pytest
from pyspark.sql import functions as F

from runsight.operators import training
from runsight.plans import pointers

from .conftest import rows


def _sequences():
    draw = random.Random(9)
    out = [[draw.gauss(0, 1) for _ in range(n)] for n in (1, 2, 3, 4, 5, 17, 64, 65, 300)]
    out += [[-float(i) for i in range(200)], [float(i) for i in range(200)], [1.0] * 50, [draw.choice([1.0, 2.0]) for _ in range(130)]]
    return out


@pytest.mark.parametrize("span_bits", [1, 2, 6])
def test_next_below_and_chain(spark, span_bits):
    draw = random.Random(3)
    data, targets, chains = [], [], []
    for key, values in enumerate(_sequences()):
        limits = [v - draw.choice([0, 0.1, 0.5, -0.2]) for v in values]
        data += [(key, i, v, w) for i, (v, w) in enumerate(zip(values, limits))]
        found = [next((j for j in range(i + 1, len(values)) if values[j] < limits[i]), None) for i in range(len(values))]
        targets += [(key, i, -1 if t is None else t) for i, t in enumerate(found)]
        at = 0
        while at is not None:
            chains.append((key, at))
            at = found[at]
    df = spark.createDataFrame(data, "k int, place long, value double, limit double").repartition(3)
    out = pointers.next_below(df, ["k"], span_bits).persist()
    assert rows(out.withColumn("target", F.coalesce("target", F.lit(-1))), "k", "place", "target") == sorted(targets)
    assert rows(pointers.on_chain(out, ["k"]), "k", "place") == sorted(chains)


def _falls(curve):
    """The scheduler's own loop: (position, reduction)."""
    best, bad, rate, cuts, out = float("inf"), 0, 1e-3, 0, []
    for i, loss in enumerate(curve):
        if loss is not None and loss < best * (1 - 1e-4):
            best, bad = loss, 0
        else:
            bad += 1
        if bad > 3:
            bad = 0
            if rate - rate * 0.5 > 1e-8:
                rate, cuts = rate * 0.5, cuts + 1
                out.append((i + 1, cuts))
    return out


@pytest.mark.parametrize("folded", [0, 3, 1024])
def test_plateaus_of_long_runs_equal_the_loop(spark, monkeypatch, small_chunks, folded):
    monkeypatch.setattr(training, "FOLDED", folded)
    draw = random.Random(1)
    curves = [[draw.gauss(0, 1) for _ in range(90)], [1 / (i + 1) + draw.random() / 50 for i in range(150)], [5 - i * 0.1 + draw.gauss(0, 0.3) for i in range(120)], [1.0] * 30]
    curves += [[None, float("inf"), 1.0, None, float("nan"), 0.5] * 3, [None] * 9, [float("-inf"), -1.0] * 4, [1 - i * 5e-5 for i in range(80)]]
    data = [(r, i + 1, v, 0.0) for r, curve in enumerate(curves) for i, v in enumerate(curve)]
    epochs = spark.createDataFrame(data, "run_id int, epoch int, val_loss double, val_accuracy double")
    want = sorted((r, *f) for r, curve in enumerate(curves) for f in _falls([v if v == v else None for v in curve]))
    out = training.plateau_lr(epochs)
    assert rows(out, "run_id", "epoch", "reduction") == want
    assert "Python" not in out._jdf.queryExecution().toString() and "InPandas" not in out._jdf.queryExecution().toString()
