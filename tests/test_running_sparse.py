"""Running values in any order column: hot keys are cut into ranges of equal size, totals of chunks are carried by the same rule."""

import random

import pytest
from pyspark.sql import functions as F

from runsight.plans import running as plan
from runsight.plans.running import Running, hot_keys, running, since_reset

from .conftest import rows


@pytest.mark.parametrize("order", ["double", "timestamp", "string", "sparse long"])
def test_any_order_column(spark, small_chunks, order):
    draw = random.Random(5)
    at = sorted({draw.random() ** 20 * 1e15 for _ in range(400)})  # nearly all close to 0
    cast = {"double": F.col("x"), "timestamp": F.timestamp_seconds("x"), "string": F.lpad(F.format_string("%.6f", "x"), 30, "0"), "sparse long": F.floor(F.col("x") * 1000)}[order]
    data = [(draw.choice([0, 0, 0, 1, 2]), i, x, draw.choice([None, draw.randint(0, 9)])) for i, x in enumerate(at)]
    df = spark.createDataFrame(data, "k int, i long, x double, v int").withColumn("o", cast).dropDuplicates(["k", "o"]).persist()
    kept = {r["i"] for r in df.select("i").collect()}
    want, state = [], {}
    for k, i, _, v in data:
        if i in kept:
            total, low, streak = state.get(k, (0, None, 0))
            total, low, streak = total + (v or 0), v if low is None else low if v is None else min(low, v), 0 if v is None else streak + 1
            state[k] = total, low, streak
            want.append((k, i, total, low, streak))
    out = running(df, ["k"], "o", [Running("s", "sum", F.col("v")), Running("lo", "min", F.col("v"))])
    out = since_reset(out, ["k"], "o", "streak", F.lit(1), F.col("v").isNull())
    assert rows(out, "k", "i", "s", "lo", "streak") == sorted(want)


def test_chunks_of_one_hot_key_are_bounded_and_even(spark, monkeypatch):
    """A million time stamps of one run, most of them within a second of each other."""
    monkeypatch.setattr(plan, "HOT_ROWS", 100_000)
    monkeypatch.setattr(plan, "CHUNK_ROWS", 1 << 17)
    df = spark.range(1_000_000).select(F.lit("r").alias("k"), "id", F.timestamp_micros((F.pow(F.col("id") / 1e6, 8) * 1e12).cast("long") * 1_000_000 + F.col("id")).alias("at"))
    placed, split = plan.chunked(df, ["k"], "at", None, "count")
    sizes = [r["count"] for r in placed.groupBy(plan.CHUNK).count().collect()]
    assert split and max(sizes) <= 1 << 17 and sum(sizes) == 1_000_000 and len(sizes) >= 8
    out = running(df, ["k"], "at", [Running("n", "count", F.lit(True)), Running("s", "sum", F.col("id"))])
    assert out.where("n <> id + 1 OR s <> id * (id + 1) / 2").count() == 0


def test_totals_of_totals(spark, small_chunks, monkeypatch):
    """So many chunks that their totals are a hot key themselves."""
    monkeypatch.setattr(plan, "CHUNK_ROWS", 6)
    levels = []
    inner = plan.carried
    monkeypatch.setattr(plan, "carried", lambda totals, *more: (levels.append(totals.count()), inner(totals, *more))[1])
    df = spark.range(300).select(F.lit(1).alias("k"), (F.col("id") * F.col("id")).alias("o"), F.col("id").alias("v"))
    out = running(df, ["k"], "o", [Running("s", "sum", F.col("v"), before=True)])
    assert [r[0] for r in rows(out, "s")] == [i * (i - 1) // 2 for i in range(300)]
    assert len(levels) >= 2 and sorted(levels, reverse=True) == levels


def test_keys_that_are_not_hot_stay_plain(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").alias("o"))
    assert hot_keys(df, ["k"]) is None and hot_keys(df, ["k"], 33).collect()[0].asDict() == {"k": 0, "_n": 34}


def test_small_ranges_share_tasks(spark, monkeypatch):
    numbers = spark.range(2000).select((F.col("id") % 2).alias("k"), (-F.col("id")).alias("at"))
    for task_rows, tasks in ((1 << 18, 1), (700, 3)):
        monkeypatch.setattr(plan, "TASK_ROWS", task_rows)
        written, write = [], plan.materialize
        with monkeypatch.context() as m:
            m.setattr(plan, "materialize", lambda df: (written.append(df.rdd.getNumPartitions()), write(df))[1])
            hot = hot_keys(numbers, ["k"], 100)
            written.clear()
            chunks, _ = plan.chunked(numbers, ["k"], "at", None, hot, 10)
        assert written[-1] == tasks
        sizes = chunks.groupBy(plan.CHUNK).agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.count("*").alias("chunks")).first()
        assert sizes["most"] <= 10 and sizes["chunks"] >= 400
        out = running(numbers, ["k"], "at", [Running("n", "count", F.lit(True))], hot=hot, chunk_rows=10)
        assert [x["n"] for x in out.orderBy("k", "at").collect()] == [*range(1, 1001)] * 2
