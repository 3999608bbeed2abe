import random

from pyspark.sql import functions as F

from runsight.plans.hashorder import rank_cuts
from runsight.plans.running import Running, running, running_global, since_reset

from .conftest import rows


def _log(spark, n=300, runs=3, seed=1):
    draw = random.Random(seed)
    # run 0 holds most rows
    data = [(draw.choice([0, 0, 0, 0] + list(range(runs))), i, draw.choice([None, draw.randint(0, 50)])) for i in range(n)]
    return data, spark.createDataFrame(data, "k int, i long, v int").repartition(5)


def test_running_equals_loop_across_chunks(spark, small_chunks):
    data, df = _log(spark)
    measures = [
        Running("s", "sum", F.col("v")),
        Running("n", "count", F.col("v").isNotNull(), before=True),
        Running("hi", "max", F.col("v"), before=True),
        Running("lo", "min", F.col("v")),
    ]
    wanted, state = [], {}
    for k, i, v in data:
        s, n, hi, lo = state.get(k, (0, 0, None, None))
        new = (s + (v or 0), n + (v is not None), max((x for x in (hi, v) if x is not None), default=None), min((x for x in (lo, v) if x is not None), default=None))
        wanted.append((k, i, new[0], n, hi, new[3]))
        state[k] = new
    assert rows(running(df, ["k"], "i", measures), "k", "i", "s", "n", "hi", "lo") == sorted(wanted, key=lambda r: r[:2])


def test_running_global_by_ranges_equals_small_window(spark):
    data = [(f"x{i:04d}", i % 7) for i in range(500)]
    df = spark.createDataFrame(data, "o string, v int").repartition(6)
    measures = [Running("before", "sum", F.col("v"), before=True), Running("at", "count", F.lit(True))]
    plain = rows(running_global(df, "o", measures), "o", "before", "at")
    assert plain == rows(running_global(df, "o", measures, chunk_rows=60), "o", "before", "at")
    total = 0
    for (o, before, at), (_, v) in zip(plain, data):
        assert before == total
        total += v


def test_since_reset_equals_loop(spark, small_chunks):
    data, df = _log(spark, seed=2)
    wanted, streak = [], {}
    for k, i, v in data:
        streak[k] = streak.get(k, 0) + 1 if (v or 0) < 40 else 0
        wanted.append((k, i, streak[k]))
    low = F.coalesce(F.col("v"), F.lit(0)) < 40
    assert rows(since_reset(df, ["k"], "i", "c", low.cast("int"), ~low), "k", "i", "c") == sorted(wanted)


def test_rank_cuts_find_the_row_at_each_rank(spark):
    data = [(i % 3, f"{random.Random(i).getrandbits(64):016x}") for i in range(400)]
    df = spark.createDataFrame(data, "g int, _h string")
    cuts = rank_cuts(df, ["g"], lambda n: F.array(F.lit(0).cast("long"), F.lit(1).cast("long"), (n / 2).cast("long"), n))
    got = {(r["g"], r["cut"]): r["cut_hash"] for r in cuts.collect()}
    for g in range(3):
        hashes = sorted(h for k, h in data if k == g)
        assert (g, 0) not in got
        assert got[g, 1] == hashes[0] and got[g, 2] == hashes[len(hashes) // 2 - 1] and got[g, 3] == hashes[-1]
