import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from runsight.operators import baselines, chat, forecast, prep
from runsight.functions.rouge import common_subsequence

from .conftest import rows


def _keys(spark, n):
    return spark.range(n).repartition(5)


@pytest.mark.parametrize("n, test, part", [(100, 0.2, 20), (101, 0.2, 21), (3, 0.5, 2)])
def test_test_split_size_is_rounded_up_and_repeats(spark, n, test, part):
    first = rows(prep.split_train_test(_keys(spark, n), "id", test))
    assert sum(t for _, t in first) == part
    assert first == rows(prep.split_train_test(spark.range(n).repartition(2), "id", test))
    assert first != rows(prep.split_train_test(_keys(spark, n), "id", test, seed=7)) or n < 10


@pytest.mark.parametrize("n, share, part", [(100, 0.1, 10), (109, 0.1, 10), (5, 0.1, 0)])
def test_eval_split_size_is_rounded_down(spark, n, share, part):
    assert sum(t for _, t in rows(prep.split_train_eval(_keys(spark, n), "id", share))) == part


def test_split_parts_share_nothing(spark):
    marked = prep.split_train_test(_keys(spark, 500), "id")
    inside, outside = prep.partition_by_membership(marked.select("id"), marked.where("is_test"), "id")
    assert inside.count() == 100 and outside.count() == 400 and prep.common_keys(inside, outside, "id").count() == 0


@pytest.mark.parametrize("n, k", [(100, 5), (103, 5), (7, 3), (3, 5)])
def test_fold_sizes(spark, n, k):
    sizes = Counter(f for _, f in rows(prep.kfold(_keys(spark, n), "id", k)))
    assert [sizes.get(i, 0) for i in range(k)] == [n // k + (i < n % k) for i in range(k)]


def test_stratified_folds_deal_classes_evenly(spark):
    df = spark.range(997).select("id", F.when(F.col("id") % 10 < 6, "a").when(F.col("id") % 10 < 9, "b").when(F.col("id") != 9, "c").alias("label"))
    folded = prep.stratified_kfold(df, "id", "label").collect()
    labelled = [r for r in folded if r["label"] is not None]
    assert all(r["fold"] is None for r in folded if r["label"] is None) and len(folded) == 997
    by_class = Counter((r["label"], r["fold"]) for r in labelled)
    for label in "abc":
        counts = [by_class[label, i] for i in range(5)]
        assert max(counts) - min(counts) <= 1
    totals = Counter(r["fold"] for r in labelled)
    assert max(totals.values()) - min(totals.values()) <= 1


def test_range_path_gives_the_same_labels(spark, small_chunks):
    df = spark.range(300).select(F.concat(F.lit("l"), (F.col("id") % 57).cast("string")).alias("label"), "id")
    names = sorted({f"l{i}" for i in range(57)})
    assert {(r["label"], r["label_id"]) for r in prep.encode_labels(df, "label").collect()} == {(n, i) for i, n in enumerate(names)}


def test_temporal_split_keeps_days_together(spark):
    df = spark.range(100).select("id", F.expr("date_add(date'2020-01-01', cast(id / 7 as int))").alias("day"))
    marked = prep.temporal_split(df, "day", 0.2).collect()
    test = [r["day"] for r in marked if r["is_test"]]
    assert len(test) >= 20 and min(test) > max(r["day"] for r in marked if not r["is_test"])


def test_imputing_takes_training_values(spark):
    train = spark.createDataFrame([(1.0, "b"), (2.0, "a"), (3.0, "a"), (10.0, "b"), (None, None), (float("nan"), None)], "x double, s string")
    test = spark.createDataFrame([(None, None), (7.0, "z")], "x double, s string")
    assert rows(prep.impute_median(test, ["x"], train), "x") == [(2.5,), (7.0,)]
    assert rows(prep.impute_mode(test, ["s"], train), "s") == [("a",), ("z",)]


def test_scaling_uses_population_deviation_and_zeroes_constants(spark):
    out = rows(prep.standardize(spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, c double"), ["x", "c"]))
    assert out == [(-1.0, 0.0), (1.0, 0.0)]


def test_one_hot_of_unseen_is_all_zero(spark):
    train = spark.createDataFrame([("a",), ("c",)], "s string")
    test = spark.createDataFrame([("a",), ("c",), ("x",), (None,)], "s string")
    got = {r["s"]: r["s_hot"].toArray().tolist() for r in prep.one_hot(test, "s", train).collect()}
    assert got == {"a": [1.0, 0.0], "c": [0.0, 1.0], "x": [0.0, 0.0], None: [0.0, 0.0]}


def test_chat_fills_missing_sides(spark):
    df = spark.createDataFrame([("hi", None)], "instruction string, output string")
    assert chat.format_as_chat(df, template="[%s|%s]").first()["text"] == "[user|hi][assistant|]"


def test_long_conversations_go_on_in_parts(spark):
    turns = spark.range(10).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text")).repartition(3)
    parts = rows(chat.format_conversations(turns, "%s:%s ", part_turns=4), "part", "n_turns", "text")
    assert [p[1] for p in parts] == [4, 4, 2]
    assert "".join(p[2] for p in parts) == "".join(f"user:{i} " for i in range(10))


def test_tokenizer_hook_pads_and_truncates(spark):
    df = spark.createDataFrame([("a b c d e",), ("a",), (None,)], "text string")
    out = {r["text"]: (r["input_ids"], r["attention_mask"]) for r in chat.tokenize_truncate(df, lambda: lambda t: [ord(c) for c in t.split()], max_length=3).collect()}
    assert out == {"a b c d e": ([97, 98, 99], [1, 1, 1]), "a": ([97, 0, 0], [1, 0, 0]), None: ([0, 0, 0], [0, 0, 0])}


def test_words_are_looked_up_without_python(spark):
    texts = ["The cat, the CAT sat", "", None, " ,,", "über 9 lives " * 50, "cat " * 3 + "dog"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    vocabulary = spark.createDataFrame([(w, i + 2) for i, w in enumerate(["the", "cat", "über", "9", "lives", "on"])], "token string, id long")
    for length in (1, 4, 200):
        by_hook = chat.tokenize_truncate(df, chat.word_tokenizer(vocabulary), max_length=length)
        out = chat.word_ids(df, vocabulary, max_length=length)
        assert rows(out, "i", "input_ids", "attention_mask") == rows(by_hook, "i", "input_ids", "attention_mask")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange hash" not in plan


def test_overlap_equals_counters(spark):
    import random

    draw = random.Random(8)
    texts = [" ".join(draw.choices("a b c d e".split(), k=draw.randint(0, 30))) for _ in range(60)] + [None, "", "A-b,C"]
    both = [(x, y) for x in texts[::3] for y in texts[1::4]]
    out = chat.rouge_rows(spark.createDataFrame(both, "prediction string, reference string"))
    for row in out.collect():
        a, b = ((row[c] or "").lower().replace("-", " ").replace(",", " ").split() for c in ("prediction", "reference"))
        for name, x, y in (("rouge1", a, b), ("rouge2", list(zip(a, a[1:])), list(zip(b, b[1:])))):
            common = (Counter(x) & Counter(y)).total()
            assert row[name] == (2.0 * common / (len(x) + len(y)) if common else 0.0)
    two = chat.rouge_scores(spark.createDataFrame(both, "prediction string, reference string")).select("rouge1", "rouge2")
    assert "Python" not in two._jdf.queryExecution().executedPlan().toString()


def test_chat_template_hook(spark):
    df = spark.sql("SELECT array(named_struct('role', 'user', 'content', 'x')) AS messages")
    out = chat.apply_chat_template(df, lambda: lambda messages: "".join(f"<{m['role']}>{m['content']}" for m in messages))
    assert out.first()["text"] == "<user>x"


def test_common_subsequence_equals_the_table():
    import random

    draw = random.Random(5)
    for _ in range(200):
        a, b = ([draw.choice("abcd") for _ in range(draw.randint(0, 30))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert common_subsequence(a, b) == table[-1][-1]


def test_rouge(spark):
    df = spark.createDataFrame([("the cat sat", "The cat ran!"), ("", "x"), (None, None), ("a a b", "a b b")], "prediction string, reference string")
    got = {r["prediction"]: (r["rouge1"], r["rouge2"], r["rougeL"]) for r in chat.rouge_rows(df).collect()}
    assert got["the cat sat"] == pytest.approx((2 / 3, 0.5, 2 / 3)) and got[""] == (0, 0, 0) and got[None] == (0, 0, 0)
    assert got["a a b"] == pytest.approx((2 / 3, 0.5, 2 / 3))


def test_gate(spark):
    scores = spark.createDataFrame([("m", 0.5, 0.0), ("s", 0.6, 0.0)], "name string, score double, std double")
    values = spark.createDataFrame([(0.7,), (0.55,), (0.6,), (0.4,), (None,), (float("nan"),)], "metric_value double")
    passed = lambda b, d: {r[0] for r in baselines.baseline_gate(values, b, d).where("passes_gate").collect()}
    assert passed(scores, "maximize") == {0.7} and passed(scores, "minimize") == {0.4}
    assert baselines.baseline_gate(values, scores.limit(0)).where("passes_gate").count() == 6


def test_loss_baselines(spark):
    labels = spark.createDataFrame([(0,), (1,), (2,), (2,)], "label int")
    found = {r["name"]: r["score"] for r in baselines.baseline_loss_classes(labels, "label").where("std = 0").collect()}
    assert found == pytest.approx({"random_guess": math.log(3), "uniform_prediction": 0.95 * math.log(3)})
    assert [r["score"] for r in baselines.baseline_loss_vocab(spark, "perplexity", 1000).collect()] == [1000.0, 800.0]
    assert baselines.baseline_loss_vocab(spark).first()["score"] == math.log(32000)


def test_drawn_predictions_follow_the_training_shares(spark, small_chunks):
    df = spark.range(4000).select("id", F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("y"))
    folded = prep.stratified_kfold(df, "id", "y")
    counts = baselines.fold_class_counts(folded, "y")
    drawn = baselines.drawn_predictions(folded, counts, "id", "y")
    share = drawn.groupBy("fold").agg(F.avg((F.col("y_pred") == "a").cast("int")).alias("s")).collect()
    assert len(share) == 5 and all(abs(r["s"] - 0.25) < 0.06 for r in share)
    for strategy, lower in (("stratified", 0.25), ("uniform", 0.5)):
        found = {r["id"]: r["y_pred"] for r in baselines.drawn_predictions(folded, counts, "id", "y", strategy=strategy).collect()}
        draws = {r["id"]: r["u"] for r in df.select("id", baselines.unit_draw("id", baselines.SEED).alias("u")).collect()}
        assert all((y == "a") == (draws[i] < lower) for i, y in found.items() if abs(draws[i] - lower) > 0.01)
    uniform = baselines.drawn_predictions(folded, counts, "id", "y", strategy="uniform").agg(F.avg((F.col("y_pred") == "a").cast("int"))).first()[0]
    assert abs(uniform - 0.5) < 0.04


@pytest.mark.parametrize("lag", [1, 4, 25])
def test_lags_across_ranges_equal_the_list(spark, small_chunks, lag):
    """Long series in ranges of a few rows, shorter than the lag too; short series beside them."""
    lengths = [100, 3, 60, 1, 11, 10]
    data = [(s, f"{i:04d}", None if i % 9 == 4 else float(100 * s + i), "x") for s, n in enumerate(lengths) for i in range(n)]
    df = spark.createDataFrame(data, "series_id int, period string, value double, note string").repartition(4)
    of = {(s, p): v for s, p, v, _ in data}
    want = [(s, p, int(p) + 1, of.get((s, f"{int(p) - lag:04d}"))) for s, p, _, _ in data]
    got = [tuple(r) for r in forecast.lagged(df, lag, "back").select("series_id", "period", "position", "back").collect()]
    assert sorted(got, key=lambda r: r[:2]) == sorted(want, key=lambda r: r[:2])


@pytest.mark.parametrize("strategy", ["stratified", "uniform"])
def test_draws_from_a_list_are_those_in_order(spark, monkeypatch, strategy):
    df = spark.range(600).select("id", F.concat(F.lit("c"), (F.col("id") * F.col("id") % 13).cast("string")).alias("y"))
    folded = prep.stratified_kfold(df, "id", "y", 4).persist()
    counts = baselines.fold_class_counts(folded, "y", k=4)
    listed = rows(baselines.drawn_predictions(folded, counts, "id", "y", strategy=strategy), "id", "fold", "y_pred")
    monkeypatch.setattr(baselines, "LISTED", 0)
    assert listed == rows(baselines.drawn_predictions(folded, counts, "id", "y", strategy=strategy), "id", "fold", "y_pred") and len(listed) == 600


def test_short_series_take_one_exchange(spark):
    df = spark.range(50).select((F.col("id") % 3).alias("series_id"), F.col("id").alias("period"), F.col("id").cast("double").alias("value"))
    for out in (forecast.baseline_seasonal_naive(df), forecast.baseline_naive(df), forecast.walk_forward(df)):
        plan = out._jdf.queryExecution().sparkPlan().toString()
        out.collect()
        done = out._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and done.count("Exchange hashpartitioning") <= 2  # one, shown in the first and in the final plan


def test_walk_forward_of_hot_series(spark, small_chunks):
    df = spark.range(70).select((F.col("id") >= 64).cast("int").alias("series_id"), F.col("id").alias("period"), F.col("id").cast("double").alias("value"))
    assert rows(forecast.walk_forward(df, 3), "period", "position", "test_fold") == [
        (i, i + 1 if i < 64 else i - 63, (1 + (i - 16) // 16 if i >= 16 else None) if i < 64 else (1 + (i - 67) if i >= 67 else None)) for i in range(70)
    ]


def test_walk_forward_blocks_and_lags(spark):
    df = spark.range(14).select(F.lit("s").alias("series_id"), F.col("id").alias("period"), F.col("id").cast("double").alias("value")).repartition(3)
    folds = rows(forecast.walk_forward(df, 3), "period", "test_fold", "trains_from")
    assert [f for _, f, _ in folds] == [None] * 5 + [1] * 3 + [2] * 3 + [3] * 3
    assert [t for _, _, t in folds] == [1] * 5 + [2] * 3 + [3] * 3 + [None] * 3
    assert [f for _, f in rows(forecast.baseline_seasonal_naive(df, 4), "period", "forecast")] == [None] * 4 + [float(i) for i in range(10)]
