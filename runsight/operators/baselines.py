"""Naive baselines, cross-validated over the given folds, and the gate that compares with all of them."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runsight.functions.values import check_direction
from runsight.operators.metrics import ROW_METRICS, confusion_counts, over_folds, score_counts
from runsight.operators.prep import FOLDS, SEED, kfold, stratified_kfold
from runsight.operators.profile import class_count
from runsight.plans.hashorder import unit_draw
from runsight.plans.quantile import exact_medians
from runsight.plans.running import Running, running_global
from runsight.session import materialize

#: Classes, over all folds, that are looked up in a list.
LISTED = 512
# Share of the random-guess loss that the second loss baseline stands for.
UNIFORM_SHARE = 0.95
UNTRAINED_SHARE = 0.8
VOCABULARY = 32_000
BASELINE = "name string, score double, std double"


# --- the gate -------------------------------------------------------------------------------------


def baseline_gate(metrics: DataFrame, baselines: DataFrame, direction: str = "maximize", metric: str = "metric_value") -> DataFrame:
    """Add ``passes_gate``: strictly better than every baseline; with no baselines every row passes.

    Beating all is beating the best, so the table is compared with one number.
    """
    best = F.max("score") if check_direction(direction) == "maximize" else F.min("score")
    bar = baselines.agg(best.alias("bar")).first()["bar"]
    if bar is None:
        return metrics.withColumn("passes_gate", F.lit(True))
    value = F.col(metric).cast("double")
    passed = value > F.lit(bar) if direction == "maximize" else value < F.lit(bar)
    return metrics.withColumn("passes_gate", F.coalesce(passed & ~F.isnan(value), F.lit(False)))


def beats_baselines(baselines: DataFrame, metric_value: float, direction: str = "maximize") -> DataFrame:
    """(name, score, beaten) per baseline."""
    beaten = F.lit(metric_value) > F.col("score") if check_direction(direction) == "maximize" else F.lit(metric_value) < F.col("score")
    return baselines.select("name", "score", beaten.alias("beaten"))


def beats_all(flags: DataFrame) -> DataFrame:
    return flags.agg(F.coalesce(F.bool_and("beaten"), F.lit(True)).alias("beats_all"))


# --- class baselines --------------------------------------------------------------------------------


def fold_class_counts(folded: DataFrame, label: str, fold: str = "fold", k: int = FOLDS) -> DataFrame:
    """(fold, label, in_fold, in_train) for every fold and class, written out: the baselines read it several times."""
    counts = folded.where(F.col(label).isNotNull()).groupBy(F.col(fold).alias("fold"), F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("label").agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("fold", "n"))).alias("per_fold"))
    every = totals.select("label", "total", "per_fold", F.explode(F.array(*[F.lit(i) for i in range(k)])).alias("fold"))
    inside = F.coalesce(F.try_element_at("per_fold", F.col("fold")), F.lit(0).cast("long"))
    return materialize(every.select("fold", "label", inside.alias("in_fold"), (F.col("total") - inside).alias("in_train")))


def most_frequent_scores(counts: DataFrame, metric: str) -> DataFrame:
    """(fold, score) of predicting the commonest training class, the smallest of equals. Counts: see ``fold_class_counts``."""
    mode = counts.groupBy("fold").agg(F.min(F.struct(-F.col("in_train"), F.col("label"))).alias("m"))
    # k rows, one per fold
    predicted = counts.join(F.broadcast(mode.select("fold", F.col("m.label").alias("y_pred"))), "fold")
    pairs = predicted.where(F.col("in_fold") > 0).select("fold", F.col("label").alias("y_true"), "y_pred", F.col("in_fold").alias("n"))
    return score_counts(pairs, metric, ["fold"])


def expected_accuracy(counts: DataFrame, strategy: str = "stratified") -> DataFrame:
    """(fold, score): accuracy a random guess reaches on average, by training frequencies or uniformly."""
    sums = counts.groupBy("fold").agg(F.sum("in_fold").alias("_test"), F.sum("in_train").alias("_train"), F.count(F.lit(1)).alias("_classes"))  # one row per fold
    rows = counts.join(F.broadcast(sums), "fold")
    guess = F.col("in_train") / F.col("_train") if strategy == "stratified" else F.lit(1.0) / F.col("_classes")
    return rows.select("fold", (guess * F.col("in_fold") / F.col("_test")).alias("s")).groupBy("fold").agg(F.sum("s").alias("score"))


def drawn_predictions(
    folded: DataFrame,
    counts: DataFrame,
    key: str,
    label: str,
    fold: str = "fold",
    strategy: str = "stratified",
    seed: int = SEED,
) -> DataFrame:
    """Random class per row, repeatable: (key, fold, y_true, y_pred).

    The draw is a hash of the key, looked up in the training shares of the classes ('stratified') or in
    equal shares ('uniform').
    """
    weight = F.col("in_train") if strategy == "stratified" else F.lit(1).cast("long")
    weighted = counts.select("fold", "label", weight.alias("weight"))
    rows = folded.select(F.col(key), F.col(fold).alias("fold"), F.col(label).alias("y_true"), unit_draw(key, seed).alias("_u"))
    rows = rows.where(F.col("y_true").isNotNull())
    return _drawn_by_list(rows, weighted, key) if counts.count() <= LISTED else _drawn_by_order(rows, weighted, key)


def _drawn_by_list(rows: DataFrame, weighted: DataFrame, key: str) -> DataFrame:
    """For few classes: each fold's classes with their starts in [0, 1) are one list, and a row takes the last that started before it. The same draw as ``_drawn_by_order``."""
    window = Window.partitionBy("fold")  # at most ``LISTED`` rows in all
    before = F.coalesce(F.sum("weight").over(window.orderBy("label").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = weighted.select("fold", "label", "weight", (before / F.sum("weight").over(window)).alias("at")).where(F.col("weight") > 0)
    lists = starts.groupBy("fold").agg(F.array_sort(F.collect_list(F.struct("at", "label"))).alias("_starts"))  # one row per fold
    begun = lambda s: s["at"] <= F.col("_u")
    met = rows.join(F.broadcast(lists), "fold")
    return met.select(key, "fold", "y_true", F.element_at(F.filter("_starts", begun), -1)["label"].alias("y_pred"))


def _drawn_by_order(rows: DataFrame, weighted: DataFrame, key: str) -> DataFrame:
    """For any number of classes: classes and rows are merged in order of their place in [0, 1), and each
    row takes the class that started last before it."""
    started = running_global(weighted, "label", [Running("_start", "sum", F.col("weight"), before=True)], ["fold"])
    totals = weighted.groupBy("fold").agg(F.sum("weight").alias("_total"))  # one row per fold
    starts = started.where(F.col("weight") > 0).join(F.broadcast(totals), "fold")
    place = lambda at, kind, k: F.struct(at.alias("at"), F.lit(kind).alias("kind"), k.alias("k")).alias("_place")
    at = F.col("_start") / F.col("_total")
    none = lambda c: F.lit(None).cast(rows.schema[c].dataType).alias(c)
    opened = starts.select("fold", place(at, 0, F.col("label").cast("string")), F.struct(at.alias("at"), "label").alias("_from"), none(key), none("y_true"))
    drawn = rows.select("fold", place(F.col("_u"), 1, F.col(key).cast("string")), F.lit(None).cast(opened.schema["_from"].dataType).alias("_from"), key, "y_true")
    merged = running_global(opened.unionByName(drawn), "_place", [Running("_last", "max", F.col("_from"))], ["fold"])
    return merged.where(F.col("_place.kind") == 1).select(key, "fold", "y_true", F.col("_last.label").alias("y_pred"))


# --- regression baselines ---------------------------------------------------------------------------


def mean_constants(folded: DataFrame, target: str, fold: str = "fold") -> dict[int, float | None]:
    """Training mean per held-out fold, from the sums of all folds."""
    rows = folded.where(F.col(target).isNotNull()).groupBy(fold).agg(F.sum(F.col(target).cast("double")).alias("s"), F.count(F.lit(1)).alias("n")).collect()
    total, n = math.fsum(r["s"] for r in rows), sum(r["n"] for r in rows)
    return {r[fold]: (total - r["s"]) / (n - r["n"]) if n > r["n"] else None for r in rows}


def median_constants(folded: DataFrame, target: str, fold: str = "fold", k: int = FOLDS) -> dict[int, float | None]:
    """Training median per held-out fold: one column per fold that hides the fold's own rows, no copies of the table."""
    outside = {str(i): F.when(F.col(fold) != i, F.col(target)) for i in range(k)}
    return {int(i): v for i, v in exact_medians(folded, outside).items()}


def constant_scores(folded: DataFrame, target: str, constants: dict[int, float | None], metric: str, fold: str = "fold") -> DataFrame:
    """(fold, score) of predicting one number per fold."""
    lookup = F.create_map(*[x for i, v in constants.items() for x in (F.lit(i), F.lit(v).cast("double"))])
    rows = folded.select(F.col(fold).alias("fold"), F.col(target).cast("double").alias("y"), lookup[F.col(fold)].alias("p"))
    return rows.where(F.col("y").isNotNull()).groupBy("fold").agg(ROW_METRICS[metric](F.col("y"), F.col("p")).alias("score"))


# --- all baselines of a task ------------------------------------------------------------------------


def compute_baselines(df: DataFrame, key: str, target: str, task: str, metric: str, k: int = FOLDS, seed: int = SEED) -> DataFrame:
    """(name, score, std) of a table's baselines.

    Tasks: 'classification' (most frequent, stratified), 'regression' (mean, median), and the image and
    text tasks (random, most frequent; the folds are min(k, classes)). ``metric='loss'`` of those is closed form.
    """
    narrow = df.select(key, target)
    if task == "regression":
        folded = kfold(narrow, key, k, seed)  # a projection, cheaper to repeat than to store
        scores = {
            "mean": constant_scores(folded, target, mean_constants(folded, target), metric),
            "median": constant_scores(folded, target, median_constants(folded, target, k=k), metric),
        }
    else:
        vision = task != "classification"
        if vision and metric == "loss":
            return baseline_loss_classes(df, target)
        if vision:
            k = min(k, class_count(df, target).first()["n_classes"])
        folded = materialize(stratified_kfold(narrow, key, target, k, seed))
        strategy = "uniform" if vision else "stratified"
        counts = fold_class_counts(folded, target, k=k)
        drawn = drawn_predictions(folded, counts, key, target, strategy=strategy, seed=seed)
        scores = {
            "most_frequent": most_frequent_scores(counts, metric),
            "random" if vision else "stratified": score_counts(confusion_counts(drawn, ["fold"]), metric, ["fold"]),
        }
    return _table(scores)


def _table(scores: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, per_fold in scores.items():
        row = over_folds(per_fold).select(F.lit(name).alias("name"), "score", "std")
        out = row if out is None else out.unionByName(row)
    return out


def baseline_loss_classes(df: DataFrame, label: str) -> DataFrame:
    """Cross-entropy of guessing among k classes, and a slightly better one."""
    guess = F.log(F.col("n_classes").cast("double"))
    return _loss_rows(class_count(df, label), {"random_guess": guess, "uniform_prediction": guess * UNIFORM_SHARE})


def baseline_loss_vocab(spark: SparkSession, metric: str = "loss", vocab_size: int = VOCABULARY) -> DataFrame:
    """Loss or perplexity of guessing among the tokens of a vocabulary, and of an untrained model."""
    guess = float(vocab_size) if metric == "perplexity" else math.log(vocab_size)
    return spark.createDataFrame([("random_guess", guess, 0.0), ("untrained_model", UNTRAINED_SHARE * guess, 0.0)], BASELINE)


def baseline_loss_vocab_of(vocabulary: DataFrame, metric: str = "loss") -> DataFrame:
    """The same from a table with one row and column ``vocab_size``."""
    size = F.col("vocab_size").cast("double")
    guess = size if metric == "perplexity" else F.log(size)
    return _loss_rows(vocabulary, {"random_guess": guess, "untrained_model": guess * UNTRAINED_SHARE})


def _loss_rows(one_row: DataFrame, scores: dict[str, Column]) -> DataFrame:
    rows: Sequence[Column] = [
        F.struct(F.lit(name).alias("name"), value.alias("score"), F.lit(0.0).alias("std")) for name, value in scores.items()
    ]
    return one_row.select(F.inline(F.array(*rows)))
