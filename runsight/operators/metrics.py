"""Scores of prediction tables, whole or per group (fold, run, segment).

Class metrics come from confusion counts, regression metrics from one aggregate: either way rows
are combined before the shuffle. ``by`` names the group columns.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runsight.functions.values import ratio
from runsight.plans.running import Running, running_global

EPSILON = 2.220446049250313e-16  # fixed value: probabilities are kept this far from 0 and 1


# --- aggregate expressions over rows ------------------------------------------------------------


def accuracy(y: Column, p: Column) -> Column:
    return F.avg(y.eqNullSafe(p).cast("double"))


def mse(y: Column, p: Column) -> Column:
    return F.avg(F.pow(y.cast("double") - p, F.lit(2.0)))


def rmse(y: Column, p: Column) -> Column:
    return F.sqrt(mse(y, p))


def mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(y.cast("double") - p))


def r2(y: Column, p: Column) -> Column:
    """1 - residual / total variance; of a constant truth 1 when hit exactly, else 0."""
    both = y.isNotNull() & p.isNotNull()
    residual, total = mse(y, p), F.var_pop(F.when(both, y.cast("double")))
    return F.when(total == 0, (residual == 0).cast("double")).otherwise(1 - F.try_divide(residual, total))


def mape(y: Column, p: Column) -> Column:
    """Mean absolute percentage error as a share; rows with truth 0 are left out."""
    return F.avg(F.abs(F.try_divide(y.cast("double") - p, y.cast("double"))))


def log_loss(y: Column, probability: Column) -> Column:
    """Binary: ``y`` is 0 or 1, ``probability`` that of 1."""
    return true_class_loss(F.when(y == 1, probability).otherwise(1 - probability))


def true_class_loss(probability: Column) -> Column:
    """Log loss from the probability given to the true class."""
    return -F.avg(F.log(F.greatest(F.least(probability, F.lit(1 - EPSILON)), F.lit(EPSILON))))


def mean_loss(loss: Column) -> Column:
    return F.avg(loss)


def perplexity(loss: Column) -> Column:
    """exp of the mean loss; 1 for no rows."""
    return F.exp(F.coalesce(F.sum(loss), F.lit(0.0)) / F.greatest(F.count(loss), F.lit(1)))


ROW_METRICS: dict[str, Callable[[Column, Column], Column]] = {
    "mse": mse,
    "rmse": rmse,
    "mae": mae,
    "r2": r2,
    "mape": mape,
    "log_loss": log_loss,
}


# --- class metrics from confusion counts ----------------------------------------------------------


def confusion_counts(pred: DataFrame, by: Sequence[str] = (), y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """(by..., y_true, y_pred, n): all a class metric needs to know."""
    return pred.groupBy(*by, F.col(y).alias("y_true"), F.col(p).alias("y_pred")).agg(F.count(F.lit(1)).alias("n"))


def class_scores(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support per class."""
    hit = F.when(F.col("y_true").eqNullSafe(F.col("y_pred")), F.col("n")).otherwise(F.lit(0))
    zero = F.lit(0).cast("long")
    side = lambda c, *n: F.struct(c.alias("class"), *[v.alias(k) for k, v in zip(("support", "predicted", "hits"), n)])
    sides = counts.select(
        *by, F.inline(F.array(side(F.col("y_true"), F.col("n"), zero, hit), side(F.col("y_pred"), zero, F.col("n"), zero)))
    )
    summed = sides.groupBy(*by, "class").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits")])
    return summed.select(
        *by,
        "class",
        "support",
        ratio(F.col("hits"), F.col("predicted")).alias("precision"),
        ratio(F.col("hits"), F.col("support")).alias("recall"),
        ratio(2 * F.col("hits"), F.col("support") + F.col("predicted")).alias("f1"),
    )


def binary_scores(counts: DataFrame, by: Sequence[str] = (), positive: object = 1) -> DataFrame:
    """Accuracy, precision, recall, F1 and AUC of hard 0/1 predictions."""
    truth, guess = F.col("y_true") == F.lit(positive), F.col("y_pred") == F.lit(positive)
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    cells = counts.groupBy(*by).agg(
        total(truth & guess).alias("tp"), total(~truth & guess).alias("fp"), total(truth & ~guess).alias("fn"), total(~truth & ~guess).alias("tn")
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return cells.select(
        *by,
        ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        ((1 + F.try_divide(tp.cast("double"), tp + fn) - F.try_divide(fp.cast("double"), fp + tn)) / 2).alias("auc"),
    )


def score_counts(counts: DataFrame, metric: str, by: Sequence[str] = (), positive: object = 1) -> DataFrame:
    """(by..., score) of a class metric from confusion counts."""
    hit = F.col("y_true").eqNullSafe(F.col("y_pred"))
    share = F.sum(F.when(hit, F.col("n")).otherwise(F.lit(0))) / F.sum("n")
    if metric == "accuracy":
        return counts.groupBy(*by).agg(share.alias("score"))
    if metric == "log_loss":  # hard predictions have probability 1 for the predicted class
        return counts.groupBy(*by).agg(((share - 1) * F.log(F.lit(EPSILON))).alias("score"))
    if metric == "f1_weighted":
        weighted = F.sum(F.col("support") * F.col("f1")) / F.sum("support")
        return class_scores(counts, by).groupBy(*by).agg(weighted.alias("score"))
    column = "auc" if metric == "roc_auc" else metric
    if column not in ("precision", "recall", "f1", "auc"):
        raise ValueError(f"{metric!r} is not a class metric")
    return binary_scores(counts, by, positive).select(*by, F.col(column).alias("score"))


# --- ranking ---------------------------------------------------------------------------------------


def auc(pred: DataFrame, by: Sequence[str] = (), y: str = "y_true", score: str = "score") -> DataFrame:
    """Exact area under the ROC curve, ties counted half: (by..., auc).

    Rows are first combined per distinct score. The running count of negatives below each score
    is taken over range partitions, so continuous scores do not end in one task.
    """
    positive = F.col(y) == 1
    counts = (
        pred.where(F.col(score).isNotNull() & F.col(y).isNotNull())
        .groupBy(*by, F.col(score).alias("_s"))
        .agg(F.count_if(positive).alias("_pos"), F.count_if(~positive).alias("_neg"))
    )
    ranked = running_global(counts, "_s", [Running("_below", "sum", F.col("_neg"), before=True)], by)
    won = F.sum(F.col("_pos") * (F.col("_below") + F.col("_neg") / 2))
    pairs = F.sum("_pos").cast("double") * F.sum("_neg")
    return ranked.groupBy(*by).agg(F.try_divide(won, pairs).alias("auc"))


# --- one entry point, cross-validation -----------------------------------------------------------------


def score(pred: DataFrame, metric: str, by: Sequence[str] = (), y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """(by..., score) of any metric over predictions; probabilities or scores go in ``p`` for auc and log_loss."""
    if metric in ROW_METRICS:
        return pred.groupBy(*by).agg(ROW_METRICS[metric](F.col(y), F.col(p)).alias("score"))
    if metric in ("auc", "roc_auc"):
        return auc(pred, by, y, p).withColumnRenamed("auc", "score")
    if metric in ("loss", "perplexity"):
        return pred.groupBy(*by).agg((mean_loss if metric == "loss" else perplexity)(F.col(p)).alias("score"))
    return score_counts(confusion_counts(pred, by, y, p), metric, by)


def over_folds(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean and population deviation of per-fold scores."""
    return scores.groupBy(*by).agg(F.avg("score").alias("score"), F.stddev_pop("score").alias("std"))


def cross_validate(pred: DataFrame, metric: str, fold: str = "fold", by: Sequence[str] = (), y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Mean and deviation over folds of predictions made for the held-out rows."""
    return over_folds(score(pred, metric, [*by, fold], y, p), by)
