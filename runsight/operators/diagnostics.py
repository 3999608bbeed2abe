"""Where a model fails: prediction tables with ``row_id``, ``y_true``, ``y_pred`` and optionally ``proba``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runsight.functions.values import clean_floats, fixed, is_wrong, pearson
from runsight.operators.metrics import confusion_counts
from runsight.plans.sizing import broadcast_if_small

TOP = 5  # fixed value: rows a report lists


def prediction_error(pred: DataFrame) -> DataFrame:
    error = F.col("y_pred").cast("double") - F.col("y_true").cast("double")
    return pred.withColumn("error", error).withColumn("abs_error", F.abs(error))


def worst_predictions(pred: DataFrame, top_n: int = TOP, by: Sequence[str] = ()) -> DataFrame:
    """Largest absolute errors, overall or per group; of equal errors the later row comes first."""
    rows = prediction_error(clean_floats(pred)).where(F.col("abs_error").isNotNull()).select(*by, "row_id", "y_true", "y_pred", "abs_error")
    order = [F.desc("abs_error"), F.desc("row_id")]
    if not by:
        return rows.orderBy(*order).limit(top_n)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= top_n)


def bias(pred: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean error and whether the model predicts over or under."""
    mean = prediction_error(clean_floats(pred)).groupBy(*by).agg(F.avg("error").alias("magnitude"))
    return mean.select(
        *by,
        F.when(F.col("magnitude") > 0, "over").when(F.col("magnitude") < 0, "under").otherwise("neutral").alias("direction"),
        "magnitude",
    )


def join_features(pred: DataFrame, features: DataFrame, key: str = "row_id") -> DataFrame:
    """Predictions next to their features. The key is unique on both sides, so no partition grows hot."""
    return pred.join(features, key)


def feature_error_correlation(joined: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Correlation of each feature with the absolute error: (by..., feature, correlation).

    One aggregate for all features; constant features have no correlation and no row.
    """
    rows = prediction_error(clean_floats(joined))
    wide = rows.groupBy(*by).agg(*[pearson(F.col(f"`{c}`"), F.col("abs_error")).alias(f"r{i}") for i, c in enumerate(features)])
    pairs = [F.struct(F.lit(c).alias("feature"), F.col(f"r{i}").alias("correlation")) for i, c in enumerate(features)]
    return wide.select(*by, F.inline(F.array(*pairs))).where(F.col("correlation").isNotNull())


def rank_correlations(correlations: DataFrame) -> DataFrame:
    return correlations.orderBy(F.desc(F.abs("correlation")), "feature")


def misclassified(pred: DataFrame) -> DataFrame:
    """Wrong rows; two missing values count as equal."""
    return pred.where(is_wrong(F.col("y_true"), F.col("y_pred")))


def misclassified_samples(pred: DataFrame, top_n: int = TOP) -> DataFrame:
    """First wrong rows, or the most confident ones where probabilities are given."""
    wrong = misclassified(pred)
    if "proba" not in pred.columns:
        return wrong.select("row_id", "y_true", "y_pred").orderBy("row_id").limit(top_n)
    return (
        wrong.select("row_id", "y_true", "y_pred", F.array_max("proba").alias("confidence"))
        .orderBy(F.desc("confidence"), F.desc("row_id"))
        .limit(top_n)
    )


def per_class_accuracy(pred: DataFrame) -> DataFrame:
    return (
        pred.groupBy(F.col("y_true").alias("class"))
        .agg(F.avg(F.col("y_true").eqNullSafe(F.col("y_pred")).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))
    )


def confused_pairs(pred: DataFrame, top_n: int = TOP) -> DataFrame:
    """Most frequent (true, predicted) mistakes; equal counts in order of first occurrence."""
    pairs = misclassified(pred).groupBy("y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first_row"))
    return pairs.orderBy(F.desc("n"), "first_row").limit(top_n)


def confusion_matrix(pred: DataFrame, classes: Sequence[object] | None = None) -> DataFrame:
    """Counts of all (true, predicted) pairs in long form, or one column per class in ``classes``."""
    counts = confusion_counts(pred)
    if classes is None:
        return counts
    return counts.groupBy("y_true").pivot("y_pred", list(classes)).agg(F.sum("n")).na.fill(0)


def apply_class_names(pred: DataFrame, names: DataFrame, columns: Sequence[str] = ("y_true", "y_pred")) -> DataFrame:
    """Replace class ids by names. Names: class_id, class_name."""
    known = broadcast_if_small(names.select("class_id", "class_name"))
    for column in columns:
        side = known.select(F.col("class_id").alias(column), F.col("class_name").alias("_name"))
        pred = pred.join(side, column, "left").withColumn(column, F.col("_name")).drop("_name")
    return pred


def _section(df: DataFrame, section: str, key: Column, value: Column, rank: Column) -> DataFrame:
    return df.select(
        F.lit(section).alias("section"), rank.cast("long").alias("rank"), key.cast("string").alias("key"), value.cast("string").alias("value")
    )


def _ranked(df: DataFrame, *order: Column) -> DataFrame:
    """Number the rows of a small result (a top list or one row per feature or class)."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def diagnostics_report(
    pred: DataFrame, classification: bool, features: Sequence[str] = (), top_n: int = TOP
) -> DataFrame:
    """All diagnostics of one prediction table as rows (section, rank, key, value)."""
    rank = F.col("_rank")
    if not classification:
        worst = _ranked(worst_predictions(pred, top_n), F.desc("abs_error"), F.desc("row_id"))
        out = _section(worst, "worst_prediction", F.col("row_id"), fixed(F.col("abs_error"), 4), rank)
        out = out.unionByName(_section(bias(pred), "bias", F.col("direction"), fixed(F.col("magnitude"), 4), F.lit(1)))
        if features:
            corr = _ranked(feature_error_correlation(pred, features), F.desc(F.abs("correlation")), F.col("feature"))
            out = out.unionByName(_section(corr, "feature_correlation", F.col("feature"), fixed(F.col("correlation"), 4), rank))
        return out
    order = [F.col("row_id")] if "proba" not in pred.columns else [F.desc("confidence"), F.desc("row_id")]
    missed = _ranked(misclassified_samples(pred, top_n), *order)
    guess = F.concat(F.col("y_true").cast("string"), F.lit(" -> "), F.col("y_pred").cast("string"))
    out = _section(missed, "misclassified", F.col("row_id"), guess, rank)
    out = out.unionByName(_section(per_class_accuracy(pred), "class_accuracy", F.col("class"), fixed(F.col("accuracy"), 4), F.lit(0)))
    pairs = _ranked(confused_pairs(pred, top_n), F.desc("n"), F.col("first_row"))
    return out.unionByName(_section(pairs, "confused_pair", guess, F.col("n"), rank))
