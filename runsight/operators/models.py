"""Models on Spark ML: preprocessing as a pipeline stage, the model families, seeded search, refit, drafts."""

from __future__ import annotations

import json
import math
import random
import statistics
import time
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import partial

from py4j.protocol import Py4JError, Py4JNetworkError
from pyspark import inheritable_thread_target
from pyspark.errors import PySparkException
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runsight.functions.values import clean_floats
from runsight.operators.catalog import direction_of
from runsight.operators.forests import RegressionForest
from runsight.operators.prep import (
    FOLDS,
    SEED,
    column_medians,
    column_modes,
    fill,
    kfold,
    moments,
    numeric_columns,
    scaled,
    split_train_test,
    stratified_kfold,
    string_columns,
)
from runsight.session import materialize

# The search space and its size.
TRIALS = 20
TREES = (50, 300)
DEPTH = (3, 15)
INVERSE_PENALTY = (1e-3, 100.0)
PENALTY = (1e-3, 100.0)
LOGISTIC_ITERATIONS = 500
#: Trials and folds that run at a time.
PARALLEL = 4
#: Solvers report through Spark or the JVM.
SOLVER_ERRORS = (ValueError, TypeError, PySparkException, Py4JError)
#: Causes in the JVM, and words in messages, of a job that broke: files, disk, memory, executors. No solver reports so.
BROKEN_CAUSES = ("java.io.IOException", "java.lang.VirtualMachineError")
BROKEN_WORDS = ("ExecutorLostFailure", "FetchFailed", "SparkContext was shut down")


class _Columns(Params):
    numeric = Param(Params._dummy(), "numeric", "columns to impute by median and scale", TypeConverters.toListString)
    text = Param(Params._dummy(), "text", "columns to impute by mode", TypeConverters.toListString)

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(numeric=[], text=[])


class ImputeAndScale(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Median and mode imputing, then scaling by mean and population deviation, fitted on the training rows."""

    def __init__(self, numeric: Sequence[str] = (), text: Sequence[str] = ()) -> None:
        super().__init__()
        self._set(numeric=list(numeric), text=list(text))

    def _fit(self, dataset: DataFrame) -> ImputeAndScaleModel:
        numeric, text = self.getOrDefault("numeric"), self.getOrDefault("text")
        rows = clean_floats(dataset)
        medians = column_medians(rows, numeric) if numeric else {}
        modes = column_modes(rows, text) if text else {}
        scales = moments(fill(_doubles(rows, numeric), medians), numeric) if numeric else {}
        fitted = json.dumps({"medians": medians, "modes": modes, "scales": scales})
        return ImputeAndScaleModel()._set(numeric=numeric, text=text, fitted=fitted)


class ImputeAndScaleModel(Model, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    fitted = Param(Params._dummy(), "fitted", "learned values as JSON", TypeConverters.toString)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        values = json.loads(self.getOrDefault("fitted"))
        numeric = self.getOrDefault("numeric")
        rows = fill(_doubles(clean_floats(dataset), numeric), {**values["medians"], **values["modes"]})
        # A column that was missing throughout has no median: it carries nothing and becomes 0.
        return rows.withColumns(
            {c: F.coalesce(scaled(c, m or 0.0, d), F.lit(0.0)) for c, (m, d) in values["scales"].items()}
        )


def _doubles(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.col(f"`{c}`").cast("double") for c in columns}) if columns else df


def build_preprocessor(df: DataFrame, exclude: Sequence[str] = ()) -> Pipeline:
    """Unfitted pipeline to a ``features`` vector: numbers imputed and scaled, strings imputed and one-hot encoded,
    everything else left out. Categories not seen in training encode to zeros."""
    numeric = [c for c in numeric_columns(df) if c not in exclude]
    text = [c for c in string_columns(df) if c not in exclude]
    stages: list = [ImputeAndScale(numeric, text)]
    if text:
        stages.append(StringIndexer(inputCols=text, outputCols=[f"{c}_index" for c in text], handleInvalid="keep", stringOrderType="alphabetAsc"))
        stages.append(OneHotEncoder(inputCols=[f"{c}_index" for c in text], outputCols=[f"{c}_hot" for c in text], dropLast=True))
    stages.append(VectorAssembler(inputCols=numeric + [f"{c}_hot" for c in text], outputCol="features"))
    return Pipeline(stages=stages)


# --- model families ---------------------------------------------------------------------------------


class Linear(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Ridge regression (``penalty`` is alpha of |y - Xw|^2 + alpha |w|^2) or logistic regression (``penalty`` is the inverse strength C), fitted with the penalty per row that the solvers take.

    The regression solver scales the label to a deviation of 1 before it applies the penalty, so that the penalty has to be multiplied by it.
    """

    task = Param(Params._dummy(), "task", "regression or classification", TypeConverters.toString)
    penalty = Param(Params._dummy(), "penalty", "alpha, or C", TypeConverters.toFloat)

    def __init__(self, task: str = "classification", penalty: float = 1.0) -> None:
        super().__init__()
        self._set(task=task, penalty=penalty)

    def _fit(self, dataset: DataFrame) -> Model:
        penalty, label = self.getOrDefault("penalty"), F.col("label").cast("double")
        facts = dataset.agg(F.count(label).alias("n"), F.stddev_pop(label).alias("spread")).first()
        n = max(facts["n"], 1)
        if self.getOrDefault("task") == "regression":
            strength = penalty * (facts["spread"] or 1.0) / n
            return LinearRegression(labelCol="label", regParam=strength, elasticNetParam=0.0, standardization=False).fit(dataset)
        return LogisticRegression(labelCol="label", regParam=1.0 / (penalty * n), maxIter=LOGISTIC_ITERATIONS, standardization=False).fit(dataset)


def linear(task: str, penalty: float = 1.0) -> Estimator:
    """Logistic regression (``penalty`` is the inverse strength C) or ridge (``penalty`` is alpha)."""
    return Linear(task, penalty)


def random_forest(task: str, trees: int = 100, depth: int = 10, seed: int = SEED) -> Estimator:
    if task == "regression":
        return RegressionForest(trees, depth, seed)
    return RandomForestClassifier(labelCol="label", numTrees=trees, maxDepth=depth, seed=seed)


def boosted_trees(task: str, classes: int = 2, rounds: int = 20, depth: int = 5, seed: int = SEED) -> Estimator:
    if task == "regression":
        return GBTRegressor(labelCol="label", maxIter=rounds, maxDepth=depth, seed=seed)
    model = GBTClassifier(labelCol="label", maxIter=rounds, maxDepth=depth, seed=seed)
    return model if classes <= 2 else OneVsRest(classifier=model, labelCol="label")


def linear_svm(classes: int = 2, penalty: float = 1.0, rows: int = 1, iterations: int = 100) -> Estimator:
    """Linear support vectors, classification only."""
    model = LinearSVC(labelCol="label", regParam=1.0 / (penalty * max(rows, 1)), maxIter=iterations)
    return model if classes <= 2 else OneVsRest(classifier=model, labelCol="label")


def evaluator(metric: str):
    """Spark ML evaluator of a metric name."""
    if metric in ("rmse", "mae", "mse", "r2"):
        return RegressionEvaluator(labelCol="label", metricName=metric)
    if metric in ("auc", "roc_auc"):
        return BinaryClassificationEvaluator(labelCol="label", metricName="areaUnderROC")
    names = {"accuracy": "accuracy", "f1_weighted": "f1", "log_loss": "logLoss"}
    if metric in names:
        return MulticlassClassificationEvaluator(labelCol="label", metricName=names[metric])
    by_label = {"f1": "fMeasureByLabel", "precision": "precisionByLabel", "recall": "recallByLabel"}
    return MulticlassClassificationEvaluator(labelCol="label", metricName=by_label[metric], metricLabel=1.0)


# --- search, refit, drafts ---------------------------------------------------------------------------


def with_folds(train: DataFrame, key: str, task: str, k: int = FOLDS, seed: int = SEED) -> DataFrame:
    folded = kfold(train, key, k, seed) if task == "regression" else stratified_kfold(train, key, "label", k, seed)
    return folded.withColumn("fold", F.col("fold").cast("int"))


def draw_trials(task: str, n_trials: int = TRIALS, seed: int = SEED) -> list[tuple[str, dict]]:
    """Seeded random points of the search space: (family, parameters)."""
    draw = random.Random(seed)
    log_uniform = lambda low, high: math.exp(draw.uniform(math.log(low), math.log(high)))
    out: list[tuple[str, dict]] = []
    for _ in range(n_trials):
        if draw.random() < 0.5:
            out.append(("random_forest", {"trees": draw.randint(*TREES), "depth": draw.randint(*DEPTH)}))
        else:
            out.append(("linear", {"penalty": log_uniform(*(PENALTY if task == "regression" else INVERSE_PENALTY))}))
    return out


def trials(task: str, n_trials: int = TRIALS, seed: int = SEED) -> list[tuple[str, dict, Estimator]]:
    """Seeded random candidates: (family, parameters, estimator)."""
    build = {"random_forest": lambda p: random_forest(task, **p), "linear": lambda p: linear(task, **p)}
    return [(family, params, build[family](params)) for family, params in draw_trials(task, n_trials, seed)]


def cross_validated(train: DataFrame, estimator: Estimator, metric: str, exclude: Sequence[str], k: int = FOLDS) -> float:
    """Mean score over the ``fold`` column; the preprocessing is fitted inside each fold.

    ``CrossValidator`` does the same and then refits on all rows, which a search does not need per trial.
    """
    pipeline = Pipeline(stages=[*build_preprocessor(train, [*exclude, "label", "fold"]).getStages(), estimator])
    judge, scores = evaluator(metric), []
    for i in range(k):
        model = pipeline.fit(train.where(F.col("fold") != i))
        scores.append(judge.evaluate(model.transform(train.where(F.col("fold") == i))))
    return sum(scores) / k


def _at_once(spark: SparkSession, tasks: Sequence[Callable[[], object]], parallel: int) -> list:
    """Results of ``tasks``, up to ``parallel`` of them running at a time, each with a scheduler pool of its own, so that under fair scheduling none starves another."""

    def pooled(task: Callable[[], object], pool: str) -> Callable[[], object]:
        def run() -> object:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", pool)
            return task()

        return inheritable_thread_target(spark)(run)

    with ThreadPoolExecutor(max_workers=max(1, min(parallel, len(tasks) or 1))) as threads:
        running = [threads.submit(pooled(task, f"search-{i % parallel}")) for i, task in enumerate(tasks)]
        return [r.result() for r in running]


def job_broke(spark: SparkSession, error: Exception) -> bool:
    """Whether a job broke, instead of a solver that refused its rows or parameters."""
    if isinstance(error, Py4JNetworkError):
        return True
    kinds = [spark._jvm.java.lang.Class.forName(name) for name in BROKEN_CAUSES]
    cause = getattr(error, "_origin", None) or getattr(error, "java_exception", None)
    while cause is not None:
        message = cause.getMessage() or ""
        if any(k.isInstance(cause) for k in kinds) or any(w in message for w in BROKEN_WORDS):
            return True
        cause = cause.getCause()
    return False


def fold_vectors(folded: DataFrame, exclude: Sequence[str], k: int = FOLDS, parallel: int = PARALLEL) -> list[DataFrame]:
    """One table per fold with label, features and held_out. The preprocessing is fitted on the other folds, once, and its vectors are written: every trial reads them."""
    stages = build_preprocessor(folded, [*exclude, "label", "fold"])

    def vectors(i: int) -> DataFrame:
        fitted = stages.fit(folded.where(F.col("fold") != i))
        return materialize(fitted.transform(folded).select("label", "features", (F.col("fold") == i).alias("held_out")))

    return _at_once(folded.sparkSession, [partial(vectors, i) for i in range(k)], parallel)


def fold_score(table: DataFrame, estimator: Estimator, metric: str) -> float:
    model = estimator.fit(table.where("NOT held_out"))
    return float(evaluator(metric).evaluate(model.transform(table.where("held_out"))))


SEARCH = "trial int, family string, params string, score double, folds int, state string"


def search(
    train: DataFrame,
    key: str,
    task: str,
    metric: str,
    candidates: Sequence[tuple[str, dict, Estimator]],
    direction: str | None = None,
    timeout_minutes: float | None = None,
    k: int = FOLDS,
    parallel: int | None = None,
    prune_after: int | None = None,
) -> tuple[DataFrame, tuple[str, dict, Estimator]]:
    """Every candidate with its cross-validated score, and the best candidate. ``train`` has the target in ``label``.

    Folds are turned into vectors once. The folds of trials are jobs of their own, ``parallel`` at a time, as many as there are cores if it is not given: one on a small table is a single task. None but the first starts behind the deadline (state ``skipped``); one that has started ends. With
    ``prune_after``, all are scored on so many folds first, and those worse than the median are given up (``pruned``: the score is the mean of these folds and cannot win). The outcome does not
    depend on which trial ends first. Of equal scores the earlier trial wins. A candidate that cannot be fitted is ``failed`` and has no score; an error is raised only if none can be.
    """
    parallel = max(PARALLEL, train.sparkSession.sparkContext.defaultParallelism) if parallel is None else parallel
    folded = materialize(with_folds(train, key, task, k))
    maximize = direction_of(metric, direction) == "maximize"
    tables = fold_vectors(folded, [key], k, parallel)
    deadline = None if timeout_minutes is None else time.monotonic() + timeout_minutes * 60
    found: dict[int, dict[int, float]] = {i: {} for i in range(len(candidates))}
    failed: dict[int, list[int]] = {i: [] for i in found}
    started: set[int] = set()
    state = dict.fromkeys(found, "complete")

    def run(i: int, fold: int) -> None:
        if state[i] != "complete":
            return
        if deadline is not None and i and i not in started and time.monotonic() > deadline:
            state[i] = "skipped"
            return
        started.add(i)
        try:
            found[i][fold] = fold_score(tables[fold], candidates[i][2].copy(), metric)
        except SOLVER_ERRORS:
            state[i] = "failed"
            failed[i].append(fold)

    rung = k if prune_after is None else min(prune_after, k)
    _at_once(train.sparkSession, [partial(run, i, fold) for i in found for fold in range(rung)], parallel)
    # Scores in the order of folds, up to the first that failed.
    scores = {i: [found[i][fold] for fold in sorted(found[i]) if fold < min(failed[i], default=k)] for i in found}
    mean = lambda i: sum(scores[i]) / len(scores[i])
    running = [i for i in scores if state[i] == "complete"]
    if rung < k and running:
        middle = statistics.median(mean(i) for i in running)
        for i in running:
            if (mean(i) < middle) if maximize else (mean(i) > middle):
                state[i] = "pruned"
        running = [i for i in running if state[i] == "complete"]
        _at_once(train.sparkSession, [partial(run, i, fold) for i in running for fold in range(rung, k)], parallel)
        scores = {i: [found[i][fold] for fold in sorted(found[i]) if fold < min(failed[i], default=k)] for i in found}
        running = [i for i in running if state[i] == "complete"]
    if not running:
        raise ValueError("no candidate could be fitted")
    best = (max if maximize else min)(running, key=lambda i: (mean(i), -i if maximize else i))
    rows = [
        (i, family, json.dumps(params, sort_keys=True), mean(i) if state[i] in ("complete", "pruned") else None, len(scores[i]), state[i])
        for i, (family, params, _) in enumerate(candidates)
    ]
    return train.sparkSession.createDataFrame(rows, SEARCH), candidates[best]


def retrain_and_predict(train: DataFrame, test: DataFrame, key: str, estimator: Estimator) -> tuple[PipelineModel, DataFrame]:
    """Refit on all training rows and predict the test rows: (row_id, y_true, y_pred)."""
    pipeline = Pipeline(stages=[*build_preprocessor(train, [key, "label"]).getStages(), estimator])
    model = pipeline.fit(train)
    scored = model.transform(test)
    return model, scored.select(F.col(key).alias("row_id"), F.col("label").alias("y_true"), F.col("prediction").alias("y_pred"))


def train_test(df: DataFrame, key: str, target: str, test_size: float = 0.2, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(train, test) with the target as a double column ``label``."""
    labelled = df.withColumn("label", F.col(target).cast("double"))
    marked = split_train_test(labelled.drop(target) if target != "label" else labelled, key, test_size, seed)
    return marked.where(~F.col("is_test")).drop("is_test"), marked.where(F.col("is_test")).drop("is_test")


def draft_phase(
    train: DataFrame, key: str, task: str, metric: str, families: dict[str, Callable[[], Estimator]], k: int = FOLDS, parallel: int = PARALLEL
) -> DataFrame:
    """One cross-validated run per family: (run_id, position, name, metric_value, status, commit_hash).

    Folds are turned into vectors once, as in ``search``; families are fitted side by side, ``parallel`` at a time. A family that cannot be fitted is recorded without a metric, and so are all of
    them if a fold leaves no rows to fit on. Whatever else fails, the preparation of the folds or a job that broke, is raised: it says nothing about a family.
    """
    folded = materialize(with_folds(train, key, task, k))

    def run(tables: Sequence[DataFrame], build: Callable[[], Estimator]) -> float | None:
        try:
            estimator = build()
            return sum(fold_score(t, estimator.copy(), metric) for t in tables) / k
        except SOLVER_ERRORS as error:
            if job_broke(train.sparkSession, error):
                raise
            return None

    if folded.where("fold IS NOT NULL").select("fold").distinct().count() < min(k, 2):  # the fold that holds all rows leaves none
        scores = [None] * len(families)
    else:
        tables = fold_vectors(folded, [key], k, parallel)
        scores = _at_once(train.sparkSession, [partial(run, tables, build) for build in families.values()], parallel)
    rows = [
        ("draft", i, name, score, "draft-discard" if score is None else "draft-keep", "" if score is None else f"draft-{name}")
        for i, (name, score) in enumerate(zip(families, scores))
    ]
    schema = "run_id string, position long, name string, metric_value double, status string, commit_hash string"
    return train.sparkSession.createDataFrame(rows, schema)
