"""Regression forests over few features: rows are combined per cell of bins, and trees grow on cells.

Like Spark's forest, a value is one of at most ``BINS`` bins of its feature, every tree sees each row a number of times drawn from Poisson(1), and a node weighs the splits of a random third of the features by
the fall in variance. Few features have few cells, whatever their values: two have 1,024 at most. All that a tree asks of its rows are the counts and sums of their labels per cell, so that one scan draws the
rows of all trees and adds them up, where Spark's forest goes through them once per level and walks down each tree for each row. Trees then grow side by side from their tables of cells. With more than
``CELLS`` cells the forest is Spark's own.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bins of a feature, as in Spark's forests.
BINS = 32
#: Cells of a table: 64 KB a tree.
CELLS = 2**12
#: Points that a task sends per feature, and distinct values that it holds before it makes that many of them. A bin is found to within 1/128 of its rows per time that is done.
POINTS, HELD = 2**12, 2**18
#: Trees that grow side by side, and tables that one task adds up.
SIDE_BY_SIDE, TABLES = 16, 512


class RegressionForest(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    trees = Param(Params._dummy(), "trees", "number of trees", TypeConverters.toInt)
    depth = Param(Params._dummy(), "depth", "largest number of splits on a path", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed of rows and features", TypeConverters.toInt)

    def __init__(self, trees: int = 100, depth: int = 10, seed: int = 42) -> None:
        super().__init__()
        self._set(trees=trees, depth=depth, seed=seed)

    def _fit(self, dataset: DataFrame) -> Model:
        trees, depth, seed = (self.getOrDefault(p) for p in ("trees", "depth", "seed"))
        splits, middle, parts = _candidates(dataset) if trees > 1 else (None, 0.0, 0)
        if splits is None:
            return RandomForestRegressor(labelCol="label", numTrees=trees, maxDepth=depth, seed=seed).fit(dataset)
        tables = _columns(dataset, len(splits)).mapInArrow(_bags(splits, middle, trees, seed), "tree int, cells binary")
        grown = tables.repartition(min(trees, -(-trees * parts // TABLES)), "tree").mapInArrow(_grown([len(s) + 1 for s in splits], depth, seed), "total binary")
        total = sum(np.frombuffer(r["total"]) for r in grown.collect())  # one row per task
        fitted = json.dumps({"splits": [s.tolist() for s in splits], "values": (middle + total / trees).tolist()})
        return RegressionForestModel()._set(fitted=fitted)


class RegressionForestModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """The mean of all trees in each cell."""

    fitted = Param(Params._dummy(), "fitted", "splits per feature and values per cell as JSON", TypeConverters.toString)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        found = json.loads(self.getOrDefault("fitted"))
        splits, values = [np.array(s) for s in found["splits"]], np.array(found["values"])

        @F.pandas_udf("double")
        def value(*x):
            import pandas as pd

            return pd.Series(values[_cells(splits, [v.to_numpy() for v in x])])

        row = vector_to_array("features")
        return dataset.withColumn("prediction", value(*[row[i] for i in range(len(splits))]))


def _columns(dataset: DataFrame, features: int) -> DataFrame:
    rows = dataset.select(F.col("label").cast("double").alias("label"), vector_to_array("features").alias("x"))
    return rows.select("label", *[F.col("x")[i].alias(f"x{i}") for i in range(features)])


def _values(batch: pa.RecordBatch) -> list[np.ndarray]:
    """Label and features; what is missing is NaN."""
    return [c.to_numpy(zero_copy_only=False).astype(float, copy=False) for c in batch.columns]


def _cells(splits: list[np.ndarray], values: list[np.ndarray]) -> np.ndarray:
    """Number of the cell of each row. A value equal to a split lies below it."""
    cell = np.zeros(len(values[0]), dtype=np.int64)
    for s, v in zip(splits, values):
        cell = cell * (len(s) + 1) + np.searchsorted(s, v, side="left")
    return cell


# --- splits ------------------------------------------------------------------------------------------


def _candidates(dataset: DataFrame) -> tuple[list[np.ndarray] | None, float, int]:
    """Splits of each feature, the mean label, and the number of tasks with rows; no splits if the features need more than ``CELLS`` cells or are categories, or there are no rows."""
    kinds = dataset.schema["features"].metadata.get("ml_attr", {}).get("attrs", {})
    first = None if "nominal" in kinds else dataset.select(F.size(vector_to_array("features")).alias("n")).first()
    features = first["n"] if first else None
    if not features or features < 1 or 2**features > CELLS:
        return None, 0.0, 0
    sent = _columns(dataset, features).mapInArrow(_points, "feature int, points binary, weights binary, labels double").collect()  # POINTS numbers per feature and task
    points: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for i in range(features):
        some = [r for r in sent if r["feature"] == i]
        points[i] = _merged(*[np.concatenate([np.frombuffer(r[c]) for r in some]) for c in ("points", "weights")])
    n = points[0][1].sum()
    splits = [_splits(*points[i], min(BINS, int(n)) - 1) for i in range(features)]
    if math.prod(len(s) + 1 for s in splits) > CELLS:
        return None, 0.0, 0
    own = [r["labels"] for r in sent if r["feature"] == 0]
    return splits, sum(own) / n, len(own)


def _points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per feature: its values with their counts, thinned to ``POINTS`` of them, and the sum of labels."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    labels = 0.0
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = _values(batch)
        if not all(np.isfinite(c).all() for c in columns):
            raise ValueError("labels and features must be finite numbers")
        labels += float(columns[0].sum())
        held = held or [(np.empty(0), np.empty(0)) for _ in columns[1:]]
        for i, c in enumerate(columns[1:]):
            values, counts = np.unique(c, return_counts=True)
            held[i] = _merged(np.concatenate([held[i][0], values]), np.concatenate([held[i][1], counts]))
            if len(held[i][0]) > HELD:
                held[i] = _thinned(*held[i])
    if held:
        sent = [_thinned(*h) for h in held]
        arrays = [[p.tobytes() for p, _ in sent], [w.astype(float).tobytes() for _, w in sent]]
        columns = [pa.array(range(len(sent)), pa.int32()), *[pa.array(a, pa.binary()) for a in arrays], pa.array([labels] * len(sent), pa.float64())]
        yield pa.RecordBatch.from_arrays(columns, ["feature", "points", "weights", "labels"])


def _merged(values: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, place = np.unique(values, return_inverse=True)
    return distinct, np.bincount(place, weights, len(distinct))


def _thinned(values: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``POINTS`` values at most: runs of about the same weight become their largest value."""
    if len(values) <= POINTS:
        return values, weights
    ends = np.cumsum(weights)
    run = np.minimum((ends - weights / 2) * (POINTS / ends[-1]), POINTS - 1).astype(int)
    last = np.append(run[1:] != run[:-1], True)
    return values[last], np.diff(ends[last], prepend=0.0)


def _splits(values: np.ndarray, weights: np.ndarray, most: int) -> np.ndarray:
    """Middles between neighbours: all of them, or up to ``most`` that leave about as many rows between them, by the walk of Spark's forests."""
    middles = values[:-1] + np.diff(values) / 2
    if len(middles) <= most:
        return middles
    ends = np.cumsum(weights)
    stride, found = ends[-1] / (most + 1), []
    target = stride
    for i in range(1, len(values)):
        if abs(ends[i - 1] - target) < abs(ends[i] - target):
            found.append(i - 1)
            target += stride
    return middles[found]


# --- trees -------------------------------------------------------------------------------------------


def _bags(splits: list[np.ndarray], middle: float, trees: int, seed: int):
    """A task's counts and sums of labels, less ``middle``, per tree and cell. Each row is drawn Poisson(1) times for each tree: so many draws in all, dealt over the rows at random."""
    cells = math.prod(len(s) + 1 for s in splits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draw = np.random.default_rng([seed & 0xFFFFFFFF, TaskContext.get().partitionId()])
        tables = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            label, *x = _values(batch)
            cell, above = _cells(splits, x), label - middle
            tables = np.zeros((trees, 2, cells)) if tables is None else tables
            for table in tables:
                rows = draw.integers(0, n, draw.poisson(n), dtype=np.uint32)
                at = cell[rows]
                table[0] += np.bincount(at, minlength=cells)
                table[1] += np.bincount(at, above[rows], cells)
        for t in range(0, trees if tables is not None else 0, TABLES):
            some = range(t, min(t + TABLES, trees))
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([tables[i].tobytes() for i in some], pa.binary())], ["tree", "cells"])

    return run


def _grown(bins: list[int], depth: int, seed: int):
    """The sum over a task's trees of what they say in each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, np.ndarray] = {}
        for batch in batches:
            for tree, cells in zip(batch.column(0).to_pylist(), batch.column(1)):
                table = np.frombuffer(cells.as_buffer()).reshape(2, -1)
                tables[tree] = tables[tree] + table if tree in tables else table.copy()
        order = sorted(tables)
        total = np.zeros(math.prod(bins))
        for t in range(0, len(order), SIDE_BY_SIDE):
            some = order[t : t + SIDE_BY_SIDE]
            total += grow(np.stack([tables[i] for i in some]), bins, depth, np.random.default_rng([seed & 0xFFFFFFFF, 1, some[0]])).sum(axis=0)
        if order:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    return run


def grow(tables: np.ndarray, bins: list[int], depth: int, draw: np.random.Generator) -> np.ndarray:
    """Value of each tree in each cell. ``tables``: (trees, 2, cells), counts and sums of labels.

    A node holds the cells of its box, those without rows too. All nodes of a level are split at once; each weighs a random third of the features, rounded up.
    """
    trees, _, cells = tables.shape
    places = np.stack(np.unravel_index(np.arange(cells), bins))
    tried, most = -(-len(bins) // 3), max(*bins, 2)
    counts, sums = tables[:, 0].ravel(), tables[:, 1].ravel()
    cell = np.tile(np.arange(cells), trees)
    at, node, nodes = np.arange(trees * cells), np.repeat(np.arange(trees), cells), trees  # entries in nodes that may be split, and their nodes
    value = np.zeros(trees * cells)

    def means() -> np.ndarray:
        n = np.bincount(node, counts[at], nodes)
        return np.divide(np.bincount(node, sums[at], nodes), n, out=np.zeros(nodes), where=n > 0)

    value[at] = means()[node]
    for _ in range(depth):
        features = np.argsort(draw.random((nodes, len(bins))), axis=1)[:, :tried]
        best, feature, below = np.zeros(nodes), np.full(nodes, -1), np.zeros(nodes, dtype=int)
        for i in range(tried):
            key = node * most + places[features[node, i], cell[at]]
            n, s = (np.cumsum(np.bincount(key, w[at], nodes * most).reshape(nodes, most), axis=1) for w in (counts, sums))
            left, right = n[:, :-1], n[:, -1:] - n[:, :-1]
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = s[:, :-1] ** 2 / left + (s[:, -1:] - s[:, :-1]) ** 2 / right - s[:, -1:] ** 2 / n[:, -1:]
            gain = np.where((left > 0) & (right > 0), gain, 0.0)
            cut = np.argmax(gain, axis=1)
            top = gain[np.arange(nodes), cut]
            better = top > best
            best, feature, below = np.where(better, top, best), np.where(better, features[:, i], feature), np.where(better, cut, below)
        split = feature >= 0
        if not split.any():
            break
        stay = split[node]
        at, node = at[stay], node[stay]
        side = places[feature[node], cell[at]] > below[node]
        node, nodes = (np.cumsum(split) - 1)[node] * 2 + side, 2 * int(split.sum())
        value[at] = means()[node]
    return value.reshape(trees, cells)
