"""Dataset preparation: reproducible splits and folds, imputation, scaling, encoding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runsight.functions.values import clean_floats
from runsight.plans.hashorder import cut_hashes, hash_of, rank_cuts
from runsight.plans.quantile import exact_medians
from runsight.plans.running import Running, running_global
from runsight.plans.sizing import broadcast_if_small
from runsight.session import materialize

SEED = 42  # fixed value: default seed
FOLDS = 5  # fixed value: default number of folds


# --- splits ------------------------------------------------------------------------------------


def _split(df: DataFrame, key: str, seed: int, size: Column, name: str) -> DataFrame:
    cuts = cut_hashes(df, key, seed, lambda _: F.array(size))
    if 0 not in cuts:
        return df.withColumn(name, F.lit(False))
    return df.withColumn(name, hash_of(key, seed) <= F.lit(cuts[0]))


def split_train_test(df: DataFrame, key: str, test_size: float = 0.2, seed: int = SEED) -> DataFrame:
    """Add ``is_test``: exactly ceil(n x test_size) rows, the same ones on every run."""
    return _split(df, key, seed, F.ceil(F.col("_total") * F.lit(test_size)).cast("long"), "is_test")


def split_train_eval(df: DataFrame, key: str, eval_fraction: float = 0.1, seed: int = SEED) -> DataFrame:
    """Add ``is_eval``: exactly floor(n x eval_fraction) rows."""
    return _split(df, key, seed, F.floor(F.col("_total") * F.lit(eval_fraction)).cast("long"), "is_eval")


def random_split_val(df: DataFrame, key: str, val_split: float = 0.2, seed: int = SEED) -> DataFrame:
    """Add ``is_val``: exactly floor(n x val_split) rows."""
    return _split(df, key, seed, F.floor(F.col("_total") * F.lit(val_split)).cast("long"), "is_val")


def partition_by_membership(df: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is listed, all other rows)."""
    return df.join(ids.select(key), key, "left_semi"), df.join(ids.select(key), key, "left_anti")


def common_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys in both parts of a split; empty when the parts are disjoint."""
    return left.select(key).intersect(right.select(key))


# --- folds ---------------------------------------------------------------------------------------


def kfold(df: DataFrame, key: str, k: int = FOLDS, seed: int = SEED) -> DataFrame:
    """Add ``fold`` 0..k-1: consecutive blocks of the hash order, sizes n//k or one more for the first n % k.

    The rows are compared with k-1 cut hashes and not shuffled.
    """
    n = F.col("_total")
    ends = F.array(*[((i + 1) * F.floor(n / k) + F.least(F.lit(i + 1), n % k)).cast("long") for i in range(k - 1)])
    cuts = cut_hashes(df, key, seed, lambda _: ends)
    h = hash_of(key, seed)
    past = [(h > F.lit(cuts[i])).cast("int") if i in cuts else F.lit(1) for i in range(k - 1)]
    return df.withColumn("fold", sum(past, F.lit(0)))


def stratified_kfold(df: DataFrame, key: str, label: str, k: int = FOLDS, seed: int = SEED) -> DataFrame:
    """Add ``fold`` 0..k-1 with every class spread evenly.

    Fold sizes per class follow the classes' positions in label order dealt out round robin. The cuts are
    found per class by hash prefix, so a class of any size is never sorted as a whole. Rows without a
    label get no fold.
    """
    classes = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("_size"))
    sizes = running_global(classes, label, [Running("_offset", "sum", F.col("_size"), before=True)]).select(label, "_offset")
    n, offset = F.col("_total"), F.col("_offset")

    def dealt(i: int) -> Column:
        """Positions offset..offset+n-1 that leave remainder i when divided by k."""
        return F.floor((offset + n - 1 - i) / k) - F.floor((offset - 1 - i) / k)

    ends, total = [], F.lit(0)
    for i in range(k - 1):
        total = total + dealt(i)
        ends.append(total.cast("long"))
    hashed = df.where(F.col(label).isNotNull()).select(label, hash_of(key, seed).alias("_h"))
    cuts = rank_cuts(hashed, [label], lambda _: F.array(*ends), extra=sizes)
    wide = cuts.groupBy(label).agg(*[F.max(F.when(F.col("cut") == i, F.col("cut_hash"))).alias(f"_cut{i}") for i in range(k - 1)])
    joined = df.join(broadcast_if_small(wide), label, "left")
    h = hash_of(key, seed)
    past = [(F.col(f"_cut{i}").isNull() | (h > F.col(f"_cut{i}"))).cast("int") for i in range(k - 1)]
    fold = F.when(F.col(label).isNotNull(), sum(past, F.lit(0)))
    return joined.select(*df.columns, fold.alias("fold"))


def temporal_split(df: DataFrame, date: str, test_size: float = 0.2) -> DataFrame:
    """Add ``is_test`` for the latest rows: at least ceil(n x test_size) of them, never splitting one point in time. Rows without a date are training rows."""
    per_date = materialize(df.where(F.col(date).isNotNull()).groupBy(date).agg(F.count(F.lit(1)).alias("_n")))
    total = per_date.agg(F.sum("_n").alias("n")).first()["n"] or 0
    later = running_global(per_date, date, [Running("_upto", "sum", F.col("_n"))])
    wanted = F.ceil(F.lit(total) * F.lit(test_size))
    # The cut is the latest date with enough rows on it and after it.
    cut = later.where(F.lit(total) - F.col("_upto") + F.col("_n") >= wanted).agg(F.max(date).alias("cut")).first()["cut"]
    return df.withColumn("is_test", F.coalesce(F.col(date) >= F.lit(cut), F.lit(False)))


# --- labels --------------------------------------------------------------------------------------


def label_index(df: DataFrame, label: str) -> DataFrame:
    """(label, n, label_id): distinct labels numbered 0.. in sorted order."""
    counts = df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return running_global(counts, "label", [Running("label_id", "count", F.lit(True), before=True)])


def encode_labels(df: DataFrame, label: str) -> DataFrame:
    """Add ``label_id``, the rank of the label among the sorted distinct labels."""
    dimension = label_index(df, label).select(F.col("label").alias(label), "label_id")
    return df.join(broadcast_if_small(dimension), label, "left")


# --- imputing, scaling, encoding ------------------------------------------------------------------


def column_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    return exact_medians(df, {c: F.col(f"`{c}`") for c in columns})


def column_modes(df: DataFrame, columns: Sequence[str]) -> dict[str, str | None]:
    """Most frequent value per string column, the smallest of equals.

    Values are counted per (column, value) before they meet, instead of in one buffer per column.
    """
    pairs = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"`{c}`").alias("v")) for c in columns])))
    counts = pairs.where(F.col("v").isNotNull()).groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy("c").agg(F.min(F.struct(-F.col("n"), F.col("v"))).alias("top"))
    found = {r["c"]: r["top"]["v"] for r in top.collect()}
    return {c: found.get(c) for c in columns}


def moments(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float | None, float | None]]:
    """Mean and population deviation per column in one pass."""
    row = df.agg(
        *[F.avg(F.col(f"`{c}`")).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(F.col(f"`{c}`")).alias(f"s{i}") for i, c in enumerate(columns)],
    ).first()
    return {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(columns)}


def fill(df: DataFrame, values: dict[str, object]) -> DataFrame:
    """Replace missing values; columns whose value is None stay as they are."""
    known = {c: v for c, v in values.items() if v is not None}
    return df.withColumns({c: F.coalesce(F.col(f"`{c}`"), F.lit(v)) for c, v in known.items()}) if known else df


def impute_median(df: DataFrame, columns: Sequence[str], train: DataFrame | None = None) -> DataFrame:
    """Missing numbers become the (training) median."""
    medians = column_medians(df if train is None else train, columns)
    doubles = clean_floats(df).withColumns({c: F.col(f"`{c}`").cast("double") for c in columns})
    return fill(doubles, medians)


def impute_mode(df: DataFrame, columns: Sequence[str], train: DataFrame | None = None) -> DataFrame:
    return fill(df, column_modes(df if train is None else train, columns))


def scaled(column: str, mean: float | None, deviation: float | None) -> Column:
    """(x - mean) / deviation; a constant column becomes 0."""
    centred = F.col(f"`{column}`").cast("double") - F.lit(mean)
    return centred / F.lit(deviation if deviation else 1.0)


def standardize(df: DataFrame, columns: Sequence[str], train: DataFrame | None = None) -> DataFrame:
    values = moments(clean_floats(df if train is None else train), columns)
    return clean_floats(df).withColumns({c: scaled(c, *values[c]) for c in columns})


def categories(df: DataFrame, column: str) -> DataFrame:
    return label_index(df, column).select(F.col("label").alias("category"), "label_id")


def one_hot(df: DataFrame, column: str, train: DataFrame | None = None) -> DataFrame:
    """Add ``<column>_hot``, a sparse vector with one place per sorted training category.

    Unseen and missing values have no place set. The vector is built from the category's number, so its
    cost does not depend on how many categories there are.
    """
    source = df if train is None else train
    known = broadcast_if_small(categories(source, column).withColumnRenamed("category", column))
    size = known.count()
    placed = df.join(known, column, "left").withColumn("_place", F.coalesce("label_id", F.lit(size)).cast("double"))
    encoder = OneHotEncoder(inputCols=["_place"], outputCols=[f"{column}_hot"], dropLast=True)
    places = df.sparkSession.range(size + 1).select(F.col("id").cast("double").alias("_place"))
    return encoder.fit(places).transform(placed).drop("_place", "label_id")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
