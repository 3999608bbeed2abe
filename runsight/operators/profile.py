"""Dataset profiling: column kinds, dates, missing values, task and metric detection, leakage.

One aggregate over the table answers everything that needs data except the exact class counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runsight.functions.dates import parse_date
from runsight.functions.values import clean_floats, fixed, pearson

# Thresholds that decide results.
REGRESSION_ABOVE = 20
CONTINUOUS_ABOVE = 10
DATE_SAMPLE = 20
DATE_SHARE = 0.8
LEAKAGE_CORRELATION = 0.99
WIDE = 200  # columns per aggregate, to stay inside generated-code limits

NUMERIC = (T.NumericType, T.BooleanType)
DATES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def _name(column: str) -> Column:
    return F.col(f"`{column}`")


def drop_target(df: DataFrame, target: str) -> DataFrame:
    return df.drop(target)


def feature_types(df: DataFrame, target: str) -> dict[str, str]:
    """Feature to 'numeric' or 'categorical', from the schema alone. Booleans count as numeric."""
    return {
        f.name: "numeric" if isinstance(f.dataType, NUMERIC) else "categorical" for f in df.schema if f.name != target
    }


def select_by_type(df: DataFrame, kind: str) -> DataFrame:
    """Columns of one kind: 'number' (without booleans) or 'object' (strings)."""
    wanted = {"number": T.NumericType, "object": T.StringType}[kind]
    return df.select(*[_name(f.name) for f in df.schema if isinstance(f.dataType, wanted)])


def name_leakage(df: DataFrame, target: str) -> list[str]:
    return [c for c in df.columns if c != target and target in c]


def validate_input(df: DataFrame, target: str) -> None:
    """Raise ValueError for input that cannot be profiled."""
    _check(df, target, _facts(clean_floats(df), target))


def _facts(df: DataFrame, target: str) -> dict:
    """Row count, non-missing count per column and, for a numeric target, moments and correlations."""
    if target not in df.columns:
        return {"rows": df.count()}
    numeric_target = isinstance(df.schema[target].dataType, NUMERIC)
    y = _name(target).cast("double")
    numbers = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name != target]
    facts: dict = {"counts": {}, "correlations": {}}
    for start in range(0, len(df.columns), WIDE):
        block = df.columns[start : start + WIDE]
        aggregates = [F.count(F.lit(1)).alias("rows")]
        aggregates += [F.count(_name(c)).alias(f"n{i}") for i, c in enumerate(block)]
        if numeric_target:
            aggregates += [f(y).alias(a) for a, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))]
            aggregates += [pearson(_name(c), y).alias(f"r{i}") for i, c in enumerate(block) if c in numbers]
        row = df.agg(*aggregates).first()
        facts["rows"] = row["rows"]
        if numeric_target:
            facts.update({a: row[a] for a in ("mean", "std", "min", "max")})
        for i, c in enumerate(block):
            facts["counts"][c] = row[f"n{i}"]
            if numeric_target and c in numbers:
                facts["correlations"][c] = row[f"r{i}"]
    return facts


def _check(df: DataFrame, target: str, facts: dict) -> None:
    if facts["rows"] == 0:
        raise ValueError("the dataset has no rows")
    if target not in df.columns:
        raise ValueError(f"no target column {target!r} among {df.columns}")
    if facts["counts"][target] == 0:
        raise ValueError(f"every value of target {target!r} is missing")
    if len(df.columns) == 1:
        raise ValueError("no feature column besides the target")
    if not any(n for c, n in facts["counts"].items() if c != target):
        raise ValueError("every value of every feature is missing")


def missing_pct(df: DataFrame) -> DataFrame:
    """100 x missing cells / all cells, target included."""
    cells = clean_floats(df)
    missing = sum((F.count(F.lit(1)) - F.count(_name(c)) for c in cells.columns), F.lit(0))
    return cells.agg(
        F.coalesce(F.try_divide(missing * 100.0, F.count(F.lit(1)) * len(cells.columns)), F.lit(0.0)).alias("missing_pct")
    )


def n_unique(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-missing values."""
    return clean_floats(df.select(_name(column))).agg(F.count_distinct(_name(column)).alias("n_unique"))


def class_count(df: DataFrame, label: str) -> DataFrame:
    return n_unique(df, label).select(F.col("n_unique").alias("n_classes"))


def distinct_up_to(df: DataFrame, column: str, enough: int) -> int:
    """Number of distinct values, counted only until ``enough`` are seen.

    Exact below ``enough``. Each task stops reading once it has found that many, so a continuous
    target costs one batch per task instead of a shuffle of all its values.
    """

    def first_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            seen.update(batch.column(0).unique().drop_null().to_pylist())
            if len(seen) >= enough:
                break
        values = pa.array(list(seen)[:enough], batch.column(0).type) if seen else None
        if values is not None:
            yield pa.RecordBatch.from_arrays([values], names=["v"])

    values = clean_floats(df.select(_name(column).alias("v"))).where(F.col("v").isNotNull())
    return values.mapInArrow(first_values, values.schema).distinct().limit(enough).count()


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Class distribution without missing values, most frequent first."""
    values = clean_floats(df.select(_name(column).alias("value"))).where(F.col("value").isNotNull())
    return values.groupBy("value").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value")


def detect_task(numeric: bool, distinct: int) -> str:
    return "regression" if numeric and distinct > REGRESSION_ABOVE else "classification"


def select_metric(task: str, distinct: int) -> tuple[str, str]:
    """Default (metric, direction) of a task."""
    if task == "regression":
        return "r2", "maximize"
    return ("accuracy" if distinct <= 2 else "f1_weighted"), "maximize"


def detect_date_columns(df: DataFrame, columns: list[str] | None = None) -> list[str]:
    """Date columns by type, and string columns whose first values mostly parse as dates."""
    columns = [c for c in (columns or df.columns) if c in df.columns]
    typed = {c for c in columns if isinstance(df.schema[c].dataType, DATES)}
    texts = [c for c in columns if isinstance(df.schema[c].dataType, T.StringType)]
    # Taking a few rows reads as many partitions as that needs, mostly one.
    samples = [(c, r[0]) for c in texts for r in df.select(_name(c)).where(_name(c).isNotNull()).take(DATE_SAMPLE)]
    rates = df.sparkSession.createDataFrame(samples, "c string, v string").groupBy("c")
    share = rates.agg(F.avg(parse_date(F.col("v")).isNotNull().cast("int")).alias("share")) if samples else None
    parsed = {r["c"] for r in share.where(F.col("share") > DATE_SHARE).collect()} if samples else set()
    return [c for c in columns if c in typed or c in parsed]


def leakage_warnings(df: DataFrame, target: str, threshold: float = LEAKAGE_CORRELATION) -> list[str]:
    """Features named after the target, or correlated with it almost perfectly."""
    return _warnings(df, target, _facts(clean_floats(df), target), threshold)


def _warnings(df: DataFrame, target: str, facts: dict, threshold: float = LEAKAGE_CORRELATION) -> list[str]:
    named = [f"'{c}' has the target's name '{target}' in its own" for c in name_leakage(df, target)]
    close = [
        f"'{c}' correlates with the target at {r:.3f}"
        for c, r in facts["correlations"].items()
        if r is not None and abs(r) > threshold
    ]
    return named + close


def target_correlations(df: DataFrame, target: str) -> DataFrame:
    """Correlation of every numeric feature with the target: (feature, correlation), constants left out."""
    clean = clean_floats(df)
    names = [c for c in select_by_type(clean, "number").columns if c != target]
    wide = clean.agg(*[pearson(_name(c), _name(target)).alias(f"r{i}") for i, c in enumerate(names)])
    pairs = [F.struct(F.lit(c).alias("feature"), F.col(f"r{i}").alias("correlation")) for i, c in enumerate(names)]
    return wide.select(F.inline(F.array(*pairs))).where(F.col("correlation").isNotNull())


def target_stats(df: DataFrame, target: str) -> DataFrame:
    """Mean, sample deviation, min and max of a numeric target in one row."""
    y = F.col("y")
    return clean_floats(df.select(_name(target).cast("double").alias("y"))).agg(
        F.avg(y).alias("mean"), F.stddev_samp(y).alias("std"), F.min(y).alias("min"), F.max(y).alias("max")
    )


PROFILE_SCHEMA = T.StructType(
    [
        T.StructField("task", T.StringType()),
        T.StructField("metric", T.StringType()),
        T.StructField("direction", T.StringType()),
        T.StructField("n_rows", T.LongType()),
        T.StructField("n_features", T.LongType()),
        T.StructField("numeric_features", T.ArrayType(T.StringType())),
        T.StructField("categorical_features", T.ArrayType(T.StringType())),
        T.StructField("date_columns", T.ArrayType(T.StringType())),
        T.StructField("leakage_warnings", T.ArrayType(T.StringType())),
        T.StructField(
            "target_stats",
            T.StructType(
                [
                    T.StructField("type", T.StringType()),
                    T.StructField("mean", T.DoubleType()),
                    T.StructField("std", T.DoubleType()),
                    T.StructField("n_classes", T.LongType()),
                ]
            ),
        ),
        T.StructField("missing_pct", T.DoubleType()),
    ]
)


def profile_dataset(df: DataFrame, target: str) -> DataFrame:
    """One-row profile: task, default metric, column kinds, dates, target statistics, missing share, leakage. Classes with their counts are rows of ``class_distribution``."""
    clean = clean_floats(df)
    facts = _facts(clean, target)
    _check(clean, target, facts)
    kinds = feature_types(df, target)
    numeric_target = isinstance(df.schema[target].dataType, NUMERIC)
    many = numeric_target and distinct_up_to(clean, target, REGRESSION_ABOVE + 1) > REGRESSION_ABOVE
    n_classes = None if many else n_unique(clean, target).first()["n_unique"]
    task = detect_task(numeric_target, REGRESSION_ABOVE + 1 if many else n_classes)
    metric, direction = select_metric(task, REGRESSION_ABOVE + 1 if many else n_classes)
    regression = task == "regression"
    cells = facts["rows"] * len(df.columns)
    row = {
        "task": task,
        "metric": metric,
        "direction": direction,
        "n_rows": facts["rows"],
        "n_features": len(kinds),
        "numeric_features": [c for c, k in kinds.items() if k == "numeric"],
        "categorical_features": [c for c, k in kinds.items() if k == "categorical"],
        "date_columns": detect_date_columns(df, [c for c, k in kinds.items() if k == "categorical"]),
        "leakage_warnings": _warnings(df, target, facts),
        "target_stats": {
            "type": task,
            "mean": facts["mean"] if regression else None,
            "std": facts["std"] if regression else None,
            "n_classes": None if regression else n_classes,
        },
        "missing_pct": 100.0 * (cells - sum(facts["counts"].values())) / cells,
    }
    return df.sparkSession.createDataFrame([row], PROFILE_SCHEMA)


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    """Rows per class of a categorical target: (value, n), as many rows as there are classes, counted per task before the shuffle. A continuous target has none."""
    clean = clean_floats(df)
    numeric = isinstance(df.schema[target].dataType, NUMERIC)
    counts = value_counts(clean, target).select(F.col("value").cast("string").alias("value"), "n")
    continuous = numeric and distinct_up_to(clean, target, REGRESSION_ABOVE + 1) > REGRESSION_ABOVE
    return counts.limit(0) if continuous else counts


def data_summary(df: DataFrame, target: str) -> DataFrame:
    """Facts of a dataset as rows (section, key, value): shape, feature kinds, target statistics."""
    clean = clean_floats(df)
    numeric = isinstance(df.schema[target].dataType, NUMERIC)
    continuous = numeric and distinct_up_to(clean, target, CONTINUOUS_ABOVE + 1) > CONTINUOUS_ABOVE
    fact = "section string, key string, value string"
    spark = df.sparkSession
    kinds = spark.createDataFrame([("feature", c, k) for c, k in feature_types(df, target).items()], fact)
    if continuous:
        stats = target_stats(clean, target)
        names = ["mean", "std", "min", "max"]
    else:
        stats = n_unique(clean, target).withColumnRenamed("n_unique", "n_classes")
        names = ["n_classes"]
    kind = spark.createDataFrame([("target", "type", "continuous" if continuous else "categorical")], fact)
    pairs = [F.struct(F.lit("target").alias("section"), F.lit(c).alias("key"), _rounded(stats, c).alias("value")) for c in names]
    fact_of = lambda key, value: F.struct(F.lit("shape").alias("section"), F.lit(key).alias("key"), value.alias("value"))
    shape = clean.agg(F.count(F.lit(1)).cast("string").alias("rows")).select(
        F.inline(F.array(fact_of("rows", F.col("rows")), fact_of("columns", F.lit(str(len(df.columns))))))
    )
    out = shape.unionByName(kinds).unionByName(kind).unionByName(stats.select(F.inline(F.array(*pairs))))
    if not continuous:
        counts = value_counts(clean, target)
        out = out.unionByName(
            counts.select(F.lit("class").alias("section"), F.col("value").cast("string").alias("key"), F.col("n").cast("string").alias("value"))
        )
    return out


def _rounded(stats: DataFrame, column: str) -> Column:
    if isinstance(stats.schema[column].dataType, T.DoubleType):
        return fixed(F.col(column), 4)
    return F.col(column).cast("string")
