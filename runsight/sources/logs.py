"""Append-only logs of runs: results, journal, scoreboard, predictions, agent answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runsight.sources.tables import PARQUET_SUFFIXES, columns, or_empty, suffix

# Column names and types of the logs.
RESULT_SCHEMA = columns(
    run_id=T.StringType(),
    experiment_id=T.LongType(),
    commit_hash=T.StringType(),
    metric_name=T.StringType(),
    metric_value=T.DoubleType(),
    status=T.StringType(),
    description=T.StringType(),
    timestamp=T.TimestampType(),
)
JOURNAL_SCHEMA = columns(
    run_id=T.StringType(),
    experiment_id=T.LongType(),
    hypothesis=T.StringType(),
    result=T.StringType(),
    metric_value=T.DoubleType(),
    metric_delta=T.DoubleType(),
    commit_hash=T.StringType(),
    status=T.StringType(),
    diff=T.StringType(),
    timestamp=T.TimestampType(),
)
SCOREBOARD_SCHEMA = columns(
    agent=T.StringType(),
    commit=T.StringType(),
    metric_value=T.DoubleType(),
    elapsed_sec=T.DoubleType(),
    status=T.StringType(),
    description=T.StringType(),
    timestamp=T.TimestampType(),
)
PREDICTION_SCHEMA = columns(
    row_id=T.LongType(),
    y_true=T.DoubleType(),
    y_pred=T.DoubleType(),
)


BUCKETS = 64


def _bucket(run: Column) -> Column:
    return (F.crc32(run.cast("string")) % BUCKETS).cast("int")


def _read_json(spark: SparkSession, path: str, schema: T.StructType, run_id: str | None) -> DataFrame:
    """All runs, or one: then only its bucket's folder is read."""
    bucketed = T.StructType([*schema.fields, T.StructField("run_bucket", T.IntegerType())])
    rows = or_empty(spark, bucketed, lambda: spark.read.schema(bucketed).json(path))
    if run_id is not None:
        rows = rows.where((F.col("run_bucket") == _bucket(F.lit(run_id))) & (F.col("run_id") == run_id))
    return rows.drop("run_bucket")


def _append_json(df: DataFrame, path: str) -> None:
    """Append under a bounded number of bucket folders. Rebalancing gives each few large files and splits a bucket
    that holds a very long run."""
    bucketed = df.withColumn("run_bucket", _bucket(F.col("run_id")))
    bucketed.hint("rebalance", "run_bucket").write.mode("append").partitionBy("run_bucket").json(path)


def read_results(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    """Result log; no rows where nothing was written yet."""
    return _read_json(spark, path, RESULT_SCHEMA, run_id)


def read_journal(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    return _read_json(spark, path, JOURNAL_SCHEMA, run_id)


def append_results(df: DataFrame, path: str) -> None:
    _append_json(df.select(*RESULT_SCHEMA.names), path)


def append_journal(df: DataFrame, path: str) -> None:
    """Append entries stamped with the current time."""
    _append_json(df.withColumn("timestamp", F.current_timestamp()).select(*JOURNAL_SCHEMA.names), path)


def read_scoreboard(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated scoreboard with a header per file."""
    return or_empty(
        spark, SCOREBOARD_SCHEMA, lambda: spark.read.schema(SCOREBOARD_SCHEMA).csv(path, sep="\t", header=True)
    )


def append_scoreboard(df: DataFrame, path: str) -> None:
    """Append rows; writers need no lock, a file appears only when it is complete."""
    df.select(*SCOREBOARD_SCHEMA.names).write.mode("append").csv(path, sep="\t", header=True)


def write_predictions(df: DataFrame, path: str) -> None:
    df.select("row_id", "y_true", "y_pred").write.mode("overwrite").csv(path, header=True)


def read_predictions(spark: SparkSession, path: str, schema: T.StructType = PREDICTION_SCHEMA) -> DataFrame | None:
    """Prediction table, None where a run wrote none: its diagnostics are then left out."""
    read = spark.read.schema(schema)
    rows = or_empty(
        spark, T.StructType(), lambda: read.parquet(path) if suffix(path) in PARQUET_SUFFIXES else read.csv(path, header=True)
    )
    return rows if rows.columns else None


def read_answers(spark: SparkSession, path: str, end: str | None = None) -> DataFrame:
    """Text answers, one per row: (path, value). Each file is one answer; with ``end``, files hold any number of answers, each closed by that string."""
    schema = columns(
        path=T.StringType(),
        value=T.StringType(),
    )
    form = {"wholetext": True} if end is None else {"lineSep": end}
    return or_empty(spark, schema, lambda: spark.read.text(path, **form).select(F.col("_metadata.file_path").alias("path"), "value"))
