"""Saved run states and exported models."""

from __future__ import annotations

from pyspark.ml.util import MLWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runsight.sources.tables import columns, or_empty

SCHEMA_VERSION = 1  # fixed value
# Fields of a saved state.
STATE_SCHEMA = columns(
    experiment_count=T.LongType(),
    best_metric=T.DoubleType(),
    best_commit=T.StringType(),
    budget_remaining=T.DoubleType(),
    consecutive_reverts=T.LongType(),
    total_keeps=T.LongType(),
    total_reverts=T.LongType(),
    run_id=T.StringType(),
    cost_spent_usd=T.DoubleType(),
    baselines=T.MapType(T.StringType(), columns(score=T.DoubleType(), std=T.DoubleType())),
    tried_families=T.ArrayType(T.StringType()),
    task=T.StringType(),
)
SNAPSHOT_SCHEMA = columns(schema_version=T.IntegerType(), state=STATE_SCHEMA, timestamp=T.TimestampType())
# Model files of a run in the order they are looked for.
MODEL_CANDIDATES = ("best_model.joblib", "best_model.pt", "best_adapter")


def write_checkpoint(states: DataFrame, path: str) -> None:
    """Snapshot table with one row per run; it appears whole or not at all."""
    fields = [F.col(f.name) if f.name in states.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in STATE_SCHEMA]
    rows = states.select(
        F.lit(SCHEMA_VERSION).alias("schema_version"), F.struct(*fields).alias("state"), F.current_timestamp().alias("timestamp")
    )
    rows.write.mode("overwrite").json(path)


def read_checkpoint(spark: SparkSession, path: str) -> DataFrame:
    """Saved states; unknown fields are ignored and missing ones are NULL. No rows before the first save."""
    return or_empty(spark, SNAPSHOT_SCHEMA, lambda: spark.read.schema(SNAPSHOT_SCHEMA).json(path)).select("state.*")


def scan_checkpoints(spark: SparkSession, base: str, prefix: str = "run-", file: str = ".state/checkpoint.json", lines: bool = False) -> DataFrame:
    """Saved state of every run folder below ``base`` and of ``base`` itself; unreadable files are skipped.

    States are nested or, in flat files, at the top level. ``directory`` is the run's folder. With ``lines``, files hold one state per line, so that many runs
    share a folder; unreadable lines are skipped.
    """
    schema = T.StructType([*SNAPSHOT_SCHEMA.fields, *STATE_SCHEMA.fields, T.StructField("_broken", T.StringType())])
    whole = T.StructType([*schema.fields, T.StructField("directory", T.StringType())])
    levels = file.count("/") + 1
    folder = F.array_join(F.expr(f"slice(split(_metadata.file_path, '/'), 1, size(split(_metadata.file_path, '/')) - {levels})"), "/")

    def read(pattern: str) -> DataFrame:
        reader = spark.read.schema(schema).options(multiLine=not lines, mode="PERMISSIVE", columnNameOfCorruptRecord="_broken")
        return or_empty(spark, whole, lambda: reader.json(pattern).withColumn("directory", folder))

    found = read(f"{base}/{file}").unionByName(read(f"{base}/{prefix}*/{file}"))
    return found.where(F.col("_broken").isNull()).drop("_broken")


def run_status(checkpoints: DataFrame) -> DataFrame:
    """One row per run: experiments, best metric, cost, keeps, reverts."""
    field = lambda c, default=None: F.coalesce(f"state.{c}", F.col(c), F.lit(default))
    return checkpoints.select(
        "directory",
        field("run_id", "unknown").alias("run_id"),
        field("experiment_count", 0).alias("experiments"),
        F.coalesce("state.best_metric", "best_metric").alias("best_metric"),
        field("cost_spent_usd", 0.0).alias("cost_usd"),
        field("total_keeps", 0).alias("keeps"),
        field("total_reverts", 0).alias("reverts"),
    )


def choose_artifact(files: DataFrame) -> DataFrame:
    """Model to export per run: the first candidate among its files. Files: run_id, name."""
    order = F.array_position(F.array(*[F.lit(c) for c in MODEL_CANDIDATES]), F.col("name"))
    return files.where(order > 0).groupBy("run_id").agg(F.min_by("name", order).alias("artifact"))


def export_metadata(best: DataFrame, costs: DataFrame, direction: str) -> DataFrame:
    """Sidecar of an exported model. Best: run_id, metric_name, metric_value, commit_hash. Costs: run_id, total, count."""
    return best.join(costs, "run_id", "left").select(
        "run_id",
        "metric_name",
        "metric_value",
        F.lit(direction).alias("metric_direction"),
        F.col("commit_hash").alias("best_commit"),
        F.coalesce("count", F.lit(0)).alias("experiment_count"),
        F.coalesce("total", F.lit(0.0)).alias("total_cost_usd"),
        F.current_timestamp().alias("exported_at"),
    )


def export_best(model: MLWritable, metadata: DataFrame, path: str) -> None:
    """Save a fitted model with its metadata next to it."""
    model.write().overwrite().save(f"{path}/model")
    metadata.write.mode("overwrite").json(f"{path}/metadata")
