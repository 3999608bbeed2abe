"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cpus: int | str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """Session for tests and the bench. On a cluster the caller brings its own session."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("runsight")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``, which every executor sees.

    It can be removed when the application has ended. A folder of our own is made only where the setting is absent and Spark runs in local mode.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="runsight-")
        context.setCheckpointDir(folder)
    return f"{folder}/{context.applicationId}"


_scopes: list[list[str]] = []


@contextmanager
def short_lived(spark: SparkSession) -> Iterator[None]:
    """Tables that ``materialize`` writes inside are removed at the end, but for lasting ones. Results must be written, or read, before that."""
    _scopes.append([])
    try:
        yield
    finally:
        for name in _scopes.pop():
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_given_up(spark: SparkSession) -> Iterator[None]:
    """Whatever is written or read inside gives up its shuffle files as soon as it has ended, without waiting for a garbage collection."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def materialize(df: DataFrame, lasting: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and go on from there.

    Used where a result is read more than once and must be the same each time, also after executors were
    lost. Later reads take only the columns they need, and know the table's size. Tables stay until the folder of the
    application is removed, or to the end of the ``short_lived`` block around them unless they are ``lasting``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    if _scopes and not lasting:
        _scopes[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
