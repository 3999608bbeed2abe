"""Datasets: tables, records, labelled text, image folders."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runsight.functions.values import parent_folder
from runsight.operators.prep import SEED, random_split_val

# File suffixes that choose the reader.
PARQUET_SUFFIXES = (".parquet", ".pq")
RECORD_SUFFIXES = (".json", ".jsonl", ".csv")


def suffix(path: str) -> str:
    return PurePosixPath(path).suffix


def columns(**types: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in types.items()])


def or_empty(spark: SparkSession, schema: T.StructType, read) -> DataFrame:
    """Result of ``read()``, or no rows where the path does not exist."""
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def load_table(spark: SparkSession, path: str, schema: T.StructType | None = None, line_breaks: bool = False) -> DataFrame:
    """Parquet by suffix, anything else is CSV with a header.

    Give ``schema`` to save the inference pass. Large CSV files are split among tasks; where quoted values hold line breaks,
    ``line_breaks=True`` reads each file as a whole.
    """
    if suffix(path) in PARQUET_SUFFIXES:
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    reader = spark.read.options(header=True, escape='"', multiLine=line_breaks)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def load_records(spark: SparkSession, path: str, schema: T.StructType | None = None, line_breaks: bool = False) -> DataFrame:
    """Records from .json (one array), .jsonl (blank lines skipped) or .csv (all strings; ``line_breaks`` as in ``load_table``)."""
    kind = suffix(path).lower()
    if kind not in RECORD_SUFFIXES:
        raise ValueError(f"cannot read records from {kind or 'a file without suffix'}; allowed: {', '.join(RECORD_SUFFIXES)}")
    if kind == ".csv":
        return spark.read.csv(path, header=True, inferSchema=False, multiLine=line_breaks, escape='"')
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path, multiLine=kind == ".json")


def load_text_table(spark: SparkSession, path: str, text_column: str = "text", label_column: str = "label", line_breaks: bool = False) -> DataFrame:
    """Labelled text from .json or CSV (``line_breaks`` as in ``load_table``)."""
    rows = load_records(spark, path) if suffix(path) == ".json" else load_table(spark, path, line_breaks=line_breaks)
    return rows.select(F.col(text_column).alias("text"), F.col(label_column).alias("label"))


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """Path and size of every file below a folder. Contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")


def _file_system(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _below(spark: SparkSession, folder: str) -> Column:
    """Path elements below ``folder``."""
    system, path = _file_system(spark, folder)
    start = len(system.makeQualified(path).toString()) + 2
    return F.split(F.substring("path", start, 2_147_483_647), "/")


def image_index(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, class): the class is the name of the folder a file lies in."""
    return _files(spark, folder).withColumn("class", parent_folder(F.col("path")))


def load_image_folder(spark: SparkSession, folder: str, val_split: float = 0.2, seed: int = SEED) -> DataFrame:
    """Image index with ``is_val``: by the train and val folders if both exist, else a seeded split."""
    files = image_index(spark, folder)
    top = F.get(_below(spark, folder), F.lit(0))
    both = files.agg(F.bool_or(top == "train").alias("t"), F.bool_or(top == "val").alias("v")).first()
    if both["t"] and both["v"]:
        return files.where(top.isin("train", "val")).withColumn("is_val", top == "val")
    return random_split_val(files, "path", val_split, seed)


def class_folders(spark: SparkSession, folder: str) -> list[str]:
    """Sorted names of the folders directly inside a folder, empty ones too."""
    system, path = _file_system(spark, folder)
    return sorted(s.getPath().getName() for s in system.listStatus(path) if s.isDirectory())


def load_labels(spark: SparkSession, path: str) -> DataFrame | None:
    """Labels of a dataset: a class id per file of a class folder tree, or the ``label`` column of a CSV.

    Ids number the sorted class folders, and an empty folder uses up its number. None without labels.
    """
    try:
        names = class_folders(spark, path) if not suffix(path) else []
        if names:
            ids = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])
            parts = _below(spark, path)
            direct = _files(spark, path).where(F.size(parts) == 2)
            return direct.select("path", F.try_element_at(ids, F.get(parts, F.lit(0))).alias("label"))
        table = load_table(spark, path)
    except Exception as error:  # a missing path shows up as an error of the file system
        if "FileNotFound" in str(error) or "PATH_NOT_FOUND" in str(error):
            return None
        raise
    return table.select("label") if "label" in table.columns else None


def dir_usage(spark: SparkSession, base: str) -> DataFrame:
    """Megabytes per folder directly below ``base``."""
    parts = _below(spark, base)
    sized = _files(spark, base).where(F.size(parts) > 1)
    return sized.groupBy(F.get(parts, F.lit(0)).alias("directory")).agg((F.sum("length") / 1048576).alias("size_mb"))
