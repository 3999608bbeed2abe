"""Small fixed tables: metrics and directions per domain, task names, model families, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Metrics each domain accepts and their direction.
METRICS = [
    ("tabular", "accuracy", "maximize"),
    ("tabular", "auc", "maximize"),
    ("tabular", "roc_auc", "maximize"),
    ("tabular", "f1", "maximize"),
    ("tabular", "f1_weighted", "maximize"),
    ("tabular", "precision", "maximize"),
    ("tabular", "recall", "maximize"),
    ("tabular", "log_loss", "minimize"),
    ("tabular", "rmse", "minimize"),
    ("tabular", "mae", "minimize"),
    ("tabular", "mse", "minimize"),
    ("tabular", "r2", "maximize"),
    ("deeplearning", "accuracy", "maximize"),
    ("deeplearning", "f1", "maximize"),
    ("deeplearning", "f1_weighted", "maximize"),
    ("deeplearning", "loss", "minimize"),
    ("finetuning", "perplexity", "minimize"),
    ("finetuning", "rouge1", "maximize"),
    ("finetuning", "rouge2", "maximize"),
    ("finetuning", "rougeL", "maximize"),
    ("finetuning", "loss", "minimize"),
]
# Tasks a domain restricts itself to, and the names generic tasks take there.
TASKS = [
    ("deeplearning", "image_classification"),
    ("deeplearning", "text_classification"),
    ("deeplearning", "custom"),
]
TASK_NAMES = [
    ("deeplearning", "classification", "image_classification"),
    ("deeplearning", "regression", "custom"),
    ("finetuning", "classification", "sft"),
    ("finetuning", "regression", "sft"),
]
# Metric a domain falls back to when the configured one is not valid there.
DEFAULT_METRICS = [("finetuning", "loss", "minimize")]
# Model a domain starts from where none is named.
DEFAULT_MODELS = [("finetuning", "meta-llama/Llama-3.2-1B")]
# Model families per domain in the order they are tried.
FAMILIES = {
    "tabular": ["linear", "random_forest", "xgboost", "lightgbm", "svm"],
    "deeplearning": ["resnet", "vit", "efficientnet"],
    "finetuning": ["qlora_r8", "qlora_r16", "qlora_r32", "lora_full"],
}
CLASSIFICATION_TASKS = ("classification", "image_classification", "text_classification", "custom")


def metric_catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(METRICS, "domain string, metric string, direction string")


def direction_of(metric: str, direction: str | None = None) -> str:
    """Direction of a known metric; an unknown one needs it stated."""
    if direction:
        return direction
    known = {m: d for _, m, d in METRICS}
    if metric not in known:
        raise ValueError(f"unknown metric {metric!r}: state its direction")
    return known[metric]


def _constant_map(pairs: list[tuple[str, str]]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs for x in pair])


def metric_direction(df: DataFrame, metric: str = "metric") -> DataFrame:
    """Add the direction of each row's metric, NULL if unknown."""
    directions = _constant_map(sorted({(m, d) for _, m, d in METRICS}))
    return df.withColumn("direction", F.try_element_at(directions, F.col(metric)))


def validate_metric(configs: DataFrame) -> DataFrame:
    """Error rows for configs (config_id, domain, metric, task, model_name) outside the catalogue."""
    valid_metrics = F.array(*[F.lit(f"{d}/{m}") for d, m, _ in METRICS])
    valid_tasks = F.array(*[F.lit(f"{d}/{t}") for d, t in TASKS])
    limited = F.col("domain").isin(*sorted({d for d, _ in TASKS}))
    problems = F.array_compact(
        F.array(
            F.when(
                ~F.array_contains(valid_metrics, F.concat_ws("/", "domain", "metric")),
                F.format_string("Unknown %s metric: %s", "domain", F.coalesce("metric", F.lit("none"))),
            ),
            F.when(
                limited & F.col("task").isNotNull() & ~F.array_contains(valid_tasks, F.concat_ws("/", "domain", "task")),
                F.format_string("Unknown %s task: %s", "domain", "task"),
            ),
            F.when(
                (F.col("domain") == "finetuning") & (F.coalesce("model_name", F.lit("")) == ""),
                F.lit("model_name is required for finetuning"),
            ),
        )
    )
    return configs.select("config_id", F.explode(problems).alias("error"))


def map_task(configs: DataFrame) -> DataFrame:
    """Domain names of generic tasks, the domain's default metric where the configured one is invalid, and its default model where none is named."""
    names = _constant_map([(f"{d}/{t}", n) for d, t, n in TASK_NAMES])
    fallback = _constant_map([(d, m) for d, m, _ in DEFAULT_METRICS])
    fallback_direction = _constant_map([(d, x) for d, _, x in DEFAULT_METRICS])
    valid = F.array_contains(F.array(*[F.lit(f"{d}/{m}") for d, m, _ in METRICS]), F.concat_ws("/", "domain", "metric"))
    replaced = F.when(~F.coalesce(valid, F.lit(False)), F.try_element_at(fallback, F.col("domain")))
    named = F.when(F.col("model_name") != "", F.col("model_name")) if "model_name" in configs.columns else F.lit(None).cast("string")
    return configs.withColumns(
        {
            "model_name": F.coalesce(named, F.try_element_at(_constant_map(DEFAULT_MODELS), F.col("domain"))),
            "task": F.coalesce(F.try_element_at(names, F.concat_ws("/", "domain", "task")), F.col("task")),
            "metric": F.coalesce(replaced, F.col("metric")),
            "direction": F.when(replaced.isNotNull(), F.try_element_at(fallback_direction, F.col("domain"))).otherwise(F.col("direction")),
        }
    )


def label_from_goal(goal: Column) -> Column:
    """Target column named in a goal text: the word after 'predict', else the last word."""
    named = F.regexp_extract(goal, r"(?i)\bpredict\s+(?:the\s+)?(\w+)", 1)
    return F.when(named != "", named).otherwise(F.try_element_at(F.split(F.trim(goal), r"\s+"), F.lit(-1)))


def untried(df: DataFrame, tried: str = "tried_families", domain: str = "domain") -> DataFrame:
    """First family of the row's domain that is not in its list of tried ones, NULL when none is left."""
    catalogue = F.create_map(*[x for d, names in FAMILIES.items() for x in (F.lit(d), F.array(*[F.lit(n) for n in names]))])
    families = F.coalesce(F.try_element_at(catalogue, F.col(domain)), F.array(*[F.lit(n) for n in FAMILIES["tabular"]]))
    left = F.array_except(families, F.coalesce(F.col(tried), F.array().cast("array<string>")))
    return df.withColumn("next_family", F.try_element_at(left, F.lit(1)))


def is_classification(task: str, loss_table: bool = False) -> bool:
    """Which diagnostics a task gets. Loss tables of fine-tuning hold losses as predictions, so they are regression."""
    return task in CLASSIFICATION_TASKS and not loss_table
