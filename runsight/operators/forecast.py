"""Time series: naive forecasts, walk-forward folds. Series rows: series_id, period (sortable), value."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runsight.operators.metrics import mape
from runsight.plans.running import CHUNK, Running, carried, chunked, hot_keys, running
from runsight.plans.sizing import broadcast_if_small
from runsight.session import materialize


def with_position(series: DataFrame, key: str = "series_id", period: str = "period") -> DataFrame:
    """Add the 1-based position of each row in its series, however long the series is."""
    return running(series, [key], period, [Running("position", "count", F.lit(True))])


def lagged(series: DataFrame, lag: int, name: str, hot: DataFrame | None | str = "count", chunk_rows: int | None = None) -> DataFrame:
    """Add ``position`` and the value ``lag`` places back.

    Series that fit a task take one exchange and one sort. Longer ones lie in ranges of (series, period), and the last ``lag`` rows of each range are its halo: they are sent to the rows ``lag``
    places on, which stand in a later range. No other row meets another one.
    """
    if lag < 1:
        raise ValueError("a lag is one place at least")
    back = lambda over: (F.row_number().over(over).cast("long"), F.lag("value", lag).over(over))
    hot = hot_keys(series, ["series_id"]) if isinstance(hot, str) else hot
    if hot is None:
        place, value = back(Window.partitionBy("series_id").orderBy("period"))
        return series.select("*", place.alias("position"), value.alias(name))
    chunks, _ = chunked(series, ["series_id"], "period", None, hot, chunk_rows)
    chunks = materialize(chunks)
    totals = materialize(chunks.where(F.col(CHUNK) != 0).groupBy("series_id", CHUNK).agg(F.count(F.lit(1)).alias("_n")))
    before = carried(totals, ["series_id"], [Running("_before", "sum", F.col("_n"), before=True)])
    place, value = back(Window.partitionBy("series_id", CHUNK).orderBy("period"))
    local = chunks.select("*", place.alias("_in"), value.alias("_back")).join(broadcast_if_small(before), ["series_id", CHUNK], "left")
    placed = materialize(local.withColumn("position", F.col("_in") + F.coalesce("_before", F.lit(0))))
    halo = placed.where(F.col("_in") > F.col("_n") - lag).select("series_id", (F.col("position") + lag).alias("position"), F.col("value").alias("_sent"))
    met = placed.join(broadcast_if_small(halo), ["series_id", "position"], "left")
    return met.select(*series.columns, "position", F.coalesce("_back", "_sent").alias(name))


def baseline_naive(series: DataFrame) -> DataFrame:
    """Forecast = last value."""
    return lagged(series, 1, "forecast")


def baseline_seasonal_naive(series: DataFrame, season: int = 4) -> DataFrame:
    """Forecast = value one season earlier."""
    return lagged(series, season, "forecast")


def forecast_mape(forecasts: DataFrame) -> DataFrame:
    """MAPE per series over the rows that have a forecast."""
    return forecasts.where(F.col("forecast").isNotNull()).groupBy("series_id").agg(
        mape(F.col("value"), F.col("forecast")).alias("mape"), F.count(F.lit(1)).alias("n")
    )


def walk_forward(series: DataFrame, n_splits: int = 5) -> DataFrame:
    """Expanding-window folds per series without copying rows.

    Each of the last ``n_splits`` blocks of n // (n_splits + 1) rows is once the test block: ``test_fold`` (1-based,
    NULL for rows that are only trained on). A row trains every fold from ``trains_from`` on, NULL when none.
    """
    hot = hot_keys(series, ["series_id"])
    if hot is None:
        own = Window.partitionBy("series_id")
        joined = series.select("*", F.row_number().over(own.orderBy("period")).cast("long").alias("position"), F.count(F.lit(1)).over(own).alias("n"))
    else:
        sizes = broadcast_if_small(series.groupBy("series_id").agg(F.count(F.lit(1)).alias("n")))
        joined = running(series, ["series_id"], "period", [Running("position", "count", F.lit(True))], hot=hot).join(sizes, "series_id")
    block = F.floor(F.col("n") / (n_splits + 1)).cast("long")
    first = F.col("n") - block * n_splits
    at = F.when((F.col("position") > first) & (block > 0), F.floor((F.col("position") - first - 1) / block) + 1).cast("int")
    return joined.withColumn("test_fold", at).select(
        *series.columns,
        "position",
        "test_fold",
        F.when(block > 0, F.when(F.coalesce("test_fold", F.lit(0)) < n_splits, F.coalesce("test_fold", F.lit(0)) + 1)).alias("trains_from"),
    )
