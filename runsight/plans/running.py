"""Running aggregates that survive a hot key.

A plain ``Window.partitionBy(run)`` sends a whole run to one task. That is right for most runs, so keys are
counted first (one column, combined before the shuffle). Rows of keys above ``HOT_ROWS`` are cut into ranges of (key, order) of about equal size, whatever the order column is and
however sparse its values: the window runs per (key, chunk), and what came before a chunk is carried in from the chunk totals. These are a running aggregate themselves, by the same rule: a key
with very many chunks has its totals cut into chunks in turn. Without hot keys the plan is the plain window.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runsight.plans.sizing import broadcast_if_small
from runsight.session import materialize

CHUNK = "_chunk"
RANGE = "_range"
HOT_ROWS = 1 << 20
CHUNK_ROWS = 1 << 20
#: Rows of a task that cuts ranges: small ranges share one.
TASK_ROWS = 1 << 15


@dataclass(frozen=True)
class Running:
    """One running aggregate: ``how`` is sum, count, max or min.

    ``before=True`` leaves the current row out. Sums and counts start at 0, max and min
    at NULL.
    """

    name: str
    how: str
    value: Column
    before: bool = False

    def over(self, column: Column) -> Column:
        if self.how in ("sum", "count"):
            return F.sum(column)
        return {"max": F.max, "min": F.min}[self.how](column)

    def input(self) -> Column:
        if self.how == "count":
            return F.when(self.value, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))
        return self.value

    def combine(self, local: Column, carry: Column) -> Column:
        if self.how in ("sum", "count"):
            return F.coalesce(local, F.lit(0)) + F.coalesce(carry, F.lit(0))
        return (F.greatest if self.how == "max" else F.least)(local, carry)


def hot_keys(df: DataFrame, keys: Sequence[str], rows: int | None = None) -> DataFrame | None:
    """Keys with more than ``rows`` rows (``HOT_ROWS``) and their number, None if there are none. At most one key per ``rows`` rows of the table."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    hot = materialize(counts.where(F.col("_n") > (HOT_ROWS if rows is None else rows)).select(*keys, "_n"))
    return None if hot.isEmpty() else hot


def between(df: DataFrame, hot: DataFrame | None) -> DataFrame:
    """``df`` on its way from one running value to the next. Without hot keys all windows share one shuffle and one sort; with them, it is
    written out, as each step reads it twice."""
    return df if hot is None else materialize(df)


def chunked(
    df: DataFrame, keys: list[str], order: str, chunk: Column | None, hot: DataFrame | None | str, chunk_rows: int | None = None
) -> tuple[DataFrame, bool]:
    """``df`` with its chunk number, and whether any key has more than one chunk."""
    if chunk is not None:
        return df.withColumn(CHUNK, chunk), True
    if isinstance(hot, str):
        hot = hot_keys(df, keys)
    if hot is None:
        return df.withColumn(CHUNK, F.lit(0).cast("long")), False
    small = broadcast_if_small(hot.select(*keys), stored=True)
    # Ranges come out up to twice as large as wanted, as their borders are sampled.
    wanted = max(1, (CHUNK_ROWS if chunk_rows is None else chunk_rows) // 2)
    ranges = -(-hot.agg(F.sum("_n")).first()[0] // wanted)
    long = range_chunks(df.join(small, keys, "left_semi").select(*df.columns), [*keys, order], ranges, wanted)
    long = long.withColumn(CHUNK, F.col(RANGE) + 1).drop(RANGE)
    return df.join(small, keys, "left_anti").select(*df.columns).withColumn(CHUNK, F.lit(0).cast("long")).unionByName(long), True


def carried(totals: DataFrame, keys: list[str], measures: Sequence[Running]) -> DataFrame:
    """Running aggregates of chunk totals, each chunk without its own: a running aggregate in the order of the chunks."""
    at = "_at_" + CHUNK
    return running(totals.withColumnRenamed(CHUNK, at), keys, at, measures).withColumnRenamed(at, CHUNK)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    measures: Sequence[Running],
    chunk: Column | None = None,
    hot: DataFrame | None | str = "count",
    chunk_rows: int | None = None,
) -> DataFrame:
    """Add running aggregates per ``keys`` in ``order``, which must be unique within a key.

    Any type that can be sorted will do as order. ``hot`` takes the answer of ``hot_keys`` where several calls share it.
    """
    keys = list(keys)
    columns = [c for c in df.columns if c not in {m.name for m in measures}]
    placed, split = chunked(df, keys, order, chunk, hot, chunk_rows)
    parts = [*keys, CHUNK] if split else keys
    base = placed.select("*", *[m.input().alias(f"_in_{m.name}") for m in measures])
    inside = Window.partitionBy(*parts).orderBy(order)
    frames = {b: inside.rowsBetween(Window.unboundedPreceding, -1 if b else 0) for b in (True, False)}
    locals_ = {m.name: m.over(F.col(f"_in_{m.name}")).over(frames[m.before]) for m in measures}
    if not split:
        return base.select(*columns, *[m.combine(locals_[m.name], F.lit(None)).alias(m.name) for m in measures])

    chunks = base if chunk is not None else base.where(F.col(CHUNK) != 0)
    totals = materialize(chunks.groupBy(*parts).agg(*[m.over(F.col(f"_in_{m.name}")).alias(f"_in_{m.name}") for m in measures]))
    totals_of = [Running(f"_carry_{m.name}", "sum" if m.how == "count" else m.how, F.col(f"_in_{m.name}"), before=True) for m in measures]
    carry = carried(totals, keys, totals_of).select(*parts, *[m.name for m in totals_of])
    local = base.select(*columns, CHUNK, *[c.alias(f"_local_{name}") for name, c in locals_.items()])
    return local.join(broadcast_if_small(carry), parts, "left").select(
        *columns, *[m.combine(F.col(f"_local_{m.name}"), F.col(f"_carry_{m.name}")).alias(m.name) for m in measures]
    )


def since_reset(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    name: str,
    value: Column,
    reset: Column,
    total: str | None = None,
    hot: DataFrame | None | str = "count",
) -> DataFrame:
    """Add the sum of ``value`` over the rows after the latest row where ``reset`` holds.

    The resetting row itself counts 0, so ``value = is a revert`` and ``reset = is not`` gives the length of the
    current revert streak. ``total`` also keeps the plain running sum.
    """
    keys = list(keys)
    columns = [c for c in df.columns if c not in (name, total)]
    placed, split = chunked(df, keys, order, None, hot)
    parts = [*keys, CHUNK] if split else keys
    base = placed.select(
        *columns, CHUNK, F.coalesce(value.cast("long"), F.lit(0)).alias("_v"), F.coalesce(reset, F.lit(False)).alias("_reset")
    )
    inside = Window.partitionBy(*parts).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    # The sum never falls, so its value at the latest reset is the largest one seen at a reset.
    marked = lambda rows: rows.withColumn("_sum", F.sum("_v").over(inside)).withColumn(
        "_mark", F.max(F.when(F.col("_reset"), F.col("_sum"))).over(inside)
    )
    if not split:
        extra = [F.col("_sum").alias(total)] if total else []
        return marked(base).select(*columns, (F.col("_sum") - F.coalesce("_mark", F.lit(0))).alias(name), *extra)

    totals = materialize(marked(base.where(F.col(CHUNK) != 0)).groupBy(*parts).agg(F.max("_sum").alias("_sum"), F.max("_mark").alias("_mark")))
    carry = materialize(carried(totals, keys, [Running("_before", "sum", F.col("_sum"), before=True)]))
    carry = carried(carry, keys, [Running("_base", "max", F.col("_before") + F.col("_mark"), before=True)]).select(*parts, "_before", "_base")
    running_sum = F.coalesce(F.col("_before"), F.lit(0)) + F.col("_sum")
    base_sum = F.coalesce(F.coalesce(F.col("_before"), F.lit(0)) + F.col("_mark"), F.col("_base"), F.lit(0))
    extra = [running_sum.alias(total)] if total else []
    joined = marked(base).join(broadcast_if_small(carry), parts, "left")
    return joined.select(*columns, (running_sum - base_sum).alias(name), *extra)


def range_chunks(df: DataFrame, order: Sequence[str], ranges: int, rows: int) -> DataFrame:
    """Add ``_range``, which rises with ``order``: about ``ranges`` ranges of about ``rows`` rows, for order columns that are not whole numbers.

    Large ranges are partitions of a range partitioning, a task each. Small ones are cut from the sorted rows of partitions of ``TASK_ROWS`` rows, so that the number of tasks, and what they
    send to the driver, follows the table and not the size of a range. The borders depend on sampled bounds, so the result is written once and read back: every later use sees the same chunks.
    """
    if rows >= TASK_ROWS:
        return materialize(df.repartitionByRange(ranges, *order).withColumn(RANGE, F.spark_partition_id().cast("long")))
    dealt = df.repartitionByRange(-(-ranges * rows // TASK_ROWS), *order).sortWithinPartitions(*order)
    placed = dealt.withColumn(RANGE, F.monotonically_increasing_id())  # partition in the upper 31 bits, row in the lower 33
    row = F.col(RANGE).bitwiseAND(F.lit((1 << 33) - 1))
    return materialize(placed.withColumn(RANGE, F.col(RANGE) - row + F.floor(row / rows)))


def running_global(
    df: DataFrame, order: str, measures: Sequence[Running], keys: Sequence[str] = (), chunk_rows: int | None = None
) -> DataFrame:
    """Running aggregates over a whole table (or per key) in the order of any sortable column.

    The input is written and counted first, and cut into ranges of about ``chunk_rows`` rows (``CHUNK_ROWS``), so that their number
    grows with the table. What fits one range has nothing to carry and is a plain window.
    """
    keys = list(keys)
    stored = materialize(df)
    wanted = CHUNK_ROWS if chunk_rows is None else chunk_rows
    ranges = -(-stored.count() // wanted)
    if ranges <= 1:
        window = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(order)
        frames = {b: window.rowsBetween(Window.unboundedPreceding, -1 if b else 0) for b in (True, False)}
        empty = F.lit(None)
        kept = [c for c in df.columns if c not in {m.name for m in measures}]
        return stored.select(*kept, *[m.combine(m.over(m.input()).over(frames[m.before]), empty).alias(m.name) for m in measures])
    chunked = range_chunks(stored, [*keys, order], ranges, wanted)
    if not keys:
        chunked = chunked.withColumn("_all", F.lit(0))
    return running(chunked, keys or ["_all"], order, measures, F.col(RANGE)).drop("_all", RANGE)
