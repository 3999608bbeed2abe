"""Reproducible shuffles: an md5 order over a key instead of a random generator.

Exact sizes need the row at a given rank of that order. It is found without sorting the
table: rows are counted per hash prefix, the prefix holding the rank follows from the
running counts, and only the rows of that one prefix are ranked. A split is then a
comparison with a few cut hashes, so the rows themselves are never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runsight.session import materialize

PREFIX_DIGITS = 4  # 65,536 prefixes


def hash_of(key: str, seed: int | str) -> Column:
    return F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))


def unit_draw(key: str, seed: int) -> Column:
    """Repeatable number in [0, 1), unrelated to the order that splits and folds use."""
    return F.conv(F.substring(hash_of(key, f"{seed}:draw"), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def rank_cuts(
    hashed: DataFrame, by: Sequence[str], ranks: Callable[[Column], Column], extra: DataFrame | None = None
) -> DataFrame:
    """Hash at each wanted rank: rows (by..., cut, cut_hash).

    ``hashed`` has the ``by`` columns and ``_h``. ``ranks`` maps the group size to an array of 1-based
    ranks, and may use columns that ``extra`` gives per group. Rank 0 has no row.
    """
    by = list(by)
    group = by or ["_all"]
    keyed = hashed.select(*(by or [F.lit(0).alias("_all")]), "_h", F.substring("_h", 1, PREFIX_DIGITS).alias("_p"))
    counts = keyed.groupBy(*group, "_p").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*group).orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    spans = counts.select(*group, "_p", "_n", F.sum("_n").over(upto).alias("_hi"))
    totals = counts.groupBy(*group).agg(F.sum("_n").alias("_total"))
    if extra is not None:
        totals = totals.join(extra, by)
    # A span works out which of its group's ranks lie inside of it: one row per span, and one more per rank that does.
    low = F.col("_hi") - F.col("_n")
    numbered = F.transform(ranks(F.col("_total")), lambda rank, i: F.struct(i.alias("cut"), (rank - low).alias("_at")))
    inside = F.filter(numbered, lambda x: (x["_at"] > 0) & (x["_at"] <= F.col("_n")))
    wanted = spans.join(totals, group).select(*group, "_p", F.explode(inside).alias("_x")).select(*group, "_p", "_x.cut", "_x._at")
    wanted = materialize(wanted)  # as many rows as cuts
    inside = keyed.join(wanted.select(*group, "_p").distinct(), [*group, "_p"], "left_semi")
    ranked = inside.withColumn("_at", F.row_number().over(Window.partitionBy(*group, "_p").orderBy("_h")).cast("long"))
    return ranked.join(wanted, [*group, "_p", "_at"]).select(*by, "cut", F.col("_h").alias("cut_hash"))


def cut_hashes(df: DataFrame, key: str, seed: int, ranks: Callable[[Column], Column]) -> dict[int, str]:
    """Cut hashes of the whole table as a few literals (one per wanted rank)."""
    rows = rank_cuts(df.select(hash_of(key, seed).alias("_h")), [], ranks).collect()
    return {row["cut"]: row["cut_hash"] for row in rows}
