"""Chains through long sequences without a loop over their rows.

Where each row points to one later row, the rows on the chain from a start are found by pointer doubling: a round adds the targets of all rows found so far and makes every pointer twice as
long, so that a chain of n rows takes log n rounds. The pointers themselves come from a tree of block minima, ``SPAN`` children each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runsight.plans.sizing import broadcast_if_small
from runsight.session import materialize

SPAN_BITS = 6
SPAN = 1 << SPAN_BITS


def next_below(rows: DataFrame, keys: Sequence[str], span_bits: int = SPAN_BITS) -> DataFrame:
    """Pointer of each row to the first later row of its key whose ``value`` is below the row's ``limit``: (keys..., place, target), target NULL without one.

    ``rows``: keys, place (0, 1, 2, ... per key), value and limit. What a block of ``2**span_bits`` rows holds is looked up inside the block. The rest climb to blocks of blocks until
    one of the later blocks has a small enough minimum, and go down again into the first such block. So each row meets a few short lists, whatever the length of its key.
    """
    keys = list(keys)
    up = lambda c: F.shiftright(c, span_bits)
    leaf = rows.select(*keys, up("place").alias("block"), F.struct("place", F.col("value").alias("least")).alias("child"), "limit")
    lists = materialize(leaf.groupBy(*keys, "block").agg(F.array_sort(F.collect_list("child")).alias("children"), F.array_sort(F.collect_list(F.struct("child.place", "limit"))).alias("limits")))
    inside = F.transform("limits", lambda own: F.struct(own["place"].alias("place"), own["limit"].alias("limit"), _first("children", own["place"], own["limit"]).alias("target")))
    level = lists.select(*keys, F.explode(inside).alias("x")).select(*keys, "x.*")
    out, left = level.where("target IS NOT NULL").select(*keys, "place", "target"), level.where("target IS NULL").select(*keys, "place", "limit", up("place").alias("at"))
    tree = [lists.select(*keys, "block", "children")]
    while True:
        # ``left`` stands at blocks of the level below; their siblings that come later are looked at next.
        parents = tree[-1].select(*keys, up("block").alias("parent"), F.struct(F.col("block").alias("place"), F.array_min(F.transform("children", lambda c: c["least"])).alias("least")).alias("child"))
        parents = materialize(parents.groupBy(*keys, F.col("parent").alias("block")).agg(F.array_sort(F.collect_list("child")).alias("children")))
        if parents.where("block > 0 OR size(children) > 1").isEmpty():
            return out.unionByName(left.select(*keys, "place", F.lit(None).cast("long").alias("target")))
        seen = left.withColumn("block", up("at")).join(broadcast_if_small(parents, stored=True), [*keys, "block"])
        seen = materialize(seen.select(*keys, "place", "limit", F.col("block").alias("parent"), _first("children", F.col("at"), F.col("limit")).alias("block")))
        down = seen.where("block IS NOT NULL").select(*keys, "place", "limit", "block")
        for lists_below in reversed(tree):
            met = down.join(broadcast_if_small(lists_below, stored=True), [*keys, "block"])
            down = met.select(*keys, "place", "limit", _first("children", F.lit(-1).cast("long"), F.col("limit")).alias("block"))
        out = out.unionByName(down.select(*keys, "place", F.col("block").alias("target")))
        left = seen.where("block IS NULL").select(*keys, "place", "limit", F.col("parent").alias("at"))
        tree.append(parents)


def _first(children: str, after: Column, limit: Column) -> Column:
    """Place of the first child behind ``after`` whose least value is below ``limit``."""
    return F.get(F.filter(children, lambda c: (c["place"] > after) & (c["least"] < limit)), F.lit(0))["place"]


def on_chain(pointers: DataFrame, keys: Sequence[str], start: int = 0) -> DataFrame:
    """Rows (keys..., place) that a chain from place ``start`` of each key meets, that place included. ``pointers``: keys, place, target."""
    keys = list(keys)
    jumps = materialize(pointers.where("target IS NOT NULL").select(*keys, "place", "target"))
    reached = materialize(pointers.where(F.col("place") == start).select(*keys, "place"))
    while not jumps.isEmpty():
        met = reached.join(jumps, [*keys, "place"]).select(*keys, F.col("target").alias("place"))
        reached = materialize(reached.unionByName(met))
        on = jumps.select(*keys, F.col("place").alias("target"), F.col("target").alias("then"))
        jumps = materialize(jumps.join(on, [*keys, "target"]).select(*keys, "place", F.col("then").alias("target")))
    return reached
