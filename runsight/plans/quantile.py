"""Exact medians of large columns by radix selection: three scans, whatever the values.

A double has an image among the 64-bit whole numbers that keeps its order. Each scan counts the values of all columns at once by the next ``DIGITS`` bits of their images, among those that share
the bits found before, and so fixes these bits of the wanted ranks. Counts are combined before the shuffle; digits are looked up half by half, so that
no step sees more than ``2 ** (DIGITS / 2)`` counts of a column at once. No sketch and no guess is involved, and ties are one count.
"""

from __future__ import annotations

import struct
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits per scan; the last one takes what is left of 64.
DIGITS = 22
_HALF = DIGITS // 2
#: Scale of the smallest normal number, and its exponent. Smaller numbers are multiples of 2**-1074.
_LEAST_EXPONENT, _FRACTION = -1022, 52


def ordered_images(df: DataFrame, columns: dict[str, Column], beside: Sequence[str] = ()) -> DataFrame:
    """The columns as whole numbers of 64 bits that order doubles as they are: the bit pattern of the size, with the number's sign. NULL and NaN give NULL.

    Each step is a projection of its own, so that no value is worked out twice. Columns named in ``beside`` stay.
    """
    least, none = F.lit(2.0**_LEAST_EXPONENT), F.lit(None)
    x = df.select(*beside, *[F.nanvl(c.cast("double"), none).alias(f"{n}_x") for n, c in columns.items()])
    sizes = x.select("*", *[F.abs(f"{n}_x").alias(f"{n}_size") for n in columns])
    usual = lambda n: F.when((F.col(f"{n}_size") >= least) & (F.col(f"{n}_size") < float("inf")), F.col(f"{n}_size"))
    # The logarithm may be off by one next to a power of two; its share of the size tells.
    exponents = sizes.select("*", *[F.greatest(F.least(F.floor(F.log2(usual(n))).cast("int"), F.lit(1 - _LEAST_EXPONENT)), F.lit(_LEAST_EXPONENT)).alias(f"{n}_e") for n in columns])
    shares = exponents.select("*", *[(F.col(f"{n}_size") / F.pow(F.lit(2.0), F.col(f"{n}_e"))).alias(f"{n}_share") for n in columns])  # exact: only the exponent moves

    def image(n: str) -> Column:
        value, size, e, share = (F.col(f"{n}_{c}") for c in ("x", "size", "e", "share"))
        off = F.when(share < 1, -1).when(share >= 2, 1).otherwise(0)
        fraction = F.when(share < 1, share * 2).when(share >= 2, share / 2).otherwise(share) - 1
        normal = (e + off - (_LEAST_EXPONENT - 1)).cast("long") * F.lit(2**_FRACTION) + (fraction * F.lit(2.0**_FRACTION)).cast("long")
        tiny = (F.when(size < least, size) * F.lit(2.0**537) * F.lit(2.0**537)).cast("long")
        found = F.when(size == float("inf"), F.lit(2047 * 2**_FRACTION)).when(size < least, tiny).otherwise(normal)
        return F.when(value < 0, -1).when(value >= 0, 1) * found

    return shares.select(*beside, *[image(n).alias(n) for n in columns])


def from_image(image: int) -> float:
    size = struct.unpack("<d", struct.pack("<q", abs(image)))[0]
    return -size if image < 0 else size


def exact_medians(df: DataFrame, columns: dict[str, Column]) -> dict[str, float | None]:
    """Median of each expression, averaging the two middle values of an even count; None where there is no value."""
    names = list(columns)
    if not names:
        return {}
    # One row per value, before anything is worked out: the expressions are those of one column, however many there are.
    values = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("c"), columns[n].cast("double").alias("x")) for i, n in enumerate(names)])).alias("s")).select("s.*")
    images = ordered_images(values.where(F.col("x").isNotNull()), {"v": F.col("x")}, ["c"])
    found = _ranked(images, len(names))
    middle = {n: [from_image(found[i, side]) for side in ("lo", "hi")] for i, n in enumerate(names) if (i, "lo") in found}
    return {n: (middle[n][0] if middle[n][0] == middle[n][1] else sum(middle[n]) / 2) if n in middle else None for n in names}


def _ranked(images: DataFrame, columns: int) -> dict[tuple[int, str], int]:
    """Image at both middle ranks of each column: by (column, 'lo' or 'hi')."""
    known: dict[tuple[int, str], tuple[int, int]] = {}  # upper bits found so far, and the rank among the values that share them
    shift = 64
    while shift > 0:
        shift, before = max(0, shift - DIGITS), shift
        rows = _digit_at_rank(images, columns, known, shift, before)
        if not rows:
            return {}
        known = {(r["c"], r["side"]): ((r["head"] << (before - shift)) + r["digit"], r["left"]) for r in rows}
    return {key: image for key, (image, _) in known.items()}


def _digit_at_rank(images: DataFrame, columns: int, known: dict, shift: int, before: int) -> list:
    """One scan: per column and side the next bits at the wanted rank, and the rank among the values that share them too. The first scan finds the ranks from the counts."""
    first = not known
    low = (1 << (before - shift)) - 1
    v = F.col("v")
    head = F.lit(0).cast("long") if first else F.shiftright(v, before)
    digit = F.shiftright(v, shift) if first else F.shiftright(v, shift).bitwiseAND(F.lit(low).cast("long"))
    heads = lambda side: F.get(F.array(*[F.lit(known.get((i, side), (None,))[0]).cast("long") for i in range(columns)]), F.col("c"))
    inside = v.isNotNull() if first else (head == heads("lo")) | (head == heads("hi"))
    # A condition on v would be moved below the projections, each of which would then be worked out again for it; inside a generator it stays where it is.
    entry = F.when(inside, F.struct("c", head.alias("head"), digit.alias("digit")))
    each = images.select(F.explode(F.filter(F.array(entry), lambda s: s.isNotNull())).alias("s")).select("s.*")
    counts = each.groupBy("c", "head", F.shiftright("digit", _HALF).alias("upper"), "digit").agg(F.count(F.lit(1)).alias("n"))
    uppers = counts.groupBy("c", "head", "upper").agg(F.sum("n").alias("n"))
    if first:
        size = uppers.groupBy("c", "head").agg(F.sum("n").alias("size"))
        sides = F.array(F.struct(F.lit("lo").alias("side"), F.expr("(size + 1) div 2").alias("rank")), F.struct(F.lit("hi").alias("side"), F.expr("size div 2 + 1").alias("rank")))
        wanted = size.select("c", "head", F.explode(sides).alias("w")).select("c", "head", "w.side", "w.rank")
    else:
        rows = [(c, head, side, rank) for (c, side), (head, rank) in known.items()]
        wanted = images.sparkSession.createDataFrame(rows, "c int, head long, side string, rank long")
    place = lambda by, order: Window.partitionBy("c", "head", *by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    # At most 2**_HALF rows per column in either window: counts, not values.
    ends = uppers.withColumn("end", F.sum("n").over(place([], "upper")))
    at = ends.join(F.broadcast(wanted), ["c", "head"]).where((F.col("rank") <= F.col("end")) & (F.col("rank") > F.col("end") - F.col("n")))
    at = at.select("c", "head", "upper", "side", (F.col("rank") - F.col("end") + F.col("n")).alias("rank"))
    inner = counts.join(F.broadcast(at.select("c", "head", "upper").distinct()), ["c", "head", "upper"]).withColumn("end", F.sum("n").over(place(["upper"], "digit")))
    hit = inner.join(F.broadcast(at), ["c", "head", "upper"]).where((F.col("rank") <= F.col("end")) & (F.col("rank") > F.col("end") - F.col("n")))
    return hit.select("c", "head", "side", "digit", (F.col("rank") - F.col("end") + F.col("n")).alias("left")).collect()
