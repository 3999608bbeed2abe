"""Medians by radix selection equal those of sorted values, bit for bit."""

import math
import random
import statistics
import struct

import pytest
from pyspark.sql import functions as F

from runsight.plans.quantile import exact_medians, from_image, ordered_images

EDGES = [0.0, -0.0, 5e-324, -5e-324, 2.0**-1022, math.nextafter(2.0**-1022, 0), 1.7976931348623157e308, -1.7976931348623157e308, float("inf"), float("-inf")]


def _bits(x):
    size = struct.unpack("<q", struct.pack("<d", abs(x)))[0]
    return -size if x < 0 else size


def test_images_are_the_bits_of_doubles(spark):
    values = EDGES + [s * math.nextafter(2.0**e, to) for e in range(-1074, 1024) for to in (0, 2.0**e, math.inf) for s in (1, -1) if e > -1074 or to == 2.0**e]
    draw = random.Random(1)
    values += [struct.unpack("<d", struct.pack("<Q", draw.getrandbits(64)))[0] for _ in range(20_000)]
    df = spark.createDataFrame([(v,) for v in values], "v double").coalesce(1)
    for v, (i,) in zip(values, ordered_images(df, {"i": F.col("v")}).collect(), strict=True):
        if math.isnan(v):
            assert i is None
        else:
            assert i == _bits(v), v
            assert from_image(i) == v


def _median(values):
    values = [v for v in values if v is not None and not math.isnan(v)]
    return statistics.median(values) if values else None


@pytest.mark.parametrize("n", [1, 2, 3, 2000, 2001])
def test_equal_sorted_values(spark, n):
    draw = random.Random(n)
    data = [
        (draw.choice([1.0, 2.0, None]), draw.gauss(0, 1), 5.0, None, draw.choice([-1, 1]) * 10 ** draw.uniform(-300, 300), float("nan") if draw.random() < 0.3 else draw.gauss(1e9, 1e-3), draw.choice(EDGES[:8]))
        for _ in range(n)
    ]
    df = spark.createDataFrame(data, "a double, b double, c double, d double, e double, f double, g double").repartition(5)
    assert exact_medians(df, {c: F.col(c) for c in "abcdefg"}) == {c: _median([row[k] for row in data]) for k, c in enumerate("abcdefg")}


def test_infinities_empty_tables_and_whole_numbers(spark):
    df = spark.createDataFrame([(float("-inf"), 3, None), (float("inf"), 2**53, None), (7.0, -1, None)], "x double, i long, n int")
    assert exact_medians(df, {"x": F.col("x"), "i": F.col("i"), "n": F.col("n")}) == {"x": 7.0, "i": 3.0, "n": None}
    assert exact_medians(df.limit(0), {"x": F.col("x")}) == {"x": None}


def test_many_distinct_values(spark):
    df = spark.range(1_000_001).select((F.xxhash64("id") / 3.7).alias("x"), (F.col("id") % 3).alias("tied"))
    want = df.agg(F.expr("percentile(x, 0.5)"), F.expr("percentile(tied, 0.5)")).first()
    assert exact_medians(df, {"x": F.col("x"), "tied": F.col("tied")}) == {"x": want[0], "tied": want[1]}


def test_three_scans_and_no_window_over_values(spark):
    """Each scan counts digits before its first shuffle; windows see counts by half a digit."""
    from unittest import mock

    from runsight.plans import quantile

    with mock.patch.object(quantile, "_digit_at_rank", wraps=quantile._digit_at_rank) as scan:
        quantile.exact_medians(spark.range(1000).select(F.rand(1).alias("x")), {"x": F.col("x")})
    assert scan.call_count == 3
