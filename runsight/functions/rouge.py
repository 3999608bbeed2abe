"""N-gram and subsequence overlap of two texts, row by row: nothing is shuffled for it."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORDS = re.compile(r"[a-z0-9]+")  # fixed pattern: what counts as a token after lower-casing


def _f1(common: int, predicted: int, wanted: int) -> float:
    return 2.0 * common / (predicted + wanted) if common else 0.0


def tokens(text: Column) -> Column:
    """Tokens of a text; none of a null one."""
    return F.regexp_extract_all(F.coalesce(F.lower(text), F.lit("")), F.lit(f"({WORDS.pattern})"))


def pairs(words: Column) -> Column:
    """Neighbouring tokens as one."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda x, y: F.concat_ws(" ", x, y))


def overlap_f1(predicted: Column, wanted: Column) -> Column:
    """F1 of the elements that two arrays share, as often as both have them: one pass over both in sorted order, in which the first one's copies of a value come before the second one's."""
    side = lambda words, number: F.transform(words, lambda w: F.struct(w.alias("word"), F.lit(number).alias("side")))
    both = F.array_sort(F.concat(side(predicted, 0), side(wanted, 1)))
    start = F.struct(F.lit("").alias("word"), F.lit(0).alias("left"), F.lit(0).alias("common"))

    def step(state: Column, x: Column) -> Column:
        left = F.when(state["word"] == x["word"], state["left"]).otherwise(0)
        met = ((x["side"] == 1) & (left > 0)).cast("int")
        return F.struct(x["word"].alias("word"), (left + F.when(x["side"] == 0, 1).otherwise(-met)).alias("left"), (state["common"] + met).alias("common"))

    common = F.aggregate(both, start, step)["common"]
    return F.when(common > 0, 2.0 * common / (F.size(predicted) + F.size(wanted))).otherwise(0.0)


def common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, one whole-row bit operation per token of ``b``."""
    places: dict[str, int] = {}
    for i, token in enumerate(a):
        places[token] = places.get(token, 0) | 1 << i
    full = (1 << len(a)) - 1
    free = full
    for token in b:
        hits = free & places.get(token, 0)
        free = ((free + hits) | (free - hits)) & full
    return len(a) - free.bit_count()


@F.pandas_udf(T.DoubleType())
def rouge_longest(predicted: pd.Series, wanted: pd.Series) -> pd.Series:
    """F1 of the longest common subsequence of two token arrays. Whole rows of the table are one number here, 64 places and more at a time; array expressions would take each place alone."""
    return pd.Series([_f1(common_subsequence(list(a), list(b)), len(a), len(b)) for a, b in zip(predicted, wanted)], dtype=float)
