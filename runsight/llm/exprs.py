"""Column expressions shared by the operators that stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, also where ``body`` uses it inside other lambdas."""
    return F.transform(F.array(value), body).getItem(0)


def words(text: Column) -> Column:
    """Maximal runs of characters other than space and tab to carriage return; null text gives none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE, -1), "")


def positions(first: int, last: Column) -> Column:
    """``first``..``last``, empty where ``last`` is smaller (a plain sequence would count down)."""
    return F.when(last >= first, F.sequence(F.lit(first), last)).otherwise(F.array().cast("array<int>"))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` is called so, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
