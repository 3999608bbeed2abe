"""Scalar rules shared by the operators: missing values, finiteness, guarded statistics, formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLOATS = (T.FloatType, T.DoubleType)


def clean_floats(df: DataFrame) -> DataFrame:
    """NaN and NULL are one kind of missing: turn NaN into NULL in every float column."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, FLOATS)}
    if not floats:
        return df
    return df.select(*[present(F.col(f"`{c}`")).alias(c) if c in floats else F.col(f"`{c}`") for c in df.columns])


def present(column: Column) -> Column:
    return F.nanvl(column, F.lit(None))


def is_finite(column: Column) -> Column:
    """False for NULL, NaN and both infinities."""
    value = column.cast("double")
    return F.coalesce(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), F.lit(False))


def is_wrong(truth: Column, guess: Column) -> Column:
    return ~truth.eqNullSafe(guess)


def pearson(a: Column, b: Column) -> Column:
    """Correlation over rows where both are present; NULL where either is constant.

    Aggregate expression. ``corr`` itself raises on a constant column under ANSI rules.
    """
    both = a.isNotNull() & b.isNotNull()
    x = F.when(both, a.cast("double"))
    y = F.when(both, b.cast("double"))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0 or missing."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def fixed(column: Column, digits: int, signed: bool = False) -> Column:
    """Number as text with fixed decimals, '-' when missing. Rounds the exact binary value, half to even."""
    body = "0." + "0" * digits
    pattern = f"+{body};-{body}" if signed else body
    text = F.call_function("format_number", column.cast("double"), F.lit(pattern))
    return F.when(column.isNull(), F.lit("-")).otherwise(text)


def shorten(column: Column, limit: int, keep: int) -> Column:
    """Text longer than ``limit`` is cut to ``keep`` characters plus '...'."""
    return F.when(F.length(column) > limit, F.concat(F.substring(column, 1, keep), F.lit("..."))).otherwise(column)


def better(a: Column, b: Column, direction: str) -> Column:
    """Strictly better metric."""
    return a > b if check_direction(direction) == "maximize" else a < b


def check_direction(direction: str) -> str:
    if direction not in ("maximize", "minimize"):
        raise ValueError(f"direction must be 'maximize' or 'minimize', not {direction!r}")
    return direction


def parent_folder(path: Column) -> Column:
    return F.try_element_at(F.split(path, "/"), F.lit(-2))
