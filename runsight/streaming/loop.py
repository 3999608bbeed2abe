"""The keep/revert loop of a run, one attempt at a time: what a stream keeps per run."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from runsight.functions.values import is_finite
from runsight.operators.runlog import is_out_of_memory


class Rules(NamedTuple):
    """``sign`` is 1 to maximize, -1 to minimize; ``bar`` the best baseline score; ``families`` those a stagnated run moves to."""

    sign: float
    bar: float | None
    families: tuple[str, ...]
    threshold: int
    max_retries: int


class Loop(NamedTuple):
    best: float | None = None
    kept: bool = False
    streak: int = 0
    errors: int = 0
    tried: int = 0
    stopped: bool = False


class Decision(NamedTuple):
    action: str
    gated: bool
    best_before: float | None
    consecutive_reverts: int
    family: str | None


FIELDS = "best double, kept boolean, streak long, errors long, tried long, stopped boolean"


def ran() -> Column:
    """Whether an attempt ended with a score."""
    return F.coalesce(~F.col("status").isin("crash", "timeout") & is_finite(F.col("metric_value")), F.lit(False))


def out_of_memory() -> Column:
    return F.coalesce(is_out_of_memory(F.col("status"), F.col("error")), F.lit(False))


def advance(state: Loop, finished: bool, memory: bool, metric: float | None, rules: Rules) -> tuple[Loop, Decision]:
    """State after an attempt of a run that has not stopped, and what is done with the attempt."""
    best, kept, streak, errors, tried, _ = state
    improved = finished and (best is None or rules.sign * metric > rules.sign * best)
    passed = rules.bar is None or (finished and rules.sign * metric > rules.sign * rules.bar)
    errors = 0 if improved else errors + memory
    before, family, stopped = best, None, False
    if memory:
        stopped = errors > rules.max_retries
        action = "stop" if stopped else "retry"
    elif improved and passed:
        action, best, kept, streak = "keep", float(metric), True, 0
    else:
        action, streak = "revert", streak + 1
        if not improved and kept and streak >= rules.threshold and tried < len(rules.families):
            family, tried, streak = rules.families[tried], tried + 1, 0
    return Loop(best, kept, streak, errors, tried, stopped), Decision(action, bool(improved and not passed), before, streak, family)
