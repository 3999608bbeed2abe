"""Named preparation steps of a domain: a plain table of functions from DataFrame to DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame

from runsight.operators.catalog import METRICS, direction_of

Step = Callable[[DataFrame], DataFrame]


@dataclass
class Domain:
    """A domain's name, its metrics with directions, and its steps in the order they run."""

    name: str
    metrics: dict[str, str] = field(default_factory=dict)
    steps: dict[str, Step] = field(default_factory=dict)
    custom_metrics: dict[str, Callable[[Column, Column], Column]] = field(default_factory=dict)

    def step(self, function: Step, name: str | None = None) -> Step:
        self.steps[name or function.__name__] = function
        return function

    def metric(self, name: str, direction: str, aggregate: Callable[[Column, Column], Column]) -> None:
        """Add a metric of one's own: an aggregate expression over truth and prediction, with its direction."""
        self.metrics[name] = direction_of(name, direction)
        self.custom_metrics[name] = aggregate

    def run(self, df: DataFrame) -> DataFrame:
        for function in self.steps.values():
            df = function(df)
        return df


_domains: dict[str, Domain] = {}


def register(domain: Domain) -> Domain:
    _domains[domain.name] = domain
    return domain


def get(name: str) -> Domain:
    if name not in _domains:
        raise KeyError(f"no domain {name!r}; known: {sorted(_domains)}")
    return _domains[name]


def names() -> list[str]:
    return sorted(_domains)


for _name in sorted({d for d, _, _ in METRICS}):
    register(Domain(_name, {m: direction for d, m, direction in METRICS if d == _name}))


def score_batches(df: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.Series]], schema: str) -> DataFrame:
    """Add ``y_pred`` by any model: ``load`` runs once per task, its result scores one Arrow batch at a time.

    ``schema`` is the output schema, the input columns followed by ``y_pred``.
    """

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            yield batch.assign(y_pred=model(batch))

    return df.mapInPandas(predict, schema)
