"""Imports every query module, which registers its queries."""

from runsight.queries import files, live, logs, preparing, profiling, scoring, training  # noqa: F401
