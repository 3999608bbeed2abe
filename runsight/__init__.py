"""Model-experiment analytics as Spark jobs: profiling, preparation, scoring, diagnostics, run logs."""
