"""How many rows go to Python at a time."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Texts may be long: with Spark's default of 10,000 rows a batch would be held several times over, in the JVM and in each worker.
ROWS = 512


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session sends at most ``ROWS`` rows to Python at once from now on."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= ROWS:
        conf.set(key, str(ROWS))
    return df


def gathered(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The rows in batches of up to ``size`` bytes; a batch that is larger comes by itself."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if held and sum(b.nbytes for b in held) + batch.nbytes > size:
            yield pa.concat_batches(held)
            held = []
        held.append(batch)
    if held:
        yield pa.concat_batches(held)
