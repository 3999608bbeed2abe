"""Bounded samples of labelled rows for fitting a classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runsight.plans.sizing import broadcast_if_small
from runsight.session import materialize

DRAWS = 1 << 30


def remainder(doc_id: Column | str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null ids have 0."""
    return F.coalesce(F.crc32((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string").cast("binary")) % parts, F.lit(0))


def labelled_texts(docs: DataFrame, labels: DataFrame, per_label: int, max_bytes: int) -> list[tuple[str, object]]:
    """(text, label) of at most ``per_label`` documents of each label, drawn by hashes of their id, in a fixed order.

    ``labels``: doc_id, label. Empty texts and texts beyond ``max_bytes`` are passed over, so that the driver holds a bounded amount. Only ids and lengths
    are shuffled; the chosen texts are picked from a scan.
    """
    usable = docs.where(F.octet_length("text").between(1, max_bytes)).select("doc_id")
    keyed = labels.where("label IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label"))
    known = materialize(usable.distinct().join(keyed, "doc_id"))
    # A hash keeps about twice as many of each label as are wanted, whatever its size, before rows are ranked.
    share = known.groupBy("label").agg(F.ceil(F.lit(2.0 * per_label * DRAWS) / F.count("*")).alias("below"))
    drawn = known.join(broadcast_if_small(share), "label").where(F.pmod(F.xxhash64("doc_id", F.lit("draw")), F.lit(DRAWS)) < F.col("below"))
    first = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = drawn.withColumn("n", F.row_number().over(first)).where(F.col("n") <= per_label).select("doc_id", "label")
    picked = docs.where(F.octet_length("text").between(1, max_bytes)).select("doc_id", "text").join(broadcast_if_small(materialize(chosen), stored=True), "doc_id")
    rows = picked.groupBy("doc_id", "label").agg(F.min("text").alias("text")).toLocalIterator()
    return [(r["text"], r["label"]) for r in sorted(rows, key=lambda r: r["doc_id"])]
