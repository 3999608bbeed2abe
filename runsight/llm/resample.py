"""Importance resampling of documents towards a target distribution, over hashed n-gram features.

1. Batch concatenation: the texts of a stretch of a batch are joined with a separator that is no word character, one regular expression pass finds all words, ``searchsorted`` over the texts'
   offsets says whose they are, and n-grams whose words belong to two texts are masked out. What is left is hashed into buckets and written once, two bytes per feature.
2. ``bincount`` per task, summed per bucket, gives the bucket counts of the raw texts and of the target's; the gain of a bucket is the logarithm of the ratio of both shares.
3. A document's weight is the mean gain of its features. With Gumbel noise drawn from its id, the highest scores are a sample without replacement in proportion to the weights. Ranks come from
   a sort in ranges with carried counts.

Per task there is one row per bucket, whatever the size of the texts; the driver holds one number per bucket.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runsight.llm.batches import small_batches
from runsight.llm.textbytes import slices
from runsight.plans.running import Running, running_global
from runsight.session import materialize

BUCKETS = 10_000
LONGEST = 2
LEAST_WORDS = 20
PERCENT = 25
SEED = 7
#: Rows per range when documents are ranked.
RANGE_ROWS = 1 << 15
#: Over lower-cased UTF-8: digits, letters and everything beyond ASCII.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_SEPARATOR = b"\0"


def _stretch(texts: list[bytes], longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts worked on together: buckets of all features text by text, the borders of the texts among them, and words per text."""
    joined = _SEPARATOR.join(texts).lower()
    offsets = np.cumsum([0, *[len(t) + 1 for t in texts[:-1]]])
    found = list(_WORD.finditer(joined))
    words = [m[0] for m in found]
    owner = np.searchsorted(offsets, np.fromiter((m.start() for m in found), np.int64, len(found)), "right") - 1
    del found
    sums = np.fromiter(map(zlib.crc32, words), np.int64, len(words))
    owners, hashes = [owner], [sums]
    spaced = [b" " + w for w in words]
    for n in range(2, longest + 1):  # a checksum goes on where that of the words before it ended
        sums = np.fromiter(map(zlib.crc32, spaced[n - 1 :], sums[: len(words) - n + 1].tolist()), np.int64, max(len(words) - n + 1, 0))
        inside = owner[: len(sums)] == owner[n - 1 :]
        owners.append(owner[: len(sums)][inside])
        hashes.append(sums[inside])
    owners, hashes = np.concatenate(owners), np.concatenate(hashes)
    order = np.argsort(owners, kind="stable")
    borders = np.searchsorted(owners[order], np.arange(len(texts) + 1))
    return (hashes[order] % buckets).astype("<u2"), borders, np.bincount(owner, minlength=len(texts))


def features(docs: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, buckets (those of all runs of 1 to ``longest`` words, repeats included, as little-endian 16-bit numbers) of each row (doc_id, text)."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets are numbers of 16 bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "").cast(pa.binary())
            borders = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64)])
            for first, last in slices(borders):
                values, cuts, words = _stretch(texts.slice(first, last - first).to_pylist(), longest, buckets)
                own = pa.array([values[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(words), own], ["doc_id", "n_words", "buckets"])

    return small_batches(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, n_words long, buckets binary")


def _all_buckets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a whole column one after the other, and the borders of its rows."""
    values = np.frombuffer(b"".join(column.to_pylist()), "<u2")
    return values, np.concatenate([[0], np.cumsum(pc.binary_length(column).to_numpy(), dtype=np.int64) // 2])


def bucket_counts(found: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: features of all rows per bucket that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            counts += np.bincount(_all_buckets(batch.column(0))[0], minlength=buckets)
        own = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(counts[own])], ["bucket", "n"])

    return found.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Gain of each bucket, in thousandths, from the counts (bucket, n) of raw and target features."""
    every = raw.sparkSession.range(buckets).select(F.col("id").alias("bucket"))
    both = every.join(raw.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").select("bucket", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in "st"])
    totals = both.agg(F.sum("s").alias("s_all"), F.sum("t").alias("t_all"))  # one row
    share = (F.col("t") + 1) * (F.col("s_all") + buckets) / ((F.col("s") + 1) * (F.col("t_all") + buckets))
    rows = both.join(F.broadcast(totals)).select("bucket", F.floor(1000 * F.log(share)).alias("gain")).collect()  # one number per bucket
    out = np.zeros(buckets, np.int64)
    out[[r.bucket for r in rows]] = [r.gain for r in rows]
    return out


def weights(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight (mean gain, rounded down; 0 without features)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, borders = _all_buckets(batch.column(2))
            sums = np.concatenate([[0], np.cumsum(gain[values])])
            n = np.diff(borders)
            mean = (sums[borders[1:]] - sums[borders[:-1]]) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(mean)], ["doc_id", "n_words", "n_features", "weight"])

    return found.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED
) -> DataFrame:
    """doc_id, n_features, weight, score of each document, and its rank among the ``percent`` that are drawn (null: not drawn).

    Words are runs of ASCII digits and letters (A-Z lower-cased) and all characters beyond ASCII. Documents with fewer than ``least_words`` words have a weight and a score, but are never
    drawn. Null and empty texts have no feature and weight 0. Rows that share a doc_id share the noise and are drawn each by their own weight; if all is equal, their ranks are in any order. Rows without a doc_id
    count as raw text, but have no score and are not drawn. An empty table gives no rows, an empty target one in which all buckets are as likely. Only doc_id and text of ``docs`` and text of
    ``target`` are read.
    """
    raw = materialize(features(docs, longest, buckets))
    wanted = features(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), longest, buckets)
    gain = gains(bucket_counts(raw, buckets), bucket_counts(wanted, buckets), buckets)
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    drawn = F.floor(-1000 * F.log(-F.log((noise + 0.5) / 4294967296.0)))
    scored = weights(raw, gain).withColumn("score", F.col("weight") + drawn)
    able = F.coalesce(F.col("score").isNotNull() & (F.col("n_words") >= least_words), F.lit(False))
    scored = materialize(scored.select("doc_id", "n_features", "weight", "score", F.struct((~able).alias("out"), (-F.col("score")).alias("score"), "doc_id").alias("place")))
    quota = scored.where("NOT place.out").count() * percent // 100
    ranked = running_global(scored, "place", [Running("rank", "count", F.lit(True))], chunk_rows=RANGE_ROWS)
    return ranked.select("doc_id", "n_features", "weight", "score", F.when(~F.col("place.out") & (F.col("rank") <= quota), F.col("rank")).alias("rank"))
