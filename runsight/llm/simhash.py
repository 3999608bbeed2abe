"""Near-duplicate documents by SimHash fingerprints and covering locality-sensitive hashing.

1. Fingerprint: each bit of 64 is the majority of that bit over the XXH64 hashes of all word shingles of a text, repeats included. Equal fingerprints are one node.
2. Covering: every bit place gets a vector of ``radius + 1`` bits, not zero; for each vector ``v``, not zero, a mask takes the places whose vector has an odd product with
   ``v``. The places in which two fingerprints differ give at most ``radius`` equations, so some ``v`` solves them all: its mask leaves out all those places, and the two
   fingerprints are equal under it. So each pair within the radius shares a bucket in one table at least, with certainty.
3. Buckets of two are tested at once, those of up to ``LISTED`` nodes as one list in a task. In a larger one, fingerprints differ outside of the mask only; two of them are within the radius if
   and only if some value lies within half of it from both. So each node goes to all such values, and those that meet at one are linked with the least of them: rows in proportion to the nodes,
   split over all values, and no pair is lost.
4. Components by star contraction over tables in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runsight.llm.batches import small_batches
from runsight.llm.neardup import components
from runsight.plans.sizing import broadcast_if_small
from runsight.session import materialize

BITS = 64
RADIUS = 4
WORDS = 4
SEED = 42
#: Nodes of a bucket that are compared in one list; it costs their square in a task, so that larger buckets take the other way, which finds the same.
LISTED = 4096
_AT_ONCE = 1 << 16


def shingle_hashes(text: str | None, n: int = WORDS) -> np.ndarray:
    """XXH64 of each run of ``n`` words (of all words if they are fewer), repeats included."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z only, and white space of ASCII only
    if not words:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    spans = zip(starts[: max(len(words) - n + 1, 1)], ends[min(n, len(words)) - 1 :].tolist())
    return np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans], "<u8")


def fingerprint(text: str | None, n: int = WORDS) -> int:
    """Majority of the bits of all shingle hashes, unsigned; 0 without words."""
    hashes = shingle_hashes(text, n)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), _AT_ONCE):
        part = hashes[i : i + _AT_ONCE]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, n: int = WORDS) -> DataFrame:
    """doc_id, print: the fingerprint of each row as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py(), n) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "print"])

    return small_batches(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, print long")


def covering(radius: int = RADIUS) -> list[int]:
    """Masks of ``BITS`` bits: for each set of at most ``radius`` places, one mask at least has none of them."""
    vectors = [1 + place % (2 ** (radius + 1) - 1) for place in range(BITS)]
    return [sum(1 << place for place, own in enumerate(vectors) if (own & v).bit_count() % 2) for v in range(1, 2 ** (radius + 1))]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _chains(prints: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Links that join the same nodes as all pairs within the radius: each node with the one from which it was reached."""
    left, ahead, a, b = np.arange(len(prints)), [], [], []
    while len(left):
        if not ahead:
            ahead.append(left[0])
            left = left[1:]
        own = ahead.pop()
        near = np.bitwise_count(prints[left] ^ prints[own]) <= radius
        found = left[near]
        left = left[~near]
        ahead.extend(found.tolist())
        a.extend([own] * len(found))
        b.extend(found.tolist())
    return a, b


def _listed(lists: DataFrame, radius: int) -> DataFrame:
    """(a, b) of linked nodes in each of ``lists`` (prints)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).flatten().to_numpy().view(np.uint64)
            borders = np.concatenate([[0], np.cumsum(batch.column(0).value_lengths().to_numpy())])
            out: list[np.ndarray] = [np.zeros((0, 2), np.uint64)]
            for i, j in zip(borders[:-1], borders[1:]):
                own = values[i:j]
                out.append(np.stack([own[np.array(x, int)] for x in _chains(own, radius)], axis=1))
            a, b = np.concatenate(out).view(np.int64).T
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return lists.mapInArrow(run, "a long, b long")


def _met(members: DataFrame, masks: list[int], radius: int) -> DataFrame:
    """(a, b) of linked nodes in buckets (band, key) of any size. ``members``: band, key, print."""
    near, far = radius // 2, -(-radius // 2)
    spark = members.sparkSession
    rows = []
    for band, mask in enumerate(masks):
        free = [1 << place for place in range(BITS) if not mask >> place & 1]
        rows.append((band, [(_signed(sum(c)), size <= near) for size in range(far + 1) for c in combinations(free, size)]))
    turns = spark.createDataFrame(rows, "band int, turns array<struct<turn: long, near: boolean>>")  # one row per mask
    turned = members.join(F.broadcast(turns), "band").select("band", "print", F.explode("turns").alias("x"))
    met = turned.select("band", "print", F.col("x.near").alias("near"), F.col("print").bitwiseXOR(F.col("x.turn")).alias("value"))
    # A value decides the bucket, as it keeps the places of the mask.
    least = met.groupBy("band", "value").agg(F.min(F.when(F.col("near"), F.col("print"))).alias("a"), F.min("print").alias("x"), F.max("print").alias("y"))
    return met.join(least.where("a IS NOT NULL AND x < y").select("band", "value", "a"), ["band", "value"]).where("print <> a").select("a", F.col("print").alias("b")).distinct()


def links(nodes: DataFrame, radius: int = RADIUS, listed: int = LISTED) -> DataFrame:
    """(a, b): links within the radius that join the same nodes as all such pairs do. ``nodes``: distinct ``print``."""
    masks = covering(radius)
    bands = F.posexplode(F.array(*[F.lit(_signed(m)).cast("long") for m in masks])).alias("band", "mask")
    rows = nodes.select("print", bands).select("band", F.col("print").bitwiseAND(F.col("mask")).alias("key"), "print")
    sizes = rows.groupBy("band", "key").agg(F.count("*").alias("n"), F.min("print").alias("a"), F.max("print").alias("b"))
    sizes = materialize(sizes.where("n > 2 OR n = 2 AND bit_count(a ^ b) <= " + str(int(radius))))
    small = materialize(sizes.where(f"n BETWEEN 3 AND {int(listed)}").select("band", "key"))
    large = materialize(sizes.where(f"n > {int(listed)}").select("band", "key", "n"))
    lists = rows.join(broadcast_if_small(small, stored=True), ["band", "key"]).groupBy("band", "key").agg(F.collect_list("print").alias("prints")).select("prints")
    found = sizes.where("n = 2").select("a", "b").unionByName(_listed(small_batches(lists), radius))
    if not large.isEmpty():
        found = found.unionByName(_met(rows.join(broadcast_if_small(large.select("band", "key"), stored=True), ["band", "key"]), masks, radius))
    return found


def simhash_groups(docs: DataFrame, n: int = WORDS, radius: int = RADIUS, listed: int = LISTED) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (the smallest doc_id reachable over links, itself included).

    Words are maximal runs without white space, A-Z lower-cased; a text with fewer than ``n`` words is one shingle. Null or empty texts have fingerprint zero and are
    linked like any other. Every row has the component of its own text, also where rows share a doc_id. Rows without a doc_id have a fingerprint, but no component, and link nothing. An
    empty table gives no rows. Only doc_id and text are read.
    """
    own = materialize(fingerprints(docs, n))
    nodes = materialize(own.where("doc_id IS NOT NULL").groupBy("print").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")))
    stars = components(links(nodes.select("print"), radius, listed))  # (node, component), as fingerprints
    joined = materialize(nodes.join(broadcast_if_small(stars.withColumnsRenamed({"node": "print"})), "print", "left").withColumn("component", F.coalesce("component", "print")))
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    # A row whose text no other row shares, in a component of which it is the least, needs no lookup.
    placed = joined.join(least, "component").where("copies > 1 OR component_id <> least").select("print", "component_id")
    found = own.join(broadcast_if_small(placed), "print", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("print")), BITS // 4, "0").alias("fingerprint"), component.alias("component_id"))
