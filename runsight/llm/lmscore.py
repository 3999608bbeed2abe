"""Stupid-backoff scores of all documents under the n-gram counts of all other documents.

The corpus is cut into blocks of documents. Order by order, each block explodes its n-grams, and sends them, sorted and counted, to the hash partition they belong to. A partition holds its
share of the count table: it adds the counts of all blocks and joins the table back to each block's n-grams. Only counts travel back, in the order in which the block sent its n-grams;
it finds these again from its text. An n-gram can only occur elsewhere if both n-grams of one word less do, so higher orders send ever fewer. At last each block joins its n-grams
with these counts and sums per document.

Rows hold many n-grams as sorted hashes, differences of which take about five bytes each, and counts take less than one; as single rows they would fill several times the disk of the input. Hashes
are as wide as the corpus needs (``hash_bits``). What an order has shuffled is given up before the next one starts.
Per n-gram there is one entry per block, however often it occurs, so frequent n-grams make no large partition.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runsight.llm import sharedfiles
from runsight.llm.batches import small_batches
from runsight.llm.textbytes import SPACED, Words, mix, slices
from runsight.session import materialize, shared_dir, shuffles_given_up

#: Fixed factor of the method for each order that is backed off.
BACKOFF = 0.4
ORDER = 3
#: Bytes of text per block, and per hash partition of a count table.
BLOCK_TEXT = 8 << 20
PARTITION_TEXT = 16 << 20
OUT = "doc_id long, n_words long, log_score double, n_backed_off long, n_unseen long"


def _pack(values: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted distinct hashes with counts: differences and counts by bytes, compressed."""
    import zstandard

    steps = np.diff(values, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T
    times = counts.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(np.int64(len(values)).tobytes() + steps.tobytes() + times.tobytes())


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    plain = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    n = int(plain[:8].view(np.int64)[0])
    steps = np.ascontiguousarray(plain[8 : 8 + 8 * n].reshape(8, n).T).view("<u8").ravel()
    times = np.ascontiguousarray(plain[8 + 8 * n :].reshape(4, n).T).view("<u4").ravel()
    return np.cumsum(steps, dtype=np.uint64), times.astype(np.int64)


def _pack_counts(counts: np.ndarray) -> bytes:
    """Counts by bytes, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(counts.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpack_counts(data: bytes) -> np.ndarray:
    import zstandard

    plain = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(plain.reshape(8, -1).T).view("<u8").ravel().astype(np.int64)


def _blocked(docs: DataFrame, block_text: int) -> DataFrame:
    """One row per block of documents: block (a number of its own), docs (ids), text (compressed), borders, n_words, n_bytes. Written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        ids: list = []
        held: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal size
            text, borders = b"".join(held), np.cumsum([0, *map(len, held)])
            words = sum(len(w.hash) for w in _words(np.frombuffer(text, np.uint8), borders))
            row = [uuid.uuid4().int >> 65, ids[:], zstandard.ZstdCompressor(level=3).compress(text), borders.tolist(), words, size]
            ids.clear()
            held.clear()
            size = 0
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], ["block", "docs", "text", "borders", "n_words", "n_bytes"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.append((text.as_py() or "").encode())
                ids.append(doc)
                size += len(held[-1])
                if size >= block_text:
                    yield close()
        if ids:
            yield close()

    schema = "block long, docs array<long>, text binary, borders array<long>, n_words long, n_bytes long"
    return materialize(small_batches(docs).select("doc_id", "text").mapInArrow(run, schema))


def _words(data: np.ndarray, borders: np.ndarray) -> Iterator[Words]:
    for first, last in slices(borders):
        yield Words(data[borders[first] : borders[last]], borders[first : last + 1] - borders[first], SPACED)


def hash_bits(n_words: int) -> int:
    """Width at which less than one pair of n-grams of an order is expected to share a hash, 64 at most (beyond 2^31 words some may)."""
    return min(64, 2 * max(1, n_words).bit_length() + 2)


class Block:
    """N-grams of a block: ``grams(k)`` has one more than the hash of the k words that end at each word, 0 where the text has fewer before it."""

    def __init__(self, text: bytes, borders: list[int], bits: int = 63) -> None:
        import zstandard

        data = np.frombuffer(zstandard.ZstdDecompressor().decompress(text) if text else b"", np.uint8)
        parts = [(w.hash, np.diff(w.rows)) for w in _words(data, np.array(borders))]
        sizes = np.concatenate([np.zeros(0, np.int64), *[s for _, s in parts]])
        self.hash = np.concatenate([np.zeros(0, np.uint64), *[h for h, _ in parts]])
        self.rows = np.concatenate([[0], np.cumsum(sizes)])
        self.owner = np.repeat(np.arange(len(sizes)), sizes)
        self.place = np.arange(len(self.hash)) - self.rows[self.owner]
        self.drop = np.uint64(64 - min(bits, 63))

    def grams(self, k: int) -> np.ndarray:
        found = self.hash
        for _ in range(k - 1):
            longer = np.zeros_like(found)
            longer[1:] = mix(found[:-1] * np.uint64(0x9E3779B97F4A7C15) + self.hash[1:])
            found = longer
        found = (found >> self.drop) + np.uint64(1)
        found[self.place < k - 1] = 0
        return found


class Level:
    """Distinct n-grams (``values``) of order k in a block: ``at`` says which ends at each word, ``chosen`` where both shorter n-grams occur in other blocks (``below``, per
    word, is how often the one that ends there does) and ``sent`` which n-grams that holds for; only they can occur elsewhere."""

    def __init__(self, own: Block, k: int, below: np.ndarray | None) -> None:
        self.grams = own.grams(k)
        self.values, self.at, self.times = np.unique(self.grams, return_inverse=True, return_counts=True)
        self.chosen = self.grams != 0
        if below is not None:
            self.chosen &= below > 0
            self.chosen[1:] &= below[:-1] > 0
        self.sent = np.zeros(len(self.values), bool)
        self.sent[self.at[self.chosen]] = True

    def elsewhere(self, counts: np.ndarray) -> np.ndarray:
        """Per word, how often its n-gram occurs in other blocks, given that of the n-grams sent."""
        found = np.zeros(len(self.values), np.int64)
        found[self.sent] = counts
        return np.where(self.chosen, found[self.at], 0)


def _levels(own: Block, folder: str, block: int, order: int) -> Iterator[tuple[Level, np.ndarray]]:
    """Orders 1 to ``order`` of a block, with the counts elsewhere of the n-gram that ends at each word."""
    below = None
    for k in range(1, order + 1):
        level = Level(own, k, below)
        below = level.elsewhere(_unpack_counts(sharedfiles.get(f"{folder}/{k}/{block}")))
        yield level, below


def _counted(table: DataFrame, folder: str, k: int, partitions: int, bits: int) -> None:
    """Count n-grams of order k over all blocks; each block's counts elsewhere become a file of the shared folder."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, text, borders in zip(*[batch.column(c) for c in ("block", "text", "borders")]):
                block, own = block.as_py(), Block(text.as_py(), borders.as_py(), bits)
                below = None
                for _, below in _levels(own, folder, block, k - 1):
                    pass
                level = Level(own, k, below)
                values, times = level.values[level.sent], np.bincount(level.at[level.chosen], minlength=len(level.values))[level.sent]
                cuts = np.searchsorted(values, [np.uint64((p << min(bits, 63)) // partitions) for p in range(1, partitions)])
                rows = [(p, v, t) for p, (v, t) in enumerate(zip(np.split(values, cuts), np.split(times, cuts))) if len(v)]
                # A row without n-grams for each block, so that each gets a file.
                rows.append((block % partitions, values[:0], times[:0]))
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _, _ in rows]), pa.array([block] * len(rows)), pa.array([_pack(v, t) for _, v, t in rows], pa.binary())], ["partition", "block", "grams"])

    def join(rows: pa.Table) -> pa.Table:
        names = rows["block"].to_numpy()
        parts = [_unpack(g.as_py()) for g in rows["grams"]]
        keys, counts = np.concatenate([v for v, _ in parts]), np.concatenate([c for _, c in parts])
        order = np.argsort(keys, kind="stable")
        first = np.flatnonzero(np.diff(keys[order], prepend=np.uint64(0)) != 0) if len(keys) else np.zeros(0, int)
        table, totals = keys[order][first], np.add.reduceat(counts[order], first) if len(first) else np.zeros(0, np.int64)
        out = [_pack_counts(totals[np.searchsorted(table, values)] - times if len(values) else times) for values, times in parts]
        return pa.table([rows["partition"], pa.array(names), pa.array(out, pa.binary())], ["partition", "block", "counts"])

    def gather(rows: pa.Table) -> pa.Table:
        # Partitions are ranges of hashes, so that this is the order of the block's own n-grams.
        parts = [_unpack_counts(rows["counts"][i].as_py()) for i in np.argsort(rows["partition"].to_numpy(), kind="stable").tolist()]
        block = rows["block"][0].as_py()
        return pa.table([pa.array([block]), pa.array([sharedfiles.place(f"{folder}/{k}", str(block), _pack_counts(np.concatenate(parts)))])], ["block", "path"])

    sent = table.select("block", "text", "borders").mapInArrow(explode, "partition long, block long, grams binary")
    back = sent.groupBy("partition").applyInArrow(join, "partition long, block long, counts binary")
    materialize(back.groupBy("block").applyInArrow(gather, "block long, path string"))


def _scores(block: Block, levels: Iterable[tuple[Level, np.ndarray]], total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per word: log of its score, the order used (0: unseen) and the longest it could have, given the orders with their counts in other blocks, and the number of words in all documents."""
    owner = block.owner
    others = total - np.diff(block.rows)[owner]  # words of all other documents
    counts: list[np.ndarray] = []
    for level, elsewhere in levels:
        _, own, repeated = np.unique(level.at * np.int64(len(block.rows)) + owner, return_inverse=True, return_counts=True)
        counts.append(np.where(level.grams != 0, level.times[level.at] - repeated[own] + elsewhere, 0))
    order = len(counts)
    log, used = np.full(len(owner), np.nan), np.zeros(len(owner), np.int64)
    most = np.minimum(block.place + 1, order)
    for k in range(order, 0, -1):
        ready = np.isnan(log) & (counts[k - 1] > 0)
        below = others if k == 1 else np.concatenate([[0], counts[k - 2][:-1]])
        # A context counts at least as often as what follows it.
        log[ready] = np.log(counts[k - 1][ready] / below[ready]) + (most[ready] - k) * np.log(BACKOFF)
        used[ready] = k
    unseen = np.isnan(log)
    log[unseen] = most[unseen] * np.log(BACKOFF) - np.log(others[unseen] + 1.0)
    return log, used, most


def lm_scores(docs: DataFrame, order: int = ORDER, block_text: int = BLOCK_TEXT, partition_text: int = PARTITION_TEXT) -> DataFrame:
    """doc_id, n_words, log_score (natural log, summed over the words), n_backed_off (words scored below the longest context they have), n_unseen.

    A word's score is the count of the longest n-gram that ends with it and occurs in another document, divided by that of its context, times 0.4 per order left out. The counts leave the
    document itself out. A word that occurs nowhere else scores one in (words of all other documents + 1), backed off once more. Words are maximal runs
    without white space, A-Z lower-cased. Null and empty texts have no words and score 0; rows that share a doc_id are documents of their own, and copies support each other; an empty
    table gives no rows. Only doc_id and text are read.
    """
    table = _blocked(docs, block_text)
    size, total = table.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    partitions = max(4, -(-int(size) // partition_text))
    folder = f"{shared_dir(docs.sparkSession)}/{uuid.uuid4().hex}"
    bits = hash_bits(int(total))
    with shuffles_given_up(docs.sparkSession):
        for k in range(1, order + 1):
            _counted(table, folder, k, partitions, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, ids, text, borders in zip(*[batch.column(c) for c in ("block", "docs", "text", "borders")]):
                own = Block(text.as_py(), borders.as_py(), bits)
                log, used, most = _scores(own, _levels(own, folder, block.as_py(), order), total)
                n = len(own.rows) - 1
                sums = np.bincount(own.owner, log, n), np.bincount(own.owner, used < most, n), np.bincount(own.owner, used == 0, n)
                columns = [ids.values, pa.array(np.diff(own.rows)), pa.array(sums[0].astype(float)), *[pa.array(s.astype(np.int64)) for s in sums[1:]]]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in OUT.split(", ")])

    return table.select("block", "docs", "text", "borders").mapInArrow(run, OUT)
