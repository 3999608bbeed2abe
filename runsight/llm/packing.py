"""Packing by lexical retrieval: sequences of fixed length in which related documents follow one another.

1. Every text is tokenised once. A document's key is the least hash of its token pairs, so that documents that share much text tend to share the key.
2. Document frequencies of all tokens and the mean length are counted over all documents; there is one number per id of the vocabulary.
3. Documents are laid out in ranges of (key, doc_id): copies lie together, and no key, however frequent, needs one task. Each range is cut into shards of about ``SHARD_TOKENS``.
4. A document's full windows are sequences of their own; what remains is a unit. Each shard gets a BM25 inverted index of its units. The first unused unit
   is a seed; the index returns its unused neighbours, best first, and they fill the window. The one that no longer fits is cut, and its rest seeds the next window. A shard's
   open window goes on in the next shard.
5. Only the last window of a range may stay open. It is cut into sequences whose lengths are powers of two, so that nothing is padded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runsight.llm import tokens
from runsight.llm.batches import gathered, small_batches
from runsight.session import materialize

LENGTH = 2048
SHARD_TOKENS = 1 << 20
QUERY_TERMS = 32
K1, B = 1.2, 0.75
#: Ids are below this; the tables of document frequencies have so many entries.
VOCABULARY = 1 << 16
OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenised(docs: DataFrame, tokenizer: str, end: int, remembered: int | None = None) -> DataFrame:
    """doc_id, key and ids (little-endian unsigned 16-bit) of every document, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokens.encoder(tokenizer, True, remembered)
        for batch in gathered(batches, tokens.BLOCK_BYTES):
            keys, out = [], []
            for ids in own.encode(batch.column(1), end):
                ids = ids.astype("<u2")
                pairs = (ids[:-1].astype(np.uint64) << np.uint64(16) | ids[1:]) * np.uint64(0x9E3779B97F4A7C15)
                pairs ^= pairs >> np.uint64(29)
                keys.append(int((pairs * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(1)).min()) if len(pairs) else 0)
                out.append(ids.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.int64()), pa.array(out, pa.binary())], ["doc_id", "key", "ids"])

    return materialize(small_batches(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, key long, ids binary"))


def statistics(tokenised: DataFrame) -> tuple[np.ndarray, float]:
    """BM25 weight of each id of the vocabulary, and the mean number of ids, over all documents. Each task sends a count per id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, docs, total = np.zeros(VOCABULARY, np.int64), 0, 0
        for batch in batches:
            for ids in batch.column(0):
                ids = np.frombuffer(ids.as_py(), "<u2")
                found[ids] += 1  # numpy adds one per place, however often it is named
                docs, total = docs + 1, total + len(ids)
        seen = np.flatnonzero(found)
        names = np.concatenate([[-1, -2], seen])
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.concatenate([[docs, total], found[seen]]))], ["name", "n"])

    rows = tokenised.select("ids").mapInArrow(run, "name long, n long").groupBy("name").agg(F.sum("n").alias("n")).toPandas()
    counts = dict(zip(rows["name"], rows["n"]))
    docs, total = counts.pop(-1, 0), counts.pop(-2, 0)
    df = np.zeros(VOCABULARY)
    df[list(counts)] = list(counts.values())
    return np.log1p((docs - df + 0.5) / (df + 0.5)).astype(np.float32), total / max(1, docs)


class Index:
    """BM25 inverted index of a shard's units (arrays of ids)."""

    def __init__(self, units: list[np.ndarray], idf: np.ndarray, mean: float) -> None:
        lengths = np.array([len(u) for u in units])
        ids = np.concatenate(units).astype(np.uint16)
        order = np.argsort(ids, kind="stable")  # of 16 bits, which numpy sorts by digits; units stay in order
        term, unit = ids[order], np.repeat(np.arange(len(units), dtype=np.int64), lengths)[order]
        first = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (unit[1:] != unit[:-1])]))
        times = np.diff(np.append(first, len(ids)))
        term, self.posting_unit = term[first].astype(np.int64), unit[first]
        norm = K1 * (1 - B + B * lengths / mean)
        self.posting_weight = (idf[term] * times * (K1 + 1) / (times + norm[self.posting_unit])).astype(np.float32)
        self.lists = np.searchsorted(term, np.arange(VOCABULARY + 1))
        by_unit = np.argsort(self.posting_unit.astype(np.uint16) if len(units) <= 1 << 16 else self.posting_unit, kind="stable")
        self.term, self.weight = term[by_unit], self.posting_weight[by_unit]
        self.rows = np.concatenate([[0], np.cumsum(np.bincount(self.posting_unit, minlength=len(units)))])
        self.free = np.ones(len(units), bool)

    def neighbours(self, seed: int) -> Iterator[int]:
        """Free units that share one of the seed's heaviest terms, best first."""
        own = slice(self.rows[seed], self.rows[seed + 1])
        terms, weights = self.term[own], self.weight[own]
        if len(terms) > QUERY_TERMS:
            terms = terms[np.argpartition(-weights, QUERY_TERMS)[:QUERY_TERMS]]
        spans = [slice(self.lists[t], self.lists[t + 1]) for t in terms]
        scores = np.bincount(np.concatenate([self.posting_unit[s] for s in spans]), np.concatenate([self.posting_weight[s] for s in spans]), len(self.free))
        scores[~self.free] = 0
        found = np.flatnonzero(scores)
        yield from found[np.lexsort((found, -scores[found]))]


class Packer:
    """Sequences of one range of documents. ``out`` holds rows of doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""

    def __init__(self, part: int, idf: np.ndarray, mean: float) -> None:
        self.sequence, self.idf, self.mean = part << 40, idf, mean
        self.window: list[tuple] = []  # (doc_id, ids of the document, start, length)
        self.filled = 0
        self.out: list[tuple] = []

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, ids, start, length in pieces:
            self.out.append((doc, start, length, tokens.crc(ids[start : start + length]), len(ids), self.sequence, offset))
            offset += length
        self.sequence += 1

    def _add(self, doc: int | None, ids: np.ndarray, start: int) -> bool:
        """Append ids from ``start`` on, closing each window that they fill; whether one was closed."""
        closed = False
        while start < len(ids):
            taken = min(len(ids) - start, LENGTH - self.filled)
            self.window.append((doc, ids, start, taken))
            self.filled += taken
            start += taken
            if self.filled == LENGTH:
                self._emit(self.window)
                self.window, self.filled, closed = [], 0, True
        return closed

    def whole_windows(self, doc: int | None, ids: np.ndarray) -> int:
        """Full windows of a long document; where its unit starts."""
        end = len(ids) // LENGTH * LENGTH
        for start in range(0, end, LENGTH):
            self._emit([(doc, ids, start, LENGTH)])
        return end

    def shard(self, units: list[tuple]) -> None:
        """Pack units (doc_id, ids, start): a seed, then its neighbours until the window is full; the rest of the last one is the next seed."""
        index = Index([ids[start:] for _, ids, start in units], self.idf, self.mean)
        following, seed = iter(range(len(units))), None
        while True:
            if seed is None:
                seed = next((u for u in following if index.free[u]), None)
                if seed is None:
                    return
                index.free[seed] = False
                self._add(*units[seed])
            near = index.neighbours(seed) if self.filled else ()
            seed = None
            for u in near:
                index.free[u] = False
                if self._add(*units[u]):
                    seed = u if self.filled else None
                    break

    def finish(self) -> None:
        """Cut the open window into sequences whose lengths are powers of two."""
        rest, self.window = self.window, []
        for power in range(LENGTH.bit_length() - 1, -1, -1):
            size = self.filled & 1 << power
            pieces: list[tuple] = []
            while size:
                doc, ids, start, length = rest.pop(0)
                taken = min(size, length)
                pieces.append((doc, ids, start, taken))
                if taken < length:
                    rest.insert(0, (doc, ids, start + taken, length - taken))
                size -= taken
            if pieces:
                self._emit(pieces)
        self.filled = 0


def pack(docs: DataFrame, tokenizer: str, end: int, shard_tokens: int = SHARD_TOKENS, remembered: int | None = None) -> DataFrame:
    """Pieces of all documents in sequences of ``LENGTH`` ids: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts hold the end id alone. Rows that share a doc_id, and copies, are packed one by one; a null doc_id stays null. Ties in the search go to the unit that comes first.
    An empty table gives no rows. Only doc_id and text are read. ``remembered``: words that a worker's encoder remembers, where they are to be fewer than it would.
    """
    written = tokenised(docs, tokenizer, end, remembered)
    idf, mean = statistics(written)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(TaskContext.get().partitionId(), idf, mean)

        def flush() -> pa.RecordBatch:
            rows, packer.out = packer.out, []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], [c.split()[0] for c in OUT.split(", ")])

        units: list[tuple] = []
        size = 0
        for batch in batches:
            for doc, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.frombuffer(packed.as_py(), "<u2")
                start = packer.whole_windows(doc, ids)
                if start < len(ids):
                    units.append((doc, ids, start))
                    size += len(ids) - start
                if size >= shard_tokens:
                    packer.shard(units)
                    units, size = [], 0
                if len(packer.out) >= 10_000:
                    yield flush()
        if units:
            packer.shard(units)
        packer.finish()
        if packer.out:
            yield flush()

    ranges = written.repartitionByRange("key", "doc_id").sortWithinPartitions("key", "doc_id").select("doc_id", "ids")
    return ranges.mapInArrow(run, OUT)
