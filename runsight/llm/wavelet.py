"""Token files as wavelet matrices: one compressed file per shard, with access, counting and occurrence lookup.

A shard holds the ids of whole documents in ascending doc_id order. Its ids are stored as bit planes: the plane of the highest bit in token order, then, after moving all ids with a 0
there before those with a 1, the plane of the next bit, and so on. Ranks are counted per 512 bits.

File: the magic ``WVM1``; a header of little-endian 64-bit numbers (tokens, planes, documents); then blocks, each a 64-bit length and zstd-compressed data: document ids,
token counts, and per plane the number of zeros with the bits packed little-endian.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runsight.llm import sharedfiles, tokens
from runsight.llm.batches import gathered, small_batches
from runsight.session import materialize

MAGIC = b"WVM1"
SHARD_TOKENS = 1 << 21
_BLOCK = 512
#: Places that are moved at a time: their numbers stay in the processor's cache.
STRETCH = 1 << 15


def _moves(plane: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray, slice, slice]]:
    """Per stretch of a plane: the stretch, where in it the zeros and the ones are, and where these are on the next level, all zeros before all ones."""
    at_zero, at_one = 0, len(plane) - int(np.count_nonzero(plane))
    for i in range(0, len(plane), STRETCH):
        own = plane[i : i + STRETCH]
        zeros, ones = np.flatnonzero(~own), np.flatnonzero(own)  # places: quicker than masks
        yield slice(i, i + STRETCH), zeros, ones, slice(at_zero, at_zero + len(zeros)), slice(at_one, at_one + len(ones))
        at_zero, at_one = at_zero + len(zeros), at_one + len(ones)


class WaveletMatrix:
    """Ids of one shard; ``planes`` are boolean arrays from the highest bit down, ``zeros`` the number of zeros in each."""

    def __init__(self, planes: list[np.ndarray], doc_ids: np.ndarray, counts: np.ndarray, size: int) -> None:
        self.planes, self.doc_ids, self.counts, self.size = planes, doc_ids, counts, size
        self.zeros = [int(size - np.count_nonzero(p)) for p in planes]
        self._ranks: list[np.ndarray] | None = None

    @classmethod
    def build(cls, ids: np.ndarray, doc_ids: np.ndarray, counts: np.ndarray) -> WaveletMatrix:
        bits = max(1, int(ids.max(initial=0)).bit_length())
        rest, planes = ids.astype(np.uint16 if bits <= 16 else np.uint32), []
        for level in range(bits - 1, -1, -1):
            plane = (rest >> rest.dtype.type(level) & rest.dtype.type(1)).astype(bool)
            planes.append(plane)
            below = np.empty_like(rest)
            for here, zeros, ones, to_zeros, to_ones in _moves(plane):
                below[to_zeros], below[to_ones] = rest[here][zeros], rest[here][ones]
            rest = below
        return cls(planes, np.asarray(doc_ids, "<i8"), np.asarray(counts, "<i8"), len(ids))

    def decode(self) -> np.ndarray:
        """All ids in token order, read from the lowest plane upwards."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        values = np.zeros(self.size, kind)
        for depth, plane in enumerate(reversed(self.planes)):
            above = np.empty_like(values)
            for here, zeros, ones, from_zeros, from_ones in _moves(plane):
                own = above[here]
                own[zeros], own[ones] = values[from_zeros], values[from_ones] | kind(1 << depth)
            values = above
        return values.astype(np.uint32)

    def _rank1(self, level: int, i: int) -> int:
        """Ones of a plane before place ``i``."""
        if self._ranks is None:
            edges = range(0, self.size + _BLOCK, _BLOCK)
            self._ranks = [np.concatenate([[0], np.cumsum(np.add.reduceat(p, np.arange(0, self.size, _BLOCK), dtype=np.int64))]) if self.size else np.zeros(len(edges), int) for p in self.planes]
        start = i // _BLOCK
        return int(self._ranks[level][start]) + int(np.count_nonzero(self.planes[level][start * _BLOCK : i]))

    def _down(self, level: int, i: int, bit: int) -> int:
        ones = self._rank1(level, i)
        return self.zeros[level] + ones if bit else i - ones

    def access(self, i: int) -> int:
        """The id at place ``i``."""
        value = 0
        for level, plane in enumerate(self.planes):
            bit = int(plane[i])
            value, i = value << 1 | bit, self._down(level, i, bit)
        return value

    def _range(self, token: int, start: int, end: int) -> tuple[int, int]:
        for level in range(len(self.planes)):
            bit = token >> len(self.planes) - 1 - level & 1
            start, end = self._down(level, start, bit), self._down(level, end, bit)
        return start, end

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences of an id in places ``start`` to ``end`` (exclusive)."""
        if token >> len(self.planes):
            return 0
        low, high = self._range(token, start, self.size if end is None else end)
        return high - low

    def _select(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) ``bit`` in a plane: a search over block ranks, then within a block."""
        self._rank1(level, 0)
        ranks = self._ranks[level]
        before = ranks if bit else np.minimum(np.arange(len(ranks)) * _BLOCK, self.size) - ranks
        block = int(np.searchsorted(before, k, "right")) - 1
        inside = np.flatnonzero(self.planes[level][block * _BLOCK : (block + 1) * _BLOCK] == bool(bit))
        return block * _BLOCK + int(inside[k - int(before[block])])

    def locate(self, token: int, k: int) -> int:
        """Place of the k-th occurrence (from 0) of an id; IndexError beyond the last."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        place = self._range(token, 0, self.size)[0] + k
        for level in range(len(self.planes) - 1, -1, -1):
            bit = token >> len(self.planes) - 1 - level & 1
            place = self._select(level, bit, place - self.zeros[level] if bit else place)
        return place

    def to_bytes(self) -> bytes:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        blocks = [self.doc_ids.tobytes(), self.counts.tobytes(), *[np.packbits(p, bitorder="little").tobytes() for p in self.planes]]
        out = [MAGIC, np.array([self.size, len(self.planes), len(self.doc_ids)], "<i8").tobytes()]
        for block in map(pack, blocks):
            out += [np.array([len(block)], "<i8").tobytes(), block]
        return b"".join(out)

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        import zstandard

        if data[:4] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        size, levels, _ = (int(x) for x in np.frombuffer(data, "<i8", 3, 4))
        at, blocks, unpack = 28, [], zstandard.ZstdDecompressor().decompress
        for _ in range(levels + 2):
            length = int(np.frombuffer(data, "<i8", 1, at)[0])
            blocks.append(unpack(data[at + 8 : at + 8 + length]))
            at += 8 + length
        planes = [np.unpackbits(np.frombuffer(b, np.uint8), count=size, bitorder="little").view(bool) for b in blocks[2:]]
        return cls(planes, np.frombuffer(blocks[0], "<i8"), np.frombuffer(blocks[1], "<i8"), size)


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end: int, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode all documents in ascending doc_id order into wavelet matrix files below ``folder``.

    Returns one row per file: part and shard (their order), path, n_docs, n_tokens, start (tokens of all files before). Documents are
    cut into ranges of doc_id, so no task sees all of them; a file ends with the document that reaches ``shard_tokens``. Null texts count as empty; rows that share a doc_id follow
    one another; null ids come first and are stored as the least number. An empty table gives no file.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = tokens.encoder(tokenizer, False), TaskContext.get().partitionId()
        done: list[tuple] = []
        held: list[np.ndarray] = []
        names: list[int] = []
        size = 0

        def close() -> None:
            nonlocal size
            matrix = WaveletMatrix.build(np.concatenate(held), np.array(names, "<i8"), np.array([len(x) for x in held], "<i8"))
            done.append((part, len(done), sharedfiles.put(folder, f"{part}-{len(done)}.wvm", matrix.to_bytes()), len(names), size))
            held.clear()
            names.clear()
            size = 0

        for batch in gathered(batches, tokens.BLOCK_BYTES):
            for doc, ids in zip(batch.column(0).to_pylist(), own.encode(batch.column(1), end)):
                held.append(ids)
                names.append(-(2**63) if doc is None else doc)
                size += len(held[-1])
                if size >= shard_tokens:
                    close()
        if names:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["part", "shard", "path", "n_docs", "n_tokens"])

    keyed = small_batches(docs).select("doc_id", "text", F.xxhash64("text").alias("tie"))
    ranges = keyed.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    written = materialize(ranges.mapInArrow(write, "part long, shard long, path string, n_docs long, n_tokens long"))
    by_part = written.groupBy("part").agg(F.sum("n_tokens").alias("all"))  # one row per task
    before = by_part.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_tokens")
    return written.join(before, "part").select("part", "shard", "path", "n_docs", "n_tokens", (F.col("before") + inside).alias("start"))


def read_shards(shards: DataFrame) -> DataFrame:
    """One row per document, read back from the files: doc_id, start, n_tokens, ids_crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                matrix = WaveletMatrix.from_bytes(sharedfiles.get(path))
                ids, ends = matrix.decode(), np.cumsum(matrix.counts)
                crcs = [tokens.crc(ids[e - n : e]) for e, n in zip(ends.tolist(), matrix.counts.tolist())]
                doc = pa.array(matrix.doc_ids, mask=matrix.doc_ids == -(2**63))
                yield pa.RecordBatch.from_arrays([doc, pa.array(start + ends - matrix.counts), pa.array(matrix.counts), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    files = shards.count()
    return shards.select("path", "start").repartition(max(1, min(files, 20_000)), "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def shard_matrix(spark: SparkSession, path: str) -> WaveletMatrix:
    """One shard for lookups."""
    return WaveletMatrix.from_bytes(bytes(spark.read.format("binaryFile").load(path).first()["content"]))
