"""Words of many texts at once, as numbers: hashes, places and shingles computed over the bytes of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on together; a longer text is a block of its own.
BLOCK_BYTES = 1 << 21
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Words are runs of bytes other than space and tab to carriage return ...
SPACED = np.ones(256, bool)
SPACED[[32, *range(9, 14)]] = False
#: ... or runs of ASCII letters, digits and all bytes beyond ASCII.
LETTERS = np.zeros(256, bool)
LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed one-to-one scrambling of 64-bit numbers."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 1 << 16)
        _powers, _inverses = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
        _powers[0] = _inverses[0] = 1
        np.multiply.accumulate(_powers, out=_powers)
        np.multiply.accumulate(_inverses, out=_inverses)
    return _powers, _inverses


class Words:
    """Words of texts ``first`` to ``last`` of an Arrow column: ``hash`` per word (of its bytes, A-Z lower-cased), byte places ``start`` and ``end`` within
    ``data``, and ``rows``: words ``rows[i]`` to ``rows[i + 1]`` are those of the i-th text. ``bytes`` has the texts' borders in ``data``."""

    def __init__(self, data: np.ndarray, borders: np.ndarray, word: np.ndarray) -> None:
        self.data, self.bytes = data, borders
        inside = word[data]
        edge = np.empty(len(data) + 1, bool)
        edge[0] = edge[-1] = True
        np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
        edge[borders] = True
        places = np.flatnonzero(edge)
        runs = inside[places[:-1]] if len(data) else np.zeros(0, bool)
        self.start, self.end = places[:-1][runs], places[1:][runs]
        powers, inverses = _tables(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.start]) * inverses[self.start])
        self.rows = np.searchsorted(self.start, borders)

    def __len__(self) -> int:
        return len(self.rows) - 1

    def part(self, i: int) -> Words:
        """The words of the i-th text alone; byte places stay those of the block."""
        one = object.__new__(Words)
        own = slice(self.rows[i], self.rows[i + 1])
        one.data, one.bytes, one.hash, one.start, one.end = self.data, self.bytes[i : i + 2], self.hash[own], self.start[own], self.end[own]
        one.rows = np.array([0, len(one.hash)])
        return one

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the n words from each word on, and the borders of the texts; a text with fewer words, but some, has one shingle of all its words."""
        sizes = np.diff(self.rows)
        counts = np.where(sizes == 0, 0, np.maximum(sizes - n + 1, 1))
        borders = np.concatenate([[0], np.cumsum(counts)])
        at = np.arange(borders[-1]) - np.repeat(borders[:-1] - self.rows[:-1], counts)
        total = np.zeros(len(at), np.uint64)
        left = np.repeat(self.rows[1:], counts) - at
        for k in range(n):
            own = self.hash[np.minimum(at + k, max(len(self.hash) - 1, 0))] if len(self.hash) else total
            total = mix(total + np.where(left > k, own, np.uint64(0)) + np.uint64(k + 1))
        return total, borders


def slices(borders: np.ndarray, size: int | None = None) -> Iterator[tuple[int, int]]:
    """(first, last) of stretches of texts that have about ``size`` bytes together (``BLOCK_BYTES`` if None), given their borders."""
    size = BLOCK_BYTES if size is None else size
    first = 0
    while first < len(borders) - 1:
        last = max(first + 1, int(np.searchsorted(borders, borders[first] + size, "right")) - 1)
        yield first, last
        first = last


def blocks(texts: pa.Array, word: np.ndarray = SPACED) -> Iterator[tuple[int, Words]]:
    """Words of all texts of a column (null as empty) in blocks of about ``BLOCK_BYTES``: (number of the first text, words)."""
    texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return
    texts = texts.cast(pa.large_string())
    borders = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    for first, last in slices(borders):
        yield first, Words(data[borders[first] : borders[last]], borders[first : last + 1] - borders[first], word)
