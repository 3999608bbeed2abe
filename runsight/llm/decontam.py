"""Benchmark decontamination: every passage of the training text is a query against a BM25 index of the test items.

1. Items are cut into segments of at most ``SEGMENT`` words, the documents of the index; their questions are cut again on their own, so that a text with the question alone is found too.
   A segment's term weights are divided by its own score, so that 1.0 means that a passage holds all its terms. Statistics are over all items.
2. Segments are put in order and into blocks; each term keeps its largest weight per block. Texts are cut into passages of two segments' length, one segment apart, so that every
   copied segment lies whole in a passage.
3. Block-max WAND, a set at a time: sums of the terms' largest weights bound the scores of all passages of a batch; passages that reach the threshold get the sums of block maxima, and
   only blocks whose bound reaches it are opened. All postings of other blocks are skipped; those of opened blocks are added up in full.
4. All segments above the threshold are verified: the share of the item's five-word shingles found in the whole text, for its question (all but the last line, or
   the last sentence of a single line), for its answer, and for both together.

Large benchmarks are split by item into index shards of bounded size, and texts are run against one after the other.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runsight.llm.batches import small_batches
from runsight.llm.textbytes import LETTERS, Words, blocks
from runsight.session import materialize

SEGMENT = 64
SHINGLE = 5
THRESHOLD = 0.5
OVERLAP = 0.8
K1, B = 1.2, 0.75
#: Bytes of benchmark text per index shard; an index takes a few times that in each worker.
SHARD_BYTES = 4 << 20
#: Cells of the table of block maxima (terms times blocks), which sets how many segments share a block.
BOUNDS = 1 << 20
OUT = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, overlap double, passages long"


def question_and_answer(text: str) -> tuple[str, str]:
    """The last line is the answer; a single line is cut before its last sentence. An item of one sentence has no answer."""
    lines = [x for x in text.split("\n") if x.strip()]
    if len(lines) > 1:
        return "\n".join(lines[:-1]), lines[-1]
    sentences = re.split(r"(?<=[.?!])\s+", text.strip())
    return (" ".join(sentences[:-1]), sentences[-1]) if len(sentences) > 1 else (text, "")


def _words(text: str) -> Words:
    return next(blocks(pa.array([text]), LETTERS))[1]


def _part(text: str) -> tuple[int, np.ndarray]:
    """Words per shingle (fewer than usual if the text has fewer) and the sorted distinct shingles."""
    words = _words(text)
    n = min(SHINGLE, len(words.hash))
    return n, np.unique(words.shingles(n)[0]) if n else np.zeros(0, np.uint64)


class Index:
    """Index of some items; ``df``, ``segments`` and ``mean`` are over all items."""

    def __init__(self, items: list[tuple[int, str]], df: dict[int, int], segments: int, mean: float) -> None:
        self.ids: list[int] = []  # item of each segment
        self.shingles: dict[int, list[tuple[int, np.ndarray]]] = {}
        rows: list[dict[int, float]] = []
        for item, text in sorted(items):
            question, answer = question_and_answer(text)
            self.shingles[item] = [_part(t) for t in (question, answer, text)]
            own, asked = _words(text).hash, _words(question).hash
            for part in cut(own) + (cut(asked) if len(asked) < len(own) else []):
                terms, times = np.unique(part, return_counts=True)
                often = [df.get(int(t), 0) for t in terms]  # a question cut at rare white space may hold a word of its own
                idf = np.array([math.log1p((segments - n + 0.5) / (n + 0.5)) for n in often])
                weights = idf * times * (K1 + 1) / (times + K1 * (1 - B + B * len(part) / mean))
                self.ids.append(item)
                rows.append(dict(zip(terms.tolist(), (weights / weights.sum()).tolist())))
        self.vocabulary = np.unique(np.array([t for r in rows for t in r], np.uint64))
        self.block = max(1, -(-len(rows) * max(1, len(self.vocabulary)) // BOUNDS))
        terms = np.searchsorted(self.vocabulary, np.array([t for r in rows for t in r], np.uint64))
        segments_of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        order = np.lexsort((segments_of, terms))
        self.segments = segments_of[order]
        self.weights = np.array([w for r in rows for w in r.values()])[order]
        self.lists = np.searchsorted(terms[order], np.arange(len(self.vocabulary) + 1))
        self.maxima = np.zeros((len(self.vocabulary) + 1, -(-len(rows) // self.block)), np.float32)
        np.maximum.at(self.maxima, (terms[order], self.segments // self.block), self.weights * (1 + 1e-6))
        self.largest = self.maxima.max(axis=1, initial=0)

    def terms(self, hashes: np.ndarray) -> np.ndarray:
        """Term numbers of words; words of no item get the number of the empty last row."""
        k = np.searchsorted(self.vocabulary, hashes)
        k[k == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[k] == hashes, k, len(self.vocabulary))

    def open_passages(self, terms: np.ndarray, chunk: np.ndarray, passages: np.ndarray, threshold: float) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(passage, its terms, its blocks whose bound reaches the threshold). ``chunk``: number of each word's chunk, ascending; a passage is one row of
        (first chunk, last chunk), neighbours or the same.

        Terms count once per chunk. A term in both chunks of a passage counts twice, which only raises bounds. The largest weight in any block rules out most
        passages before block maxima are looked at.
        """
        known = terms < len(self.vocabulary)
        pairs = np.unique(chunk[known] * np.int64(len(self.vocabulary)) + terms[known])
        chunk, terms = pairs // len(self.vocabulary), pairs % len(self.vocabulary)
        first, last = passages.T
        n = int(last.max(initial=-1)) + 1
        sums = np.bincount(chunk, self.largest[terms], n)
        two = first < last
        left = np.flatnonzero(sums[first] + np.where(two, sums[last], 0) >= threshold - 1e-9)
        borders = np.searchsorted(chunk, np.arange(n + 1))
        out = []
        for p in left:
            own = terms[borders[first[p]] : borders[last[p] + 1]]
            opened = np.flatnonzero(self.maxima[own].sum(axis=0, dtype=np.float64) >= threshold - 1e-9)
            if len(opened):
                out.append((int(p), own, opened))
        return out

    def search(self, own: np.ndarray, opened: np.ndarray, threshold: float) -> list[tuple[int, float]]:
        """Segments of the opened blocks that score at least ``threshold`` for distinct terms, with their scores. Postings of all other blocks are skipped."""
        own = np.unique(own)
        counts = self.lists[own + 1] - self.lists[own]
        at = np.arange(counts.sum()) + np.repeat(self.lists[own] - (np.cumsum(counts) - counts), counts)
        inside = np.zeros(self.maxima.shape[1], bool)
        inside[opened] = True
        at = at[inside[self.segments[at] // self.block]]
        scores = np.bincount(self.segments[at], self.weights[at], len(self.ids))
        return [(int(k), float(scores[k])) for k in np.flatnonzero(scores >= threshold - 1e-9)]

    def leaks(self, words: Words, threshold: float, overlap: float) -> Iterator[tuple]:
        """(text number, item, best score, question, answer and whole overlap, passages) of verified items."""
        if not len(self.ids) or not len(words.hash):
            return
        terms = self.terms(words.hash)
        sizes = np.diff(words.rows)
        chunks = -(-sizes // SEGMENT)
        begin = np.cumsum(chunks) - chunks
        text = np.repeat(np.arange(len(words)), sizes)
        chunk = begin[text] + (np.arange(len(terms)) - words.rows[text]) // SEGMENT
        counts = np.where(chunks == 0, 0, np.maximum(chunks - 1, 1))
        owner = np.repeat(np.arange(len(words)), counts)
        first = begin[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        passages_of = np.stack([first, np.minimum(first + 1, begin[owner] + chunks[owner] - 1)], axis=1)
        hits: dict[tuple[int, int], list] = {}
        for p, own, opened in self.open_passages(terms, chunk, passages_of, threshold):
            for segment, score in self.search(own, opened, threshold):
                hit = hits.setdefault((int(owner[p]), self.ids[segment]), [0.0, set()])
                hit[0] = max(hit[0], score)
                hit[1].add(p)
        if not hits:
            return
        there: dict[tuple[int, int], np.ndarray] = {}

        def share(text: int, n: int, own: np.ndarray) -> float:
            if not n:
                return 0.0
            if (text, n) not in there:
                there[text, n] = np.unique(words.part(text).shingles(n)[0])
            return len(np.intersect1d(own, there[text, n], assume_unique=True)) / len(own)

        for (text, item), (score, passages) in sorted(hits.items()):
            question, answer, whole = (share(text, *own) for own in self.shingles[item])
            if whole >= overlap or question >= overlap:
                yield text, item, score, question, answer, whole, len(passages)


def cut(words: np.ndarray) -> list[np.ndarray]:
    """Segments of nearly equal length, at most ``SEGMENT`` words each."""
    return [x for x in np.array_split(words, max(1, -(-len(words) // SEGMENT))) if len(x)]


def indexes(items: DataFrame) -> list[Index]:
    """Index shards of a benchmark. Null texts count as empty, empty ones and null ids are left out, of rows with the same item_id one with the largest text hash stands.

    Each shard is built from a bounded part of the items; document frequencies come from a table over all of them.
    """

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, words in blocks(batch.column(0), LETTERS):
                parts = [c for i in range(len(words)) for c in cut(words.hash[words.rows[i] : words.rows[i + 1]])]
                if parts:
                    sets = [np.unique(p) for p in parts]
                    size = np.repeat([len(p) / len(s) for p, s in zip(parts, sets)], [len(s) for s in sets])
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64)), pa.array(size), pa.array(np.repeat([1.0 / len(s) for s in sets], [len(s) for s in sets]))], ["term", "words", "segments"])

    one = items.where("item_id IS NOT NULL AND text IS NOT NULL").groupBy("item_id").agg(F.max_by("text", F.xxhash64("text")).alias("text"))
    one = materialize(one)
    size, = one.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    shards = -(-int(size) // SHARD_BYTES)
    terms = materialize(one.select("text").mapInArrow(explode, "term long, words double, segments double").groupBy("term").agg(F.count("*").alias("df"), F.sum("words").alias("words"), F.sum("segments").alias("segments")))
    words, segments = terms.agg(F.sum("words"), F.sum("segments")).first()
    if not words:
        return []
    placed = one.withColumn("shard", F.pmod(F.xxhash64("item_id"), F.lit(shards)))
    out = []
    for k in range(shards):
        part = placed.where(F.col("shard") == k).select("item_id", "text")
        own = part.select("text").mapInArrow(explode, "term long, words double, segments double").select("term").distinct()
        df = {r["term"] % (1 << 64): r["df"] for r in terms.join(own, "term").select("term", "df").toLocalIterator()}
        out.append(Index([tuple(r) for r in part.toLocalIterator()], df, round(segments), words / segments))
    return out


def _run(index: Index, batch: pa.RecordBatch, texts: pa.Array, threshold: float, overlap: float) -> Iterator[tuple]:
    for first, words in blocks(texts, LETTERS):
        for text, *found in index.leaks(words, threshold, overlap):
            yield first + text, *found


def leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """One row per document and leaked item: doc_id, item_id, score (best passage, 1.0 for all terms of a segment), question_overlap, answer_overlap, overlap,
    passages (those that reach the threshold for any segment).

    Null and empty texts leak nothing; rows that share a doc_id are searched one by one; an empty table or benchmark gives no rows. Texts are read where
    they lie, without a shuffle; only doc_id and text are read.
    """

    def against(index: Index) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = list(_run(index, batch, batch.column(1), threshold, overlap))
                if rows:
                    at, *columns = zip(*rows)
                    names = [c.split()[0] for c in OUT.split(", ")]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *[pa.array(c) for c in columns]], names)

        return small_batches(docs).select("doc_id", "text").mapInArrow(run, OUT)

    parts = [against(index) for index in indexes(items)]
    return reduce(DataFrame.unionByName, parts) if parts else docs.sparkSession.createDataFrame([], OUT)


def clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """``docs`` without the rows that hold a leaked item; all columns stay. Cases as in ``leaks``."""
    kept = small_batches(docs)
    for index in indexes(items):

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bad = np.zeros(batch.num_rows, bool)
                for text, *_ in _run(index, batch, batch.column(batch.schema.get_field_index("text")), threshold, overlap):
                    bad[text] = True
                yield batch.filter(pa.array(~bad))

        kept = kept.mapInArrow(run, kept.schema)
    return kept
