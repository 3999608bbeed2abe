"""Collocated phrases by prefix-free parsing: texts become a dictionary of overlapping chunks, and n-grams are counted in distinct chunks.

1. Parsing: a text is a row of words. Where the hash of the next words is a multiple of ``PERIOD``, a chunk starts; it ends with the words that start the next one. So
   equal passages give equal chunks, wherever they stand, and every n-gram lies whole in the chunk in which it starts before the overlap: it is counted there and nowhere else.
   Borders of pieces stay in the chunk as line ends, which no n-gram crosses.
2. Dictionary: distinct chunks per language with their frequencies, counted per task before the shuffle. All counting below reads the dictionary alone and weighs by frequency.
3. Counting, one length after the other: n-grams travel as hashes of 96 bits and only if both n-grams of one word less are frequent. Which are is a bitmap of ``MAP_BITS`` bits in a file of the shared
   folder, built in tasks: its size is fixed, and what it lets through by mistake costs time and no result. Two of 10^12 different n-grams share a hash with a probability of 1e-5.
4. Texts: with each hash goes the first chunk that holds it, and only frequent ones are read from there, once each. Scores, the weakest cut, phrases that a longer one covers, and the first of each
   language follow by joins, in whole-number arithmetic of 38 digits.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runsight.llm import sharedfiles
from runsight.llm.batches import small_batches
from runsight.llm.textbytes import _LOWER, Words, blocks, mix
from runsight.plans.sizing import broadcast_if_small
from runsight.session import materialize, shared_dir

LONGEST = 5
LEAST = 100
TOP = 2000
#: Words per chunk on average, without the overlap.
PERIOD = 64
MAP_BITS = 27
#: Hashes that a task holds before it hands them on.
HELD = 1 << 20
#: Words of a chunk at most, without the overlap; only texts that go on without a start have as many.
MOST = 1 << 16
#: What separates pieces, and words within a piece.
_PIECE = np.zeros(256, bool)
_PIECE[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_WORD = ~_PIECE
_WORD[[0x20, 0x09]] = False


def _breaks(words: Words) -> np.ndarray:
    """Whether a piece ends behind each word; the last word of a text ends one."""
    borders = np.concatenate([[0], np.cumsum(_PIECE[words.data])])
    out = np.ones(len(words.start), bool)
    out[:-1] = borders[words.start[1:]] > borders[words.end[:-1]]
    out[words.rows[1:][words.rows[1:] > 0] - 1] = True
    return out


def _grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each word on, as far as there are n."""
    out = mix(hashes)
    for k in range(1, n):
        out = mix(out[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[k:]) if len(out) else out
    return out


def _chunks(words: Words, longest: int, period: int) -> Iterator[tuple[int, bytes, bool, int]]:
    """(text, chunk, whether it is the text's last, words that start before the overlap) of texts worked on together."""
    overlap, breaks = longest - 1, _breaks(words)  # at least one word
    size = words.end - words.start
    after = np.cumsum(size + 1)
    plain = np.full(int(after[-1]) if len(after) else 0, 0x20, np.uint8)
    inside = np.ones(len(plain), bool)
    inside[after - 1] = False
    plain[inside] = _LOWER[words.data[_WORD[words.data]]]
    plain[after[breaks] - 1] = 0x0A
    begin, data = after - size - 1, plain.tobytes()
    starts = np.flatnonzero(_grams(words.hash, overlap) % np.uint64(period) == 0)
    for text in range(len(words)):
        first, last = words.rows[text], words.rows[text + 1]
        if first == last:
            continue
        own = starts[np.searchsorted(starts, first, "right") : np.searchsorted(starts, last - overlap, "right")]
        cuts = [int(first), *own.tolist()]
        if max([last - cuts[-1], *np.diff(cuts)]) > MOST:
            cuts = [c for x, y in zip(cuts, [*cuts[1:], last - overlap + 1]) for c in range(x, max(y, x + 1), MOST)]
        for a, b in zip(cuts, cuts[1:]):
            yield text, data[begin[a] : after[b + overlap - 1] - 1], False, b - a
        yield text, data[begin[cuts[-1]] : after[last - 1] - 1], True, int(last) - cuts[-1]


def dictionary(docs: DataFrame, longest: int = LONGEST, period: int = PERIOD) -> DataFrame:
    """at (a number of its own, once the table is written), lang, chunk, final (whether no overlap follows), own (words that start before the overlap), weight (how often it occurs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for first, words in blocks(batch.column(1), _WORD):
                found: dict[tuple, int] = defaultdict(int)
                for text, *chunk in _chunks(words, longest, period):
                    found[langs[first + text], *chunk] += 1
                if found:
                    columns = [*zip(*found), tuple(found.values())]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["lang", "chunk", "final", "own", "n"])

    kinds = [pa.string(), pa.binary(), pa.bool_(), pa.int64(), pa.int64()]
    named = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    chunks = small_batches(named).mapInArrow(run, "lang string, chunk binary, final boolean, own long, n long")
    counted = chunks.groupBy("lang", "chunk", "final").agg(F.first("own").alias("own"), F.sum("n").alias("weight"))
    return counted.select(F.monotonically_increasing_id().alias("at"), "*")


_maps: dict[str, np.ndarray] = {}


def _in_map(path: str, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash may be among those of a bitmap file, which this worker keeps until it has read seven more."""
    if path not in _maps:
        if len(_maps) >= 8:
            _maps.clear()
        _maps[path] = np.frombuffer(sharedfiles.get(path), "<u8")
    held = _maps[path]
    return held[(hashes >> np.uint64(6)) & np.uint64(len(held) - 1)] >> (hashes & np.uint64(63)) & np.uint64(1) == 1


def _map_file(hashes: DataFrame, bits: int) -> str:
    """File of a bitmap with the lower ``bits`` bits of all ``hashes``. Its words are combined over all tasks; one task gets at most ``2**(bits - 6)`` of them."""
    words = 1 << bits - 6
    at = F.shiftrightunsigned("hash", 6).bitwiseAND(F.lit(words - 1).cast("long"))
    merged = hashes.groupBy(at.alias("place")).agg(F.expr("bit_or(shiftleft(1L, CAST(hash & 63 AS int)))").alias("bits"))
    folder = shared_dir(hashes.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(words, "<i8")
        for batch in batches:
            held[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array([sharedfiles.put(folder, "bitmap", held.tobytes())])], ["path"])

    return materialize(merged.repartition(1).mapInArrow(write, "path string")).first().path


class _Block:
    """Chunks worked on together: words, hashes salted by language, and how far each word's piece goes."""

    def __init__(self, words: Words, salt: np.ndarray, final: np.ndarray, weight: np.ndarray, longest: int) -> None:
        sizes = np.diff(words.rows)
        self.words, self.row = words, np.repeat(np.arange(len(words)), sizes)
        self.hashes = words.hash ^ salt[self.row]
        self.weight = weight[self.row]
        ends = words.data[words.start].astype(np.uint64) << np.uint64(8) | words.data[words.end - 1].astype(np.uint64)
        self.marks = words.hash * np.uint64(0xD6E8FEB86659FD93) + ((words.end - words.start).astype(np.uint64) << np.uint64(16) | ends)  # length and both ends of each word
        at, ends = np.arange(len(self.row)), np.flatnonzero(_breaks(words))
        self.left = (ends[np.searchsorted(ends, at)] - at + 1) if len(at) else at
        self.owned = final[self.row] | (at < words.rows[1:][self.row] - longest + 1)

    def more(self, n: int) -> np.ndarray:
        """32 further bits for the phrases of n words from each word on."""
        return (_grams(self.marks, n) >> np.uint64(32)).astype(np.uint32).view(np.int32)

    def starts(self, n: int) -> np.ndarray:
        """Words at which a phrase of n words starts that belongs to its chunk."""
        return np.flatnonzero(self.owned & (self.left >= n))


def _blocks(batch: pa.RecordBatch, longest: int) -> Iterator[tuple[int, _Block]]:
    """``batch``: lang, chunk, final, weight."""
    langs = batch.column(0).to_pylist()
    salts = {lang: int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little") for lang in set(langs)}
    salt = np.array([salts[lang] for lang in langs], np.uint64)
    final, weight = batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy()
    for first, words in blocks(batch.column(1).cast(pa.string()), _WORD):
        own = slice(first, first + len(words))
        yield first, _Block(words, salt[own], final[own], weight[own], longest)


def _hash_counts(chunks: DataFrame, n: int, shorter: str | None, longest: int) -> DataFrame:
    """hash, more, a (occurrences), at (first chunk) of all phrases of n words, of which both parts of one word less are in the bitmap ``shorter``."""

    def handed(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        hashes, more, weight, at = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(hashes)
        hashes, more = hashes[order], more[order]
        first = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (more[1:] != more[:-1])]))
        columns = [hashes[first].view(np.int64), more[first], np.add.reduceat(weight[order], first), np.minimum.reduceat(at[order], first)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["hash", "more", "a", "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            numbers = batch.column(4).to_numpy()
            for first, block in _blocks(batch, longest):
                at = block.starts(n)
                if shorter is not None and len(at):
                    known = _in_map(shorter, _grams(block.hashes, n - 1))
                    at = at[known[at] & known[at + 1]]
                if len(at):
                    held.append((_grams(block.hashes, n)[at], block.more(n)[at], block.weight[at], numbers[first + block.row[at]]))
                    size += len(at)
                if size >= HELD:
                    yield handed(held)
                    held, size = [], 0
        if size:
            yield handed(held)

    counted = chunks.select("lang", "chunk", "final", "weight", "at").mapInArrow(run, "hash long, more int, a long, at long")
    return counted.groupBy("hash", "more").agg(F.sum("a").alias("a"), F.min("at").alias("at"))


def _texts(often: DataFrame, chunks: DataFrame, longest: int) -> DataFrame:
    """lang, phrase, a of frequent phrases (words, hash, more, a, at), each read from its first chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(4)
            sizes, parts = wanted.value_lengths().to_numpy(), wanted.flatten()
            row, fields = np.repeat(np.arange(len(sizes)), sizes), [parts.field(c).to_numpy() for c in ("words", "hash", "more", "a")]
            langs, out = batch.column(0).to_pylist(), []
            for first, block in _blocks(batch, longest):
                data, inside = block.words.data.tobytes(), (row >= first) & (row < first + len(block.words))
                for n in range(1, longest + 1):
                    own = inside & (fields[0] == n)
                    hash_of, more_of, a_of = (f[own].tolist() for f in fields[1:])
                    left = dict(zip(zip(row[own].tolist(), hash_of, more_of), a_of))
                    at = block.starts(n)
                    hashes, more = _grams(block.hashes, n)[at].view(np.int64), block.more(n)[at]
                    hit = np.flatnonzero(np.isin(hashes, fields[1][own]))
                    rows = first + block.row[at[hit]]
                    for i, *key in zip(at[hit].tolist(), rows.tolist(), hashes[hit].tolist(), more[hit].tolist()):
                        a = left.pop(tuple(key), None)
                        if a is not None:
                            out.append((langs[key[0]], data[block.words.start[i] : block.words.end[i + n - 1]], a))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.binary(), pa.int64()))], ["lang", "phrase", "a"])

    # A chunk has at most as many phrases as words times lengths.
    asked = often.groupBy("at").agg(F.collect_list(F.struct("words", "hash", "more", "a")).alias("wanted"))
    found = chunks.select("at", "lang", "chunk", "final", "weight").join(asked, "at").select("lang", "chunk", "final", "weight", "wanted")
    return small_batches(found).mapInArrow(run, "lang string, phrase binary, a long").withColumn("phrase", F.col("phrase").cast("string"))


def frequent_phrases(chunks: DataFrame, least: int = LEAST, longest: int = LONGEST, bits: int = MAP_BITS) -> DataFrame:
    """lang, phrase (words joined by a space), a: all phrases of 1 to ``longest`` words that occur ``least`` times or more, from a written dictionary."""
    rows, found, shorter = small_batches(chunks), None, None
    for n in range(1, longest + 1):
        often = materialize(_hash_counts(rows, n, shorter, longest).where(F.col("a") >= least).select(F.lit(n).alias("words"), "hash", "more", "a", "at"))
        found = often if found is None else found.unionByName(often)
        if often.isEmpty():
            break
        if n < longest:
            shorter = _map_file(often.select("hash"), bits)
    return materialize(_texts(found, chunks, longest))


def _scored(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, words, a, l, r, n, score of all phrases of two words or more by their weakest cut."""
    words = F.size(F.split("phrase", " ", -1))
    long = phrases.withColumn("words", words).where("words > 1")
    cuts = long.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumns({"left": F.expr("substring_index(phrase, ' ', k)"), "right": F.expr("substring_index(phrase, ' ', k - words)")})
    part = lambda side, count: phrases.select("lang", F.col("phrase").alias(side), F.col("a").alias(count))
    cuts = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"]).join(broadcast_if_small(totals), "lang")
    exact = {c: F.col(c).cast("decimal(18,0)") for c in "anlr"}
    # Counts stay far below 10^17, so that no product reaches 38 digits; both sides are positive, so that dropping the fraction rounds down.
    cuts = cuts.withColumns({"above": (exact["a"] * exact["n"]).cast("decimal(34,0)") * F.lit(1000).cast("decimal(4,0)"), "below": exact["l"] * exact["r"]})
    cuts = cuts.withColumn("score", F.expr("above div below"))
    best = cuts.groupBy("lang", "phrase", "words", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "words", "a", "cut.l", "cut.r", "n", "cut.score")


def _uncovered(scored: DataFrame, share: int) -> DataFrame:
    """``scored`` without phrases that lie in a longer one which has ``share`` per cent of their occurrences."""
    inner = F.expr(
        "flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), i -> array_join(slice(split(phrase, ' ', -1), i, m), ' '))))"
    )
    covers = scored.where("words > 2").select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    return scored.join(covers, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a"))).drop("longer")


def collocations(
    docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, share: int = 100, period: int = PERIOD, bits: int = MAP_BITS
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of each language by score, then count, then text.

    Phrases are 2 to ``longest`` words that stand side by side within a piece ``least`` times or more. Null languages count as ``und``, null texts as empty; a language without such a
    phrase has no row, and an empty table gives none. Repeated rows count as often as they occur; of equal scores and counts the smaller text comes first. Only lang and text are read.
    """
    if longest < 2:
        raise ValueError("phrases have two words at least")
    chunks = materialize(dictionary(docs, longest, period))
    totals = chunks.groupBy("lang").agg(F.sum(F.col("own") * F.col("weight")).alias("n"))
    phrases = frequent_phrases(chunks, least, longest, bits)
    kept = _uncovered(materialize(_scored(phrases, totals)), share)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return kept.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
