"""Token ids of whole texts by a public tokenizer, with the ids of repeated pieces remembered per worker.

Both tokenizers here never join characters across a space that follows a character that is not white space: the ids of a text are the ids of its pieces, cut there, one
after the other. Natural text repeats its words: each different word of a block of texts is looked up once, and most are found in the memory. A new word of Latin letters, digits,
punctuation and single line ends goes straight to the tokenizer's merge model, as its pre-tokens are known; any other new one takes the whole tokenizer.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from runsight.llm.textbytes import slices

#: Words, and at most so many parts of them, remembered per worker. Words are in two generations: a full one becomes the older, which is dropped with the next. That changes no result.
REMEMBERED, PARTS = 1_000_000, 400_000
#: Bytes of text whose different words are looked up together, and of those whose ids are put together at once.
BLOCK_BYTES, STRETCH_BYTES = 1 << 22, 1 << 18
_CUT = re.compile(r"(?<=\S)(?= )")
#: Remembered for words that have no ids. With byte-level vocabularies they are empty or end in white space, and the space behind them is not a border.
_NONE = b""
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Apostrophes may start a contraction and are left out.
_MARKS = r"!\"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~"
_REGULAR = frozenset(c for c in map(chr, range(256)) if re.match(rf"[{_LETTERS}0-9{_MARKS}]", c))
#: Pre-tokens: runs of letters, digits or marks, each with the space before it, and line ends between them; last what only the whole tokenizer can tell.
_OTHER = rf"(?<=[^ \n])\n(?=[^ \n])| ?[^{_LETTERS}0-9{_MARKS} ]+"
_PARTS = re.compile(rf" ?[{_LETTERS}]+| ?[0-9]+| ?[{_MARKS}]+|{_OTHER}")
#: With word ends, spaces and line ends only separate, and every digit stands alone.
_WORD_PARTS = re.compile(rf" ?[{_LETTERS}]+| ?[0-9]| ?[{_MARKS}]+|{_OTHER}")
#: Line ends that are not between two such runs.
_LINE_ENDS = re.compile(r"^ ?\n|\n\n|\n$")
#: Byte-level vocabularies write bytes as printable characters: printable Latin-1 stands for itself, all others follow from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = dict(zip([b for b in range(256) if b not in _PRINTABLE], range(256, 512)))
_SPACE = chr(_BYTE_CHARS[32])


def _borders(texts: pa.Array) -> np.ndarray:
    """Byte places between texts that follow one another."""
    return np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy())])


class Encoder:
    """``path``: tokenizer file. ``word_ends``: its words are lower-cased and spaces get no ids.

    Strings of special tokens become these tokens, as they do for the library; with ``plain_marks`` they count as ordinary text. A text that may hold one goes through the library as a whole.
    """

    def __init__(self, path: str, word_ends: bool, plain_marks: bool = False, remembered: int | None = None) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_marks
        self.marks = [] if plain_marks else sorted({t.content[:2] for t in self.tokenizer.get_added_tokens_decoder().values()})
        self.model = self.tokenizer.model
        self.word_ends = word_ends
        self.remembered = REMEMBERED if remembered is None else remembered
        self.cut = (_WORD_PARTS if word_ends else _PARTS).findall
        self.known: dict[str, bytes] = {}  # by the word without the space before it
        self.older: dict[str, bytes] = {}
        self.parts: dict[str, bytes | None] = {}

    def _library(self, piece: str) -> bytes:
        return array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()

    def _part(self, part: str) -> bytes | None:
        """Ids of a pre-token, None where only the whole tokenizer can tell."""
        if part != "\n" and part[-1] not in _REGULAR:
            return None
        if self.word_ends:
            part = part.strip()
            if not part:
                return b""
        bare = part[1:] if part[0] == " " else part
        if bare.isascii() and bare.isprintable():
            written = bare if bare is part else _SPACE + bare
        else:
            written = part.encode().decode("latin-1").translate(_BYTE_CHARS)
        return array("I", [t.id for t in self.model.tokenize(written)]).tobytes()

    def _parts(self, parts: list[str]) -> list[bytes | None]:
        """What is remembered of pre-tokens, after learning the new ones."""
        if self.word_ends:
            parts = [p.lstrip(" ").lower() for p in parts]
        known = self.parts
        for part in set(parts).difference(known):
            known[part] = self._part(part)
        return list(map(known.__getitem__, parts))

    def _piece(self, piece: str) -> bytes:
        parts = self.cut(piece)
        if sum(map(len, parts)) == len(piece) and not ("\n" in piece and _LINE_ENDS.search(piece)):
            found = self._parts(parts)
            if None not in found:
                return b"".join(found)
        return self._library(piece)

    def _new(self, words: list[str]) -> list[bytes]:
        """Ids of words, each with the space before it. All are cut in one pass; a part that starts with a space starts a word."""
        cut = [w for w in words if w and (self.word_ends or not w[-1].isspace())]
        parts = self.cut(" " + " ".join(cut)) if cut else []
        found = self._parts(parts)
        starts = [i for i, part in enumerate(parts) if part[0] == " "]
        known = dict.fromkeys(words, _NONE)
        for word, i, j in zip(cut, starts, [*starts, len(parts)][1:], strict=True):
            ids = found[i] if j == i + 1 else None if None in found[i:j] else b"".join(found[i:j])
            known[word] = self._library(word if self.word_ends else " " + word) if ids is None else ids
        return list(map(known.__getitem__, words))

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of different words, after learning the new ones."""
        found = list(map(self.known.get, words))
        missing = [i for i, ids in enumerate(found) if ids is None]
        if not missing:
            return found
        if len(self.known) >= self.remembered:
            self.known, self.older = {}, self.known
        if len(self.parts) >= min(self.remembered, PARTS):
            self.parts = {}
        names = [words[i] for i in missing]
        ids = list(map(self.older.get, names))
        new = [i for i, own in enumerate(ids) if own is None]
        for i, own in zip(new, self._new([names[i] for i in new]), strict=True):
            ids[i] = own
        self.known.update(zip(names, ids))
        for i, own in zip(missing, ids):
            found[i] = own
        return found

    def _block(self, texts: pa.Array, end: int) -> list[np.ndarray]:
        """Each different word of all the texts is looked up once; the ids are put together by places."""
        n = len(texts)
        split = pc.split_pattern(texts, " ")
        places, words = np.asarray(split.offsets), split.values.dictionary_encode()
        at = np.asarray(words.indices)
        names = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        entries = self._words(names)
        known = len(entries)
        entries.append(array("I", [end]).tobytes())
        whole = np.zeros(n, bool)
        for mark in self.marks:
            whole |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
        if not self.word_ends:  # no space before the first word
            entries += [self._piece(names[i]) for i in at[places[:-1]].tolist()]
        sizes = np.fromiter(map(len, entries), np.int64, len(entries)) // 4
        if not self.word_ends:
            whole[np.repeat(np.arange(n), np.diff(places))[sizes[at] == 0]] = True
        flat, starts = np.frombuffer(b"".join(entries), np.uint32), np.cumsum(sizes) - sizes
        del entries, names
        out: list[np.ndarray] = []
        for first, last in slices(_borders(texts), STRETCH_BYTES):
            own = places[first : last + 1] - places[first]
            order = np.insert(at[places[first] : places[last]], own[1:], known)  # the end id behind each text
            if not self.word_ends:
                order[own[:-1] + np.arange(last - first)] = known + 1 + np.arange(first, last)
            size = sizes[order]
            ends = np.cumsum(size)
            ids = flat[np.repeat(starts[order] - ends + size, size) + np.arange(ends[-1])]
            cuts = [0, *ends[own[1:] + np.arange(last - first)].tolist()]
            out += [ids[i:j] for i, j in zip(cuts, cuts[1:])]
        for i in np.flatnonzero(whole).tolist():
            out[i] = self._whole(texts[i].as_py(), end)
        return out

    def _whole(self, text: str, end: int) -> np.ndarray:
        """A text whose spaces are not all borders, or that may hold special tokens."""
        pieces = [self._library(text)] if any(m in text for m in self.marks) else [self._piece(p) for p in _CUT.split(text) if p]
        return np.frombuffer(b"".join([*pieces, array("I", [end]).tobytes()]), np.uint32)

    def encode(self, texts: pa.Array | Iterable[str | None], end: int) -> list[np.ndarray]:
        """Ids of texts (null: empty) as unsigned 32-bit numbers, each followed by ``end``."""
        texts = pc.fill_null((texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).cast(pa.large_string()), "")
        return [ids for first, last in slices(_borders(texts), BLOCK_BYTES) for ids in self._block(texts[first:last], end)]

    def ids(self, text: str | None, end: int) -> np.ndarray:
        """Ids of one text."""
        return self.encode([text], end)[0]


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, word_ends: bool, remembered: int | None = None) -> Encoder:
    """This worker's encoder for a tokenizer file."""
    key = path, word_ends, remembered
    if key not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[key] = Encoder(path, word_ends, remembered=remembered)
    return _ENCODERS[key]


def crc(ids: np.ndarray) -> int:
    """CRC-32 of ids as little-endian unsigned 32-bit numbers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
