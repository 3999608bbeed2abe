import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from runsight.llm import batches, packing, tokens, wavelet

ODD = [
    "a  b   c\n d \t e\r\n\r\n f", "", "  lead", " x", "trail  ", " don't I'LL we've  é  z", "\x1c a\x1c  b", "日本 語  !!  ??", None, "a ́b  ́ c", "İSTANBUL ΣΑΣ ςΣ ß Ÿ",
    "<|endoftext|> <|startoftext|>", "a <|endoftext|>b<|ENDOFTEXT|> <| c", "x<|startoftext|> y", "one,two. three!! (four) x1 2y", "\n\n", " ", "tab\tand nbsp  end",
]
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, start string, ids string"


def _plain(path, plain_marks=False):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = plain_marks
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("plain_marks", [False, True])
@pytest.mark.parametrize(("path", "word_ends"), [(BYTE, False), (WORD, True)])
def test_pieces_give_the_ids_of_whole_texts(path, word_ends, plain_marks, monkeypatch):
    rng, plain = random.Random(0), _plain(path, plain_marks)
    assert plain_marks != ({49407, 50256} & set(plain("a <|endoftext|> b")) != set())
    some = "".join(rng.choice("ab Zé.,'!\n\t 1ß#") for _ in range(4000))
    texts = [*ODD, some, some]
    for remembered in (tokens.REMEMBERED, 3):
        monkeypatch.setattr(tokens, "REMEMBERED", remembered)
        own = tokens.Encoder(path, word_ends, plain_marks)
        for text in texts:
            assert own.ids(text, 7).tolist() == plain(text) + [7]


def _rows():
    long = " ".join(f"word{i % 700}" for i in range(9000))
    texts = [*ODD, long, "same text here", "same text here", "same text there"]
    return [(i * 3, t, "x", None) for i, t in enumerate(texts)]


def test_packing_covers_each_id_once(spark):
    rows, plain = [*_rows(), (3, "again", "x", None), (None, "no id", None, None)], _plain(WORD)
    out = packing.pack(spark.createDataFrame(rows, SCHEMA), WORD, end=1, shard_tokens=400).collect()
    wanted = sorted(zlib.crc32(np.array(plain(t) + [1], "<u4").tobytes()) for _, t, *_ in rows)
    ids = {}
    for d, t, *_ in rows:
        ids.setdefault(d, []).append(plain(t) + [1])
    seen = {}
    for r in out:
        own = [x for x in ids[r.doc_id] if len(x) == r.doc_tokens and zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32]
        assert own
        seen.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length))
    assert len(wanted) == len(rows) and sum(r.length for r in out) == sum(len(x) for v in ids.values() for x in v)
    for (_, n), parts in seen.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == n
    sequences = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.LENGTH and at & (at - 1) == 0


def test_neighbours_come_by_score():
    units = [np.array(x) for x in ([1, 2, 3], [7, 8], [1, 2, 9], [1, 9, 9], [5])]
    index = packing.Index(units, np.ones(packing.VOCABULARY, np.float32), 3.0)
    index.free[0] = False
    assert list(index.neighbours(0)) == [2, 3]
    index.free[2] = False
    assert list(index.neighbours(0)) == [3]


def test_related_documents_share_a_sequence(spark):
    topics = [" ".join(f"{name}{i}" for i in range(60)) for name in ("alpha", "beta", "gamma")]
    rows = [(i, f"{topics[i % 3]} note {i}", "x", None) for i in range(30)]
    out = packing.pack(spark.createDataFrame(rows, SCHEMA).coalesce(1), WORD, end=1)
    full = [r.sequence_id for r in out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n = 2048").collect()]
    kinds = out.where(F.col("sequence_id").isin(full)).select("sequence_id", (F.col("doc_id") % 3).alias("k")).distinct().count()
    assert full and kinds < 3 * len(full)


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    assert packing.pack(none, WORD, end=1).count() == 0
    shards = wavelet.write_shards(none, str(tmp_path), BYTE, end=2)
    assert shards.count() == 0 and wavelet.read_shards(shards).count() == 0


def test_wavelet_round_trip(spark, tmp_path):
    rows, plain = [*_rows(), (3, "again", "x", None)], _plain(BYTE)
    shards = wavelet.write_shards(spark.createDataFrame(rows, SCHEMA).repartition(3), str(tmp_path), BYTE, end=2, shard_tokens=300).cache()
    out = sorted(wavelet.read_shards(shards).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in out] == sorted(d for d, *_ in rows)
    at = 0
    for r in out:
        assert r.start == at
        at += r.n_tokens
    wanted = {}
    for d, t, *_ in rows:
        wanted.setdefault(d, []).append(zlib.crc32(np.array(plain(t) + [2], "<u4").tobytes()))
    for r in out:
        assert r.ids_crc32 in wanted[r.doc_id]
    some = wavelet.shard_matrix(spark, shards.first().path)
    assert some.decode().tolist() == [some.access(i) for i in range(some.size)]
    shards.unpersist()


@pytest.mark.parametrize("size", [0, 1, 511, 512, 513, 3000])
def test_wavelet_lookups(size):
    rng = np.random.default_rng(size)
    ids = rng.integers(0, 40, size).astype(np.uint32) * 1100
    matrix = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(ids, np.array([1]), np.array([size])).to_bytes())
    assert np.array_equal(matrix.decode(), ids)
    for token in (0, 1100, 39 * 1100, 5, 70_000):
        places = np.flatnonzero(ids == token)
        assert matrix.count(token) == len(places)
        assert matrix.count(token, size // 3, size // 2) == ((places >= size // 3) & (places < size // 2)).sum()
        assert [matrix.locate(token, k) for k in range(min(5, len(places)))] == places[:5].tolist()
        with pytest.raises(IndexError):
            matrix.locate(token, len(places))


@pytest.mark.parametrize(("path", "word_ends"), [(BYTE, False), (WORD, True)])
def test_each_word_of_many_texts_is_looked_up_once(path, word_ends):
    class Counted(dict):
        asked = 0

        def get(self, word):
            self.asked += 1
            return super().get(word)

    own, plain = tokens.Encoder(path, word_ends, remembered=50), _plain(path)
    own.known = Counted()
    texts = ["x one two three", None, "x one two", "x two\none.  Three ", "<|endoftext|> x"] * 40
    assert [ids.tolist() for ids in own.encode(texts, 7)] == [plain(t) + [7] for t in texts]
    assert own.known.asked < 20


@pytest.mark.parametrize(("path", "word_ends"), [(BYTE, False), (WORD, True)])
def test_blocks_and_stretches_change_no_ids(path, word_ends, monkeypatch):
    plain, texts = _plain(path), [*ODD, "one two three  four", "", None, "x " * 300] * 3
    for block, stretch in ((1 << 23, 40), (200, 1 << 20), (200, 1)):
        monkeypatch.setattr(tokens, "BLOCK_BYTES", block)
        monkeypatch.setattr(tokens, "STRETCH_BYTES", stretch)
        assert [ids.tolist() for ids in tokens.Encoder(path, word_ends).encode(texts, 7)] == [plain(t) + [7] for t in texts]


def test_rows_of_several_batches_are_gathered():
    rows = [pa.RecordBatch.from_arrays([pa.array(range(i, i + 3)), pa.array(["x" * n] * 3)], ["doc_id", "text"]) for i, n in ((0, 1), (3, 1), (6, 500), (9, 1), (12, 1))]
    out = [b.column(0).to_pylist() for b in batches.gathered(iter(rows), 200)]
    assert out == [[*range(6)], [6, 7, 8], [*range(9, 15)]]
    assert list(batches.gathered(iter([]), 200)) == []


def test_index_counts_each_id_of_a_unit():
    rng = np.random.default_rng(3)
    idf, units = rng.random(packing.VOCABULARY).astype(np.float32), [rng.choice([0, 5, 9, 70, 65535], n).astype("<u2") for n in (1, 4, 30, 2, 30)]
    index = packing.Index(units, idf, 11.0)
    for k, own in enumerate(units):
        terms, times = np.unique(own, return_counts=True)
        norm = packing.K1 * (1 - packing.B + packing.B * len(own) / 11.0)
        here = slice(index.rows[k], index.rows[k + 1])
        assert index.term[here].tolist() == terms.tolist()
        assert index.weight[here].tolist() == (idf[terms] * times * (packing.K1 + 1) / (times + norm)).astype(np.float32).tolist()
    for term in (0, 5, 70, 65535, 3):
        assert index.posting_unit[index.lists[term] : index.lists[term + 1]].tolist() == [k for k, own in enumerate(units) if term in own]


@pytest.mark.parametrize("stretch", [1, 7, 64, 1 << 15])
def test_planes_are_moved_in_stretches(stretch, monkeypatch):
    monkeypatch.setattr(wavelet, "STRETCH", stretch)
    ids = np.random.default_rng(1).integers(0, 50_000, 300).astype(np.uint32)
    matrix = wavelet.WaveletMatrix.build(ids, np.array([1]), np.array([300]))
    assert np.array_equal(matrix.decode(), ids) and [matrix.access(i) for i in range(300)] == ids.tolist()
