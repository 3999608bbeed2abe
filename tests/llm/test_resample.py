import hashlib
import math
import random
import re
import zlib

import pytest

from runsight.llm import resample

SCHEMA = "doc_id long, text string, rank string, score string, place string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _features(text, longest=2):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def _expected(rows, target, percent=25, least=20, buckets=10_000, longest=2):
    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [r[1] for r in rows]), (t, target)):
        for text in texts:
            for f in _features(text, longest)[1]:
                counts[zlib.crc32(f.encode()) % buckets] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    out, able = [], []
    for i, text, *_ in rows:
        n, found = _features(text, longest)
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in found) // len(found) if found else 0
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
            if n >= least:
                able.append((-score, i))
        out.append([i, len(found), weight, score, None])
    drawn = {i: k + 1 for k, (_, i) in enumerate(sorted(able)[: percent * len(able) // 100])}
    return [tuple([*r[:4], drawn.get(r[0])]) for r in out]


def _rows():
    draw = random.Random(5)
    vocabulary = ["".join(draw.choices("abcdeé9Ω", k=draw.randint(1, 5))) for _ in range(200)]
    texts = [None, "", " .,\n", "one", "ONE Two", "x\0y", "a b " * 30_000, "w" * 60_000, "éÀ ß", "ÀÉ-K k"] + [" ".join(draw.choices(vocabulary, k=draw.choice((5, 19, 20, 21, 200)))).title() for _ in range(150)]
    return [(3 * i - 40, t, "r", "s", "p") for i, t in enumerate(texts)], [" ".join(draw.choices(vocabulary[:40], k=30)) for _ in range(20)] + [None, ""]


def _key(rows):
    return sorted(rows, key=lambda r: [x if x is not None else math.inf for x in r])


@pytest.mark.parametrize("chunk", [7, 1 << 20])
def test_equals_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(resample, "RANGE_ROWS", chunk)  # ranks carried between many ranges
    rows, target = _rows()
    rows.append((None, "one more text without a number " * 5, "r", "s", "p"))
    out = resample.resample(spark.createDataFrame(rows, SCHEMA).repartition(5), spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int"))
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert _key(tuple(r) for r in out.collect()) == _key(_expected(rows, target))


def test_longer_runs_and_other_sizes(spark):
    rows, target = _rows()
    out = resample.resample(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(t,) for t in target], "text string"), percent=60, least_words=5, longest=3, buckets=97)
    assert _key(tuple(r) for r in out.collect()) == _key(_expected(rows, target, 60, 5, 97, 3))


def test_runs_do_not_cross_texts():
    values, borders, words = resample._stretch([b"a b", b"", b"c", b"d e f"], 2, 10_000)
    want = [["a", "b", "a b"], [], ["c"], ["d", "e", "f", "d e", "e f"]]
    assert [values[a:b].tolist() for a, b in zip(borders[:-1], borders[1:])] == [[zlib.crc32(f.encode()) % 10_000 for f in own] for own in want]
    assert words.tolist() == [2, 0, 1, 3]
    assert resample._stretch([b""], 2, 10)[1].tolist() == [0, 0]


def test_empty_tables_repeated_and_equal_rows(spark):
    docs, none = spark.createDataFrame(_rows()[0], SCHEMA), spark.createDataFrame([], "text string")
    assert resample.resample(docs.limit(0), none).count() == 0
    assert _key(tuple(r) for r in resample.resample(docs, none).collect()) == _key(_expected(_rows()[0], []))
    same = spark.createDataFrame([(1, "a b c " * 10, "", "", "")] * 8, SCHEMA)
    out = resample.resample(same, none).collect()
    assert sorted(r.rank for r in out if r.rank) == [1, 2] and len({r.score for r in out}) == 1
