import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from runsight.llm import collocate
from runsight.llm.textbytes import blocks

SCHEMA = "doc_id long, text string, lang string, phrase string, rank string, n string"


def _pieces(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def _brute(rows, least, longest, top, share=100):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        for w in _pieces(text):
            totals[lang or "und"] += len(w)
            for n in range(1, longest + 1):
                counts[lang or "und"].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, f in counts.items():
        often = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in often.items():
            if any(len(q) > len(p) and 100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in often.items()):
                continue
            score, _, left, right = min((1000 * a * totals[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def _texts():
    draw = random.Random(11)
    words = ["the", "of", "New", "york", "city", "é", "ÀB", "x\0", "a-b", "日本", "#", "\x1c"] + [f"w{i}" for i in range(30)]
    marks = [" ", " ", " ", " ", "  ", "\t", ", ", ".", "\n", " ! "]
    text = lambda n: "".join(draw.choice(words) + draw.choice(marks) for _ in range(n))
    shared = "in the city of new york we walk " * 3
    rows = [(text(draw.choice((0, 1, 4, 30, 300))), draw.choice(("en", "de", None))) for _ in range(120)]
    rows += [(shared + text(40), "en") for _ in range(30)] + [(text(50) + shared.title(), "en") for _ in range(10)]
    return rows + [(None, "fr"), ("", None), (" .,", "en"), ("one", "it"), ("same words all over " * 400, "it"), ("w" * 20_000, "de"), ("x " * 3000, "es"), ("a,b." * 500, "es")]


@pytest.mark.parametrize("period,bits", [(1, 27), (3, 8), (64, 27)])
def test_equals_brute_force(spark, period, bits):
    rows = _texts()
    docs = spark.createDataFrame([(i, t, lang, "p", "r", "n") for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(5)
    out = collocate.collocations(docs, least=20, top=60, period=period, bits=bits)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in out.collect()) == _brute(rows, 20, 5, 60)


@pytest.mark.parametrize("longest,share", [(2, 100), (3, 80)])
def test_other_lengths_and_shares(spark, monkeypatch, longest, share):
    monkeypatch.setattr(collocate, "HELD", 50)  # handed on in many parts
    monkeypatch.setattr(collocate, "MOST", 40)  # and texts without a start in many chunks
    rows = _texts()
    docs = spark.createDataFrame([(i, t, lang, "p", "r", "n") for i, (t, lang) in enumerate(rows)], SCHEMA)
    got = collocate.collocations(docs, least=5, longest=longest, top=10_000, share=share, period=7)
    assert sorted(tuple(r) for r in got.collect()) == _brute(rows, 5, longest, 10_000, share)


def test_nothing_frequent_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c", "en", "", "", "")], SCHEMA)
    assert collocate.collocations(docs).count() == 0
    assert collocate.collocations(docs.limit(0)).count() == 0


def test_counts_of_64_bits_and_more(spark):
    """Products beyond 64 bits, from a table of counts."""
    big = 30_000_000_000
    phrases = spark.createDataFrame([("en", "a", 3 * big), ("en", "b", 2 * big), ("en", "a b", big)], "lang string, phrase string, a long")
    row = collocate._scored(phrases, spark.createDataFrame([("en", 7 * big)], "lang string, n long")).first()
    assert row.score == 1000 * big * 7 * big // (6 * big * big) and (row.l, row.r) == (3 * big, 2 * big)


@pytest.mark.parametrize("longest,most", [(2, 1 << 16), (5, 1 << 16), (5, 3), (2, 1)])
def test_chunks_overlap_once(monkeypatch, longest, most):
    monkeypatch.setattr(collocate, "MOST", most)
    rows = [t for t, _ in _texts()]
    for first, words in blocks(pa.array(rows), collocate._WORD):
        starts = Counter()
        for text, chunk, final, own in collocate._chunks(words, longest, 4):
            starts[text] += own
            held = re.findall(rb"[^ \n]+", chunk)
            assert len(held) == own + (0 if final else longest - 1) and (own <= most or final and own < most + longest)
        assert [starts[i] for i in range(len(words))] == [sum(map(len, _pieces(t))) for t in rows[first : first + len(words)]]


def test_equal_passages_give_equal_chunks():
    draw = random.Random(2)
    passage = " ".join(f"p{draw.randrange(1000)}" for _ in range(600))
    texts = [" ".join(f"q{draw.randrange(1000)}" for _ in range(200)) + " " + passage + f" end{k}" for k in range(2)]
    chunks = defaultdict(set)
    for _, words in blocks(pa.array(texts), collocate._WORD):
        for text, chunk, *_ in collocate._chunks(words, 5, 16):
            chunks[text].add(chunk)
    shared = sum(len(c.split()) - 4 for c in chunks[0] & chunks[1])
    assert shared > 500
