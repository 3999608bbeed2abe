import hashlib
import re

from runsight.llm import pii

SCHEMA = "doc_id long, text string, lang string, kind string"
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _valid(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        total = sum(int(c) * (1 + i % 2) - 9 * (int(c) * (1 + i % 2) > 9) for i, c in enumerate(reversed(digits)))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return kind != "phone" or 8 <= len(digits) <= 15


def _brute(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() for m in re.finditer(p, text or "") if _valid(k, m.group())]


def _check(spark, rows):
    found = pii.digest(pii.find_pii(spark.createDataFrame(rows, SCHEMA))).collect()
    assert len(found) == len(rows)
    for r in found:
        texts = [t for d, t, *_ in rows if d == r.doc_id]
        assert r.base_sha256 in {hashlib.sha256(",".join(_brute(t)).encode()).hexdigest() for t in texts}
        assert set(r.spans.split(",")) - {""} >= set().union(*[set(_brute(t)) for t in texts]) or len(texts) > 1
    return found


def test_base_equals_brute_force(spark):
    texts = [
        None, "", " ", "a@b.c%d@e.f x@y..z @a.b a@b", "1.2.3.4.5.6.7.8 300.1.1.1 001.02.3.4 1.2.3", "é😀 x@y.z 😀1.1.1.1",
        "4111 1111 1111 1111 4111-1111-1111-1112 5500005555555559 1234", "+1 (918) 555-2191) +12 +1234567 +++49 30 1234567 +1+2345678901",
        "tel:+44.20.7946.0958,4111111111111111@card.com", "word " * 3000 + "z@z.zz",
    ]
    found = _check(spark, [(i, t, "en", "x") for i, t in enumerate(texts)])
    assert sum(r.n_card for r in found) > 0 and sum(r.n_email for r in found) > 3


def test_long_runs_stay_linear(spark):
    text = "1" * 100_000 + " " + "a" * 100_000 + " @a" + ".b" * 30_000 + " 9" * 30_000
    assert pii.digest(pii.find_pii(spark.createDataFrame([(1, text, "en", "x")], SCHEMA))).count() == 1


def test_empty_table_and_repeated_rows(spark):
    assert pii.find_pii(spark.createDataFrame([], SCHEMA)).count() == 0
    _check(spark, [(1, "a@b.cd", "en", "x"), (1, "a@b.cd", "en", "x"), (1, "1.1.1.1", None, None), (None, None, None, None)][:3])


def _bootstrap_rows():
    known = [(i, f"text number {'abcdefgh'[i]} please call me at +1 555 123 456{i} tomorrow then", "en", "x") for i in range(8)]
    prose = [(100 + i, f"we met at noon 2024-{i} and order 99887766 was sent out with {i}12345 boxes", "en", "x") for i in range(5)]
    return known + prose + [(50, "é please call me at 555-123-9999 tomorrow please", "en", "x")]


def test_contexts_find_unseen_identifiers(spark):
    rows = _bootstrap_rows()
    found = {r.doc_id: r for r in pii.digest(pii.find_pii(spark.createDataFrame(rows, SCHEMA))).collect()}
    start = rows[-1][1].index("555")
    assert found[50].spans == f"phone:{start}:{start + 12}" and found[50].n_phone == 0
    assert all(found[i].spans == ",".join(_brute(t)) for i, t, *_ in rows if i != 50)


def test_short_contexts(spark):
    rows = [(i, f"{name} tel no +1 555 123 456{i}", "en", "x") for i, name in enumerate("anna bert carl dora emil fred gina hugo".split())]
    rows += [(20 + i, f"{'abcdefgh'[i]}x phone: +1 555 321 456{i} ext", "en", "x") for i in range(8)]
    rows += [(100, "zoe tel no 555-123-9999", "en", "x"), (101, "phone: 555-321-9999 ext", "en", "x")]
    found = {r.doc_id: r for r in pii.digest(pii.find_pii(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert found[100].spans == "phone:11:23" and found[101].spans == "phone:7:19"


def test_mask(spark):
    rows = _bootstrap_rows() + [(60, None, None, "x"), (61, "a@b.cd +4930123456 end", "en", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    masked = {r.doc_id: r.text for r in pii.mask_documents(df).select(df.columns).collect()}
    assert masked[50] == "é please call me at [PHONE] tomorrow please"
    assert masked[60] is None and masked[61] == "[EMAIL] [PHONE] end" and masked[100] == rows[8][1]
    assert len(masked) == len(rows)


def test_rows_without_an_id_and_clashing_names(spark):
    """A text without an id has its added spans like any other; columns of documents may be called as those used inside."""
    rows = [(i, t, "k", "a") for i, t, *_ in _bootstrap_rows()] + [(None, "ü please call me at 555-123-8888 tomorrow please", "k", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, HELD_KEY string, added string")
    found = {r.doc_id: r.spans for r in pii.digest(pii.find_pii(df)).collect()}
    assert found[None] == "phone:20:32" and found[50] == "phone:20:32"
    out = pii.mask_documents(df)
    assert out.columns == df.columns and {r.doc_id: r.text for r in out.collect()}[None] == "ü please call me at [PHONE] tomorrow please"
    assert pii.mask_documents(df.limit(0)).count() == 0


def test_patterns_are_counted_without_a_join_of_the_corpus(spark, monkeypatch):
    rows = [(i, f"please write to us at user{i}@example.org for more, or call 0049-17{i}55 for more") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = sorted(map(tuple, pii.digest(pii.find_pii(docs)).collect()))

    def join(*_, **__):
        raise AssertionError("joined")

    monkeypatch.setattr(pii, "broadcast_if_small", join)
    assert sorted(map(tuple, pii.digest(pii.find_pii(docs)).collect())) == wanted
    monkeypatch.undo()
    monkeypatch.setattr(pii, "FEW_PATTERNS", 0)
    assert sorted(map(tuple, pii.digest(pii.find_pii(docs)).collect())) == wanted
