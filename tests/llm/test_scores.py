import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from runsight.llm import decontam, langid, lmscore, quality, rules
from runsight.llm.textbytes import SPACED, blocks

SCHEMA = "doc_id long, text string, lang string, source string, score string"


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


ODD = [None, "", " \n", "one", "\n\n a a a a a a a", "é ç\nx\nx\nx \n\nx", "a b c a b c a b", "#*$ %&| <>a\x0b\x1c", "the same line\n" * 400, "w" * 50_000, "a b " * 40_000]


# Quality rules


def _counts(text):
    w = _words(text)
    grams = list(zip(w, w[1:], w[2:]))
    often, spots, seen, lines = Counter(grams), set(), set(), 0
    for i, g in enumerate(grams):
        if often[g] > 1:
            spots |= {i, i + 1, i + 2}
    for line in (text or "").split("\n"):
        if _words(line):
            lines += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), lines, len(spots)


def test_base_counts_equal_brute_force(spark):
    rows = [(i, t, None if i % 2 else "en", "s", "x") for i, t in enumerate([*ODD, "x y z " * 60])] + [(3, "one", "en", None, "x")]
    out = rules.quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()
    texts = {d: t for d, t, *_ in rows}
    assert len(out) == len(rows)
    for r in out:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == _counts(texts[r.doc_id]), r
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    assert rules.quality_rules(spark.createDataFrame([], SCHEMA)).count() == 0


def _prose(seed, n, alphabet="abcdefghij", size=5):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list(alphabet), size)) for _ in range(n))


def test_limits_follow_language_and_source(spark):
    rows = [(i, _prose(i, 60 + i % 7), "en", "a", None) for i in range(250)] + [(1000 + i, _prose(i, 60, size=12), "de", "b", None) for i in range(250)]
    rows += [(2000, _prose(1, 80, size=12), "en", "a", None), (2001, _prose(1, 80, size=5), "de", "b", None), (2002, " ".join(f"{w}##" for w in _prose(5, 80).split()), "en", "a", None)]
    kept = {r.doc_id: r.kept for r in rules.quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not any(kept[i] for i in (2000, 2001, 2002)) and sum(kept.values()) == 500


def test_sketches_merge(spark):
    rows = [(i, _prose(i, 50 + i % 40), "en", "ab"[i % 2], None) for i in range(100)]
    measured = rules.measure(spark.createDataFrame(rows, SCHEMA))
    merged = rules.merge(rules.sketch(measured, ["lang", "source"]), ["lang"]).collect()
    assert sorted(map(tuple, merged)) == sorted(map(tuple, rules.sketch(measured, ["lang"]).collect()))
    got = {r.v: r.b for r in spark.range(100_000).selectExpr("id * 37 AS v").select("v", rules.bucket(rules.F.col("v")).alias("b")).collect()}
    assert all(b <= v and (v - b) * 64 <= max(v, 63) for v, b in got.items())


# Stupid backoff


def _backoff(rows, order=3):
    texts = [[re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in _words(t)] for _, t, *_ in rows]
    grams = [Counter(tuple(w[i : i + k]) for k in range(1, order + 1) for i in range(len(w) - k + 1)) for w in texts]
    total, n = sum(grams, Counter()), sum(map(len, texts))
    out = []
    for w, own in zip(texts, grams):
        c = lambda g: total[g] - own[g]  # noqa: E731, B023
        others, score = n - len(w), 0.0
        for i in range(len(w)):
            most = min(i + 1, order)
            for k in range(most, 0, -1):
                g = tuple(w[i - k + 1 : i + 1])
                if c(g) > 0:
                    score += math.log(c(g) / (c(g[:-1]) if k > 1 else others)) + (most - k) * math.log(0.4)
                    break
            else:
                score += most * math.log(0.4) - math.log(others + 1)
        out.append((len(w), score))
    return out


@pytest.mark.parametrize("block", [1, 200, 1 << 24])
def test_scores_equal_brute_force(spark, block):
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(list("abCd"), rng.integers(0, 30))) for _ in range(40)] + [t for t in ODD if len(t or "") < 1000] + ["only here twice only here twice"]
    rows = [(i, t, "en", "s", "x") for i, t in enumerate([*texts, texts[0], "d c A"])]
    found = {r.doc_id: r for r in lmscore.lm_scores(spark.createDataFrame(rows, SCHEMA).repartition(3), block_text=block, partition_text=500).collect()}
    for (i, *_), (n, score) in zip(rows, _backoff(rows)):
        assert found[i].n_words == n and math.isclose(found[i].log_score, score, rel_tol=1e-9, abs_tol=1e-9)


def test_scores_of_odd_tables(spark):
    assert lmscore.lm_scores(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, "a b", None, None, None), (1, "a b", None, None, None), (None, None, None, None, None)]
    out = lmscore.lm_scores(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.n_words, round(r.log_score, 6)) for r in out) == [(0, 0.0), (2, round(math.log(0.5), 6)), (2, round(math.log(0.5), 6))]


# Decontamination


def _items():
    return [(i, f"{_prose(100 + i, 12 + i)}.\n{_prose(200 + i, 1 + i % 9)}") for i in range(30)] + [(40, _prose(300, 400)), (41, None), (42, ""), (None, "x y z"), (43, "short item")]


def _leaks(docs, items):
    ws = lambda t: re.findall("[0-9a-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    grams = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    def share(own, there):
        n = min(5, len(own))
        return len(grams(own, n) & grams(there, n)) / len(grams(own, n)) if n else 0.0

    out = set()
    for d, t, *_ in docs:
        for i, text in items:
            if i is not None and text:
                question, _ = decontam.question_and_answer(text)
                if max(share(ws(text), ws(t)), share(ws(question), ws(t))) >= 0.8:
                    out.add((d, i))
    return out


def _docs():
    items = dict(_items())
    docs = [(i, t, "en", "s", "x") for i, t in enumerate([t for t in ODD if t is None or len(t) < 60_000])]
    docs += [(100, f"{_prose(1, 200)} {items[3]} {_prose(2, 90)}", "en", "s", "x"), (101, items[7].upper().replace("\n", "  "), "en", "s", "x"), (102, f"{_prose(9, 1000)} {items[40]}, {_prose(8, 70)}", "en", "s", "x")]
    return docs + [(103, " ".join(items[12].split()[:6]) + " " + _prose(4, 100), "en", "s", "x"), (104, f"{items[20]} {items[21]}", "en", "s", "x"), (104, f"{items[20]} {items[21]}", "en", "s", "x"), (105, _prose(77, 3000), None, None, None)]


def test_leaks_equal_brute_force(spark, monkeypatch):
    docs, items = spark.createDataFrame(_docs(), SCHEMA), spark.createDataFrame(_items(), "item_id long, text string")
    wanted = _leaks(_docs(), _items())
    assert len(wanted) == 5
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(docs, items).collect()} == wanted
    assert decontam.leaks(docs, items).where("doc_id = 104").count() == 4
    clean = decontam.clean(docs, items)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {d for d, *_ in _docs()} - {d for d, _ in wanted}
    monkeypatch.setattr(decontam, "SHARD_BYTES", 2000)
    monkeypatch.setattr(decontam, "BOUNDS", 500)
    assert len(decontam.indexes(items)) > 2
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(docs, items).collect()} == wanted


def test_question_alone_is_a_leak(spark):
    items = [(i, f"{_prose(i, 8)}\n{_prose(500 + i, 40)}") for i in range(30)] + [(100 + i, f"{_prose(900 + i, 70)}?\n{_prose(950 + i, 300)}") for i in range(5)]
    docs = [(i, f"{_prose(2000 + i, 90)} {decontam.question_and_answer(t)[0]} {_prose(3000 + i, 70)}", "en", "s", "x") for i, t in items]
    wanted = _leaks(docs, items)
    assert wanted == {(i, i) for i, _ in items}
    docs, items = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    found = decontam.leaks(docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in found} == wanted and all(r.question_overlap == 1.0 and r.answer_overlap == 0.0 for r in found)
    assert decontam.clean(docs, items).count() == 0


def test_leaks_of_empty_tables(spark):
    docs, items = spark.createDataFrame(_docs(), SCHEMA), spark.createDataFrame([], "item_id long, text string")
    assert decontam.leaks(docs, items).count() == 0 and decontam.clean(docs, items).count() == docs.count()
    assert decontam.leaks(docs.limit(0), spark.createDataFrame(_items(), items.schema)).count() == 0


def test_block_max_search_equals_full_scoring():
    rng = np.random.default_rng(0)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary, 8))) for i in range(60)]
    hashes = {w: int(decontam._words(w).hash[0]) for w in vocabulary}
    df = Counter(hashes[w] for _, t in items for w in set(t.split()))
    index = decontam.Index(items, df, len(items), 8.0)
    for _ in range(50):
        query = decontam._words(" ".join(rng.choice(vocabulary, 20)))
        terms = index.terms(query.hash)
        full = Counter()
        for t in set(terms.tolist()):
            if t < len(index.vocabulary):
                own = slice(index.lists[t], index.lists[t + 1])
                for segment, weight in zip(index.segments[own].tolist(), index.weights[own].tolist()):
                    full[segment] += weight
        for threshold in (0.2, 0.5):
            opened = index.open_passages(terms, np.arange(len(terms)) // 10, np.array([[0, 1]]), threshold)
            found = dict(index.search(opened[0][1], opened[0][2], threshold)) if opened else {}
            assert set(found) == {s for s, v in full.items() if v >= threshold}
            assert all(math.isclose(found[s], full[s]) for s in found)


# Classifiers


def _languages():
    rng = np.random.default_rng(1)
    rows = []
    for i in range(240):
        lang = ("aa", "bb", "cc")[i % 3]
        rows.append((i, " ".join("".join(rng.choice(list(dict(aa="abcde", bb="defgh", cc="xyéèa")[lang]), 6)) for _ in range(30)), lang, "s", "x"))
    return rows


def test_gradients_of_the_network():
    network = langid.Network(3, 4)
    rng = np.random.default_rng(0)
    codes, labels, weight = rng.integers(97, 110, (5, 6)).astype(np.uint8), np.array([0, 1, 2, 0, 1]), np.ones(5)
    network.weights = {k: v.astype(float) for k, v in network.weights.items()}
    _, grads = network.gradients(codes, labels, weight)
    for k, w in network.weights.items():
        at = np.unravel_index(np.abs(grads[k]).argmax(), w.shape)
        old, sides = w[at], []
        for step in (1e-3, -1e-3):
            w[at] = old + step
            sides.append(network.gradients(codes, labels, weight)[0])
        w[at] = old
        assert math.isclose((sides[0] - sides[1]) / 2e-3, grads[k][at], rel_tol=1e-2)


def test_languages(spark):
    rows = _languages() + [(900, None, "aa", "s", "x"), (901, "", None, None, None), (902, "12 34!", "aa", "s", "x"), (903, "abcde" * 5000, None, "s", "x"), (904, "日本", None, None, None), (904, "日本", None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = langid.identify(df).collect()
    assert len(out) == len(rows)
    lang = {d: x for d, _, x, *_ in rows}
    held = [r for r in out if r.held_out and r.doc_id < 900]
    assert len(held) > 30 and sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)
    found = {r.doc_id: (r.lang_pred, r.score) for r in out}
    assert all(found[i] == ("und", 0.0) for i in (900, 901, 902)) and found[903][0] == "aa" and found[904][0] in ("aa", "bb", "cc")
    assert all(0 <= r.score <= 1 for r in out)
    assert langid.accepted(df.withColumn("LANG_PRED", F.lit("x")).withColumn("letters", F.lit(1))).columns == [*df.columns, "LANG_PRED", "letters"]
    kept = langid.accepted(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()}.isdisjoint({900, 901, 902})
    nothing = spark.createDataFrame([(1, "abc", None, None, None)], SCHEMA)
    assert langid.identify(nothing).first().lang_pred == "und" and langid.accepted(nothing).count() == 1
    assert langid.identify(spark.createDataFrame([], SCHEMA)).count() == 0


def test_remembered_words_give_the_same_sums():
    network = langid.Network(3, 4)
    own = langid.Labeller(network)
    texts = langid.pa.array(["ab cd ab", "cd " + "x" * 60, "", "ab"])
    once = [own.documents(w) for _, w in blocks(texts, langid.LETTERS)][0]
    again = [own.documents(w) for _, w in blocks(texts, langid.LETTERS)][0]
    p, _ = network.probabilities(np.frombuffer(b"ab", np.uint8)[None, :])
    assert np.allclose(once, again) and np.allclose(once[3], p.mean(axis=(0, 1))) and not once[2].any()


def _quality_rows():
    good = [(i, _prose(i, 40 + i % 90), "en", "s", "x") for i in range(200)]
    return good + [(300 + i, f"{_prose(i, 30)} " + "spam! " * (60 + i), "en", "s", "x") for i in range(200)]


def test_gradients_of_attention():
    rng = np.random.default_rng(0)
    model = quality.Model(np.zeros(quality.FEATURES), np.ones(quality.FEATURES))
    x, borders, y, weight = rng.normal(size=(9, quality.FEATURES)), np.array([0, 3, 4, 9]), np.array([1, 0, 1]), np.array([1.0, 2, 1])

    def loss():
        s = model.forward(x, borders)["score"]
        return -float(((y * np.log(s) + (1 - y) * np.log(1 - s)) * weight).sum() / weight.sum())

    grads = model.gradients(x, borders, y, weight)
    for k, w in model.weights.items():
        at = np.unravel_index(np.abs(grads[k]).argmax(), w.shape)
        old, sides = w[at], []
        for step in (1e-5, -1e-5):
            w[at] = old + step
            sides.append(loss())
        w[at] = old
        assert math.isclose((sides[0] - sides[1]) / 2e-5, grads[k][at], rel_tol=1e-4)


def test_quality(spark):
    rows = _quality_rows() + [(900, None, None, None, None), (901, "", "en", "s", "x"), (902, "one " * 30_000, "en", "s", "x"), (902, "one " * 30_000, "en", "s", "x"), (None, "x", None, None, None)]
    labels = [(i, int(i < 300)) for i, *_ in _quality_rows()] + [(5000, 1), (1, 1), (None, 0), (900, None), (901, 7)]
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int")
    out = quality.quality(docs, marks).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    held = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert len(held) > 60 and sum(r.predicted == int(r.doc_id < 300) for r in held) >= 0.95 * len(held)
    assert {r.score for r in quality.quality(docs, marks.limit(0)).collect()} == {0.5}
    assert quality.quality(docs.limit(0), marks).count() == 0


def test_passages():
    words = next(blocks(langid.pa.array([" ".join(["a"] * 65), "", None, "B c\nc"]), SPACED))[1]
    rows, borders = quality.passages(words)
    assert borders.tolist() == [0, 2, 3, 4, 5] and not rows[2:4].any()
    rest = rows[:, -5:]
    assert np.allclose(rest[0, :2], [1 / 64, 63 / 64]) and np.allclose(rest[1, :3], [1, 1, 1]) and np.allclose(rest[4], [2 / 3, 1 / 3, 1 / 3, 0.1, 1 / 3])


def test_counts_travel_back_without_their_ngrams(spark, tmp_path):
    text = " ".join(f"w{i * 7919 % 20011}" for i in range(20000))
    rows = [(i, text) for i in range(2)]
    table = lmscore._blocked(spark.createDataFrame(rows, "doc_id long, text string"), 1000)
    assert table.count() == 2
    lmscore._counted(table, str(tmp_path), 1, 4, 40)
    files = list((tmp_path / "1").iterdir())
    assert len(files) == 2 and all(f.stat().st_size < 20000 for f in files)
