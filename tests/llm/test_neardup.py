import random
import re

import numpy as np
import pytest

from runsight.llm import neardup

SCHEMA = "doc_id long, text string, lang string, node string, kept string"


def _set(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def _brute(rows, n):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    sets = [(d, _set(t, n)) for d, t, *_ in rows if d is not None]
    for i, (a, x) in enumerate(sets):
        find(a)
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    return {d: find(d) for d, _ in sets}


def _texts(seed, copies):
    """Originals, some of them with copies that differ in a few words, and passages that many texts share."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    shared = [word() for _ in range(30)]
    out = []
    for i in range(40):
        base = [word() for _ in range(rng.choice((5, 60, 120)))] + (shared if i % 3 == 0 else [])
        out.append(" ".join(base))
        for _ in range(copies if i % 5 == 0 else 0):
            near = base[:]
            for _ in range(rng.randint(0, 3)):
                near[rng.randrange(len(near))] = word()
            out.append(" ".join(near).upper() if rng.random() < 0.2 else "  ".join(near) + "\n")
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("copies", "region"), [(3, 32), (30, 4)])
def test_components_equal_brute_force(spark, copies, region):
    rows = [(i * 7 % 1009, t, "en", "x", None) for i, t in enumerate(_texts(copies, copies))]
    rows += [(2000, None, None, None, None), (2001, "", "en", "x", "y"), (2002, " \n", "en", "x", "y"), (2003, "one two", "en", "x", "y"), (2004, "ONE\ttwo", "en", "x", "y"), (2005, "one", "en", "x", "y")]
    rows += [(2006, "again and again " * 3000, None, None, None), (2007, "again  and again " * 3000, None, None, None), (2008, "lone row twice here", "x", None, None), (2008, "lone row twice here", "x", None, None)]
    wanted = _brute(rows, 4)
    out = neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(5), 4, 80, region).collect()
    assert len(out) == len(rows)
    sizes = {d: len(_set(t, 4)) for d, t, *_ in rows}
    for r in out:
        assert (r.component_id, r.n_shingles, r.kept) == (wanted[r.doc_id], sizes[r.doc_id], r.doc_id == wanted[r.doc_id]), r


def test_true_partner_among_many_lookalikes(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    shared, rows = [word() for _ in range(178)], []
    for i in range(60):
        tail = [word() for _ in range(25)]
        rows.append((i, " ".join(shared + tail), "en", "x", None))
        if i % 4 == 0:  # a partner that shares a little more than the template
            rows.append((1000 + i, " ".join(shared + tail[:4] + [word() for _ in range(21)]), "en", "x", None))
    wanted = _brute(rows, 4)
    assert len(set(wanted.values())) == 60
    out = neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(5), 4, 80, 4).collect()
    assert {r.doc_id: r.component_id for r in out} == wanted


def test_rows_without_id_and_empty_table(spark):
    rows = [(None, "a b c d e", None, None, None), (1, "a b c d e", None, None, None), (2, "a b c d e", None, None, None)]
    out = {(r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out == {(None, None, True), (1, 1, True), (2, 1, False)}
    assert neardup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_deduplicate_keeps_columns_and_one_row(spark):
    rows = [(3, "a b c d e f", "x", "n", "k"), (3, "a b c d e f", "x", "n", "k"), (5, "A b c d e f", "y", None, None), (6, None, None, None, None), (7, "q", None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = neardup.deduplicate(df)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == [3, 6, 7]


def test_texts_that_share_an_id_are_judged_one_by_one(spark):
    """A copy under another document's id takes no other text of that id with it; clashing names stay as they are."""
    one, two = "a b c d e f g", "quite another text of some words"
    rows = [(1, one, "k", 1), (2, one, "k", 2), (2, two, "k", 3), (2, two.upper(), "k", 4), (2, None, "k", 5), (2, "", "k", 6), (None, one, "k", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, own_text_key string, HELD_DOC_ID int")
    out = neardup.deduplicate(df)
    assert out.columns == df.columns
    kept = sorted((r.doc_id or 0, (r.text or "").lower(), r.own_text_key) for r in out.collect())
    assert kept == sorted([(1, one, "k"), (2, two, "k"), (2, "", "k"), (2, "", "k"), (0, one, "k")])


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(5, 5)]
    found = {r.node: r.component for r in neardup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(1, 41), 0), **dict.fromkeys(range(101, 130), 100)}


def test_regions_stay_bounded():
    rng = np.random.default_rng(0)
    table = np.sort(rng.integers(0, 2, (3000, neardup.COMPONENTS)).astype("<u2"), axis=0)
    table = table[np.lexsort(table.T[::-1])]
    table[500:2500] = table[500]
    a, b, _ = neardup._neighbours(table, np.zeros(3000, int), np.arange(3000), 16)
    assert len(a) <= 3000 * 16 and {(i, i + 1) for i in range(500, 2499)} <= set(zip(a.tolist(), b.tolist()))


def test_components_are_joined_per_node_and_done_regions_left(spark, monkeypatch):
    """A node's component is looked up once and not once per tree, and a turn goes on only in regions that have pairs left."""
    rng, rows, turns = random.Random(2), [], []
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    for group, tail in ((0, 30), (1000, 2)):  # lookalikes that are not alike, and near copies
        shared = [word() for _ in range(170)]
        rows += [(group + i, " ".join(shared + [word() for _ in range(tail)]), "en", "x", None) for i in range(40)]
    rows += [(2000, " ".join(shared + [word() for _ in range(60)]), "en", "x", None)]
    plain = neardup.strays

    def watched(regions, held, *rest):
        turns.append((regions.select("tree", "stem").distinct().count(), held.count(), held.select("node").distinct().count()))
        return plain(regions, held, *rest)

    monkeypatch.setattr(neardup, "strays", watched)
    out = neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(5), 4, 80, 4).collect()
    assert {r.doc_id: r.component_id for r in out} == _brute(rows, 4)
    assert len(turns) > 1 and turns[-1][0] < turns[0][0]
    assert all(n == nodes <= len(rows) for _, n, nodes in turns)
