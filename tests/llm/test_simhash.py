import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from runsight.llm import simhash

SCHEMA = "doc_id long, text string, print string, component string, key string"


def _print(text, n=4):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    runs = [b" ".join(words[i : i + n]) for i in range(max(len(words) - n + 1, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _groups(prints, radius=4):
    """Smallest id reachable, over all pairs. ``prints``: (id, fingerprint)."""
    group = {i: i for i, _ in prints}

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for k, (i, x) in enumerate(prints):
        for j, y in prints[:k]:
            if (x ^ y).bit_count() <= radius:
                a, b = sorted((top(i), top(j)))
                group[b] = a
    return {i: top(i) for i, _ in prints}


@pytest.mark.parametrize("radius", [1, 2, 3, 4])
def test_masks_cover_every_set_of_places(radius):
    masks, draw = simhash.covering(radius), random.Random(3)
    assert len(masks) == 2 ** (radius + 1) - 1
    for _ in range(5000):
        places = sum(1 << p for p in draw.sample(range(64), radius))
        assert any(not m & places for m in masks)


def test_hashes_are_those_of_spark(spark):
    text = "Ünder a B c d\x0be  x é"
    own = [int(h) for h in simhash.shingle_hashes(text)]
    words = "Ünder a b c d e x é".split()
    runs = [" ".join(words[i : i + 4]) for i in range(5)]
    assert [h % 2**64 for h in (r[0] for r in spark.createDataFrame([(r,) for r in runs], "s string").select(F.xxhash64("s")).collect())] == own
    assert simhash.shingle_hashes("A b").tolist() == [xxhash.xxh64_intdigest(b"a b", 42)]
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0
    long = " ".join(map(str, np.random.default_rng(1).integers(0, 50, 100_000)))
    assert simhash.fingerprint(long) == _print(long)


def _near(center, draw, most):
    return center ^ sum(1 << p for p in draw.sample(range(64), draw.randint(0, most)))


@pytest.mark.parametrize("radius", [3, 4])
@pytest.mark.parametrize("listed", [2, 5, 4096])
def test_links_join_what_all_pairs_join(spark, radius, listed):
    draw = random.Random(radius)
    prints = {0, 2**64 - 1}
    for most in (1, 2, 4, 6, 9):
        center = draw.getrandbits(64)
        prints |= {_near(center, draw, most) for _ in range(40)}
    prints = sorted(prints)
    nodes = spark.createDataFrame([(simhash._signed(p),) for p in prints], "print long")
    found = [(r.a % 2**64, r.b % 2**64) for r in simhash.links(nodes, radius, listed).collect()]
    assert all((a ^ b).bit_count() <= radius for a, b in found)
    want = _groups([(p, p) for p in prints], radius)
    got = {p: p for p in prints}

    def top(i):
        while got[i] != i:
            i = got[i]
        return i

    for a, b in found:
        a, b = sorted((top(a), top(b)))
        got[b] = a
    assert {p: top(p) for p in prints} == want and len(set(want.values())) < len(prints)


def _texts():
    draw = random.Random(7)
    vocabulary = ["".join(draw.choices("abcdefgh", k=draw.randint(1, 7))) for _ in range(400)]
    base = [" ".join(draw.choices(vocabulary, k=draw.choice((3, 30, 400)))) for _ in range(25)]
    out = base + [None, "", " \t", "one", "ONE", "a b c", "x " * 5000, "é ü", "the same line\n" * 300]
    for text in base:
        words = text.split()
        for _ in range(3):
            words[draw.randrange(len(words))] = draw.choice(vocabulary)
            out.append("  ".join(words).upper())
    return out + base[:5] * 8


def test_groups_equal_brute_force(spark):
    texts = _texts()
    rows = [(1000 - i, t, "p", "c", "k") for i, t in enumerate(texts)]
    rows += [(1, "one", "p", "c", "k"), (1, "something else entirely here", "p", "c", "k"), (None, "one", None, None, None)]
    prints = [(i, _print(t)) for i, t, *_ in rows if i is not None]
    want = _groups([(k, x) for k, (_, x) in enumerate(prints)])
    least = {}
    for k, (i, _) in enumerate(prints):
        least[want[k]] = min(i, least.get(want[k], i))
    expected = sorted([(i, f"{x:016x}", least[want[k]]) for k, (i, x) in enumerate(prints)] + [(-1, f"{_print('one'):016x}", -1)])
    for listed in (2, 4096):
        out = simhash.simhash_groups(spark.createDataFrame(rows, SCHEMA), listed=listed)
        assert out.columns == ["doc_id", "fingerprint", "component_id"]
        assert sorted((-1 if r[0] is None else r[0], r[1], -1 if r[2] is None else r[2]) for r in out.collect()) == expected
    assert simhash.simhash_groups(spark.createDataFrame([], SCHEMA)).count() == 0
