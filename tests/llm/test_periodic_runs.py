"""Runs of words against all periods and places."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqprep.llm import periodic_runs as P
from seqprep.llm.queries import _planted


def all_runs(w, least=6, power=4):
    """Every period, every stretch; the smallest period of a stretch counts."""
    n, out = len(w), {}
    for q in range(1, n // power + 1):
        i = 0
        while i + q < n:
            e = i
            while e + q < n and w[e] == w[e + q]:
                e += 1
            if e > i and e + q - i >= max(least, power * q):
                out.setdefault((i, e + q - i), q)
            i = e + 1
    # a stretch is listed under its smallest period; larger ones with the same ends are multiples of it
    return sorted((s, l, q) for (s, l), q in out.items() if not any(s2 <= s and s + l <= s2 + l2 and q2 < q and q % q2 == 0 for (s2, l2), q2 in out.items()))


def draw(r):
    w, letters = [], r.randint(1, 6)
    while len(w) < r.randint(1, 120):
        base = [r.randrange(letters) for _ in range(r.randint(1, 9))]
        w += base * r.choice([1, 1, 2, 3, 4, 5, 9]) + base[: r.randint(0, len(base))]
    return w


@pytest.mark.parametrize("least,power", [(6, 4), (4, 2), (9, 3), (1, 2)])
def test_runs_against_all_periods(least, power):
    r = random.Random(least)
    for _ in range(700):
        w = draw(r)
        assert P.find_runs(np.array(w), least, power) == all_runs(w, least, power), w


def test_chunked_positions():
    r = random.Random(1)
    items = r.sample(range(10_000), 5000)
    held, seen = P.Positions(items[0]), [items[0]]
    for x in items[1:]:
        before, after = held.insert(x)
        assert before == max((y for y in seen if y < x), default=None) and after == min((y for y in seen if y > x), default=None) if len(seen) < 300 else True
        seen.append(x)
    assert list(held) == sorted(items) and len(held.chunks) > 3


def test_long_texts():
    assert P.find_runs(np.zeros(60_000)) == [(0, 60_000, 1)]
    w = np.tile(np.arange(7), 20_000)
    assert P.find_runs(np.concatenate([[9], w, [8]])) == [(1, 140_000, 7)]
    assert P.find_runs(np.arange(200_000)) == []


def test_table(spark):
    texts = ["a b a b a b a b a b c", None, "", " \t\n", "x\x0bx\x0cx x\rx x y y", "no run here", "w " * 300_000, "a b a b a b a b a b c"]
    docs = spark.createDataFrame([(None if i == 5 else i % 7, t, "r", [1]) for i, t in enumerate(texts)], "doc_id long, text string, runs string, collapsed array<int>")
    rows = P.periodic_runs(docs.repartition(3)).collect()
    got = sorted(((r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in rows), key=lambda x: (x[0] is None, x))
    assert got == sorted([
        (0, [(0, 10, 2)], "a b c"), (0, [(0, 10, 2)], "a b c"), (1, [], ""), (2, [], ""), (3, [], ""), (4, [(0, 6, 1)], "x y y"), (6, [(0, 300_000, 1)], "w"),
    ]) + [(None, [], "no run here")]
    assert P.periodic_runs(docs.limit(0)).count() == 0


def test_planted_words(spark):
    def planted(i, text):
        w = (text or "").encode().split()
        h, n = zlib.crc32(str(i).encode()), len(w)
        if h % 10 or not n:
            return w
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        return [w[a + (k - a) % p] if k >= a else w[k] for k in range(n)]

    r = random.Random(8)
    texts = [" ".join(str(r.randrange(50)) for _ in range(r.randint(0, 80))) + r.choice(["", " ", "\n"]) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = docs.select("doc_id", _planted(F.col("doc_id"), F.col("text")).alias("t")).collect()
    assert {x.doc_id: x.t.encode().split() for x in got} == {i: planted(i, t) for i, t in enumerate(texts)}
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(300))
