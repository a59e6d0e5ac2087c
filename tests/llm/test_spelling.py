"""Neighbours at one edit against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from seqprep.llm import spelling
from seqprep.llm.queries import _slip


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def all_pairs(counts, ratio):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] is not None else None)
    return out


def run(spark, counts, ratio=10, extra=()):
    rows = [(w, n, "x", 1) for w, n in [*counts.items(), *extra]]
    x = spelling.variants(spark.createDataFrame(rows, "word string, n long, form string, id int").repartition(3), ratio)
    got = x.collect()
    assert len(got) == len({r.word for r in got})
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got}


@pytest.mark.parametrize("block", [1, 3, 50, 1 << 16])
def test_neighbours_against_all_pairs(spark, block, monkeypatch):
    monkeypatch.setattr(spelling.number_nodes, "__defaults__", (block,))
    r = random.Random(block)
    words = {"".join(r.choice("abÿ") for _ in range(r.randint(1, 6))) for _ in range(260)} | {"", "a" * 300, "a" * 301, "😀b", "b"}
    counts = {w: r.choice([1, 2, 20, 200, 2000, 20_000]) for w in sorted(words)}
    assert run(spark, counts) == all_pairs(counts, 10)
    if block == 3:
        assert run(spark, counts, 2) == all_pairs(counts, 2)


def test_ties_chains_and_odd_rows(spark):
    counts = {"wordone": 5, "wordtwo": 50, "wardone": 50, "wordine": 50, "wordines": 500, "wordiness": 5000}
    got = run(spark, {**counts, "wordone": 3}, extra=[("wordone", 2), (None, 9), ("nothing", None)])
    assert got == all_pairs(counts, 10)
    assert got["wordone"] == ("wardone", "wardone", 5, 2, 50)
    assert got["wordine"][:2] == ("wordines", "wordiness")
    assert run(spark, {}) == {}
    with pytest.raises(ValueError):
        run(spark, counts, 1)


def test_a_popular_word_with_many_variants(spark):
    base = "abcdefghij" * 3
    counts = {base: 10**6, **{base[:i] + c + base[i + 1 :]: 2 for i in range(len(base)) for c in "klmnopqrstuvwxyz"}}
    got = run(spark, counts)
    assert got[base][3] == len(counts) - 1 and all(v[1] == base for v in got.values())


def test_counts_of_changed_runs(spark):
    r = random.Random(2)
    pool = ["".join(r.choice("abcdÀÿ×Z") for _ in range(r.randint(5, 11))) for _ in range(60)]
    texts = [None, "", "  12 "] + [r.choice(" ,-\n").join(r.choice(pool) for _ in range(r.randint(0, 60))) for _ in range(80)] + [" ".join(pool * 2000)]
    docs = spark.createDataFrame([(None if i == 9 else i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n int")
    want = Counter()
    for i, t in enumerate(texts):
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if i == 9 else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 7:
                want[w] += 1
    got = spelling.count_words(docs.repartition(4), least=7, change=_slip).collect()
    assert {x.word: x.n for x in got} == want
    assert spelling.count_words(docs.limit(0)).count() == 0
