"""Letter rules and hyphen patterns: the broadcast kernels and the joins of large tables against plain loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from seqprep.functions import phones as P
from seqprep.plans import all_queries
from seqprep.plans.corpus_queries import PATTERNS

rng = random.Random(11)
WORDS = sorted({"".join(rng.choice("abcdeiorst") for _ in range(rng.randint(1, 9))) for _ in range(300)} | {"", "a+b", "über", "e" * 40})


def table(n, letters="ABCDEIORST"):
    """Rules of random contexts, short ones at the end so that most words can be spelled."""
    out = []
    for _ in range(n):
        piece = lambda most: "".join(rng.choice(letters + "#*,$%&@^+:") for _ in range(rng.randint(0, most)))
        out.append((piece(2), "".join(rng.choice(letters) for _ in range(rng.randint(1, 3))), piece(2)))
    out += [("", c, "") for c in letters if c != "T"] + [("", "+", ""), ("", "", "A")]
    return [(i, *r, f"p{i}") for i, r in enumerate(out)]


def spelled(word, rules):
    word, at, out = word.upper(), 0, []
    pattern = lambda t: "".join(P.CONTEXT.get(c, re.escape(c)) for c in t)
    while at < len(word):
        for _, before, center, after, phones in rules:
            end = at + len(center)
            if not center or word[at:end] != center:
                continue
            left, right = word[max(at - len(before), 0) : at], word[end:]
            if any(c in P.CONTEXT for c in before + center + after):
                ok = (not before or re.match(pattern(before), left)) and (not after or re.match(pattern(after), right))
            else:
                ok = (not before or left == before) and (not after or right == after)
            if ok:
                out.append(phones)
                at = end
                break
        else:
            return None
    return out


@pytest.fixture(scope="module")
def words(spark):
    return spark.createDataFrame([(w,) for w in WORDS + WORDS[:50]] + [(None,)], "word string").repartition(3)


@pytest.mark.parametrize("n", [30, 12_000])
def test_rules_of_any_number(spark, words, n):
    rows = table(n)
    rules = spark.createDataFrame(rows, "rank int, before string, center string, after string, phones string").repartition(4)
    want = {w: spelled(w, rows) for w in WORDS}
    want[None] = None
    assert sum(v is not None for v in want.values()) > 40
    for bytes_ in (P.TABLE_BYTES, 0):
        got = P.rule_g2p(words, rules, max_bytes=bytes_).collect()
        assert len(got) == len(want) and {r.word: r.phones for r in got} == want


def test_texts_with_rules_of_any_number(spark):
    rows = table(5_200)
    rules = spark.createDataFrame(rows, "rank int, before string, center string, after string, phones string")
    texts = spark.createDataFrame([(1, "sabot, toast. 'coast'"), (2, ""), (3, None), (4, "t" * 3 + " stereo")], "id int, t string")
    broadcast = {r.id: r.phones for r in P.rulebased_g2p(texts, "id", "t", rules).collect()}
    joined = {r.id: r.phones for r in P.rulebased_g2p(texts, "id", "t", rules, max_bytes=0).collect()}
    assert broadcast == joined and broadcast[3] is None and broadcast[2] == "" and "&" in broadcast[1]


def broken(word, patterns):
    points = {}
    for p in patterns:
        letters, slots = re.sub("[0-9]", "", p), re.split("[.a-z]", p)
        for s in range(len(word) + 2):
            if f".{word}."[s : s + len(letters)] == letters:
                for i, v in enumerate(slots):
                    if v:
                        points[s + i] = max(points.get(s + i, 0), int(v))
    cuts = [0, *sorted(p - 1 for p, v in points.items() if v % 2 and 2 < p <= len(word) - 1), len(word)] if len(word) > 4 else [0, len(word)]
    return [word[a:b] for a, b in zip(cuts, cuts[1:])]


def test_hyphens_by_automaton_and_join(spark, words):
    patterns = set()
    while len(patterns) < 400:
        letters = rng.choice(["", "."]) + "".join(rng.choice("abcdeiorst") for _ in range(rng.randint(1, 4))) + rng.choice(["", "", "."])
        at = rng.randint(1, len(letters))
        patterns.add(letters[:at] + str(rng.randint(1, 5)) + letters[at:])
    parsed = P.parse_hyphen_patterns(spark.createDataFrame([(p,) for p in patterns], "pattern string"))
    want = {w: broken(w, patterns) for w in WORDS}
    assert sum(len(v) > 2 for v in want.values()) > 20
    for bytes_ in (P.TABLE_BYTES, 0):
        got = {r.word: r.pieces for r in P.hyphenate(words.where("word is not null"), parsed, max_bytes=bytes_).collect()}
        assert got == want
    listed = spark.createDataFrame([("eeeee" * 8, ["eee", "ee"])], "word string, pieces array<string>")
    got = {r.word: r.pieces for r in P.hyphenate(words, parsed, listed).where(F.col("word").isNotNull()).collect()}
    assert got == {**want, "e" * 40: ["eee", "ee"]}


def test_query_returns_every_word_with_its_pieces(spark, tmp_path):
    texts = [(1, "Cabolatin notation, cat"), (2, "cat renting"), (3, None), (4, "")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.word: r.pieces for r in all_queries()[0]["phones_hyphenate"](spark, str(tmp_path)).collect()}
    assert got == {w: "-".join(broken(w, PATTERNS)) for w in ("cabolatin", "notation", "cat", "renting")}
