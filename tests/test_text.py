import random

from pyspark.sql import functions as F
import pytest

from seqprep.functions import phones as P
from seqprep.functions import symbols as S
from seqprep.functions import text as T
from seqprep.operators import joins as J
from seqprep.operators import mix as MX
from seqprep.plans.corpus_queries import letter_rules, lexicon


def one(spark, value, change):
    return spark.createDataFrame([(value,)], "v string").select(change(F.col("v"))).collect()[0][0]


@pytest.mark.parametrize("text, want", [
    ("Mr. Smith's $1,234.50 (he said: 'no') in the USA.", "mister smith-s one thousand two hundred thirty four dollars, fifty cents he said, no in the u s a"),
    ("Zürich--Straße; 3.14", "zurich,strasse, three point fourteen"),
    ("a , b  ,  c.", "a, b, c"),
    ("", ""),
    ("$1 and $0.01 and $0 and $1.2.3", "one dollar and one cent and zero dollars and one point two three dollars"),
    ("21st", "twenty one"),
    ("99999999999", "99999999999"),
])
def test_english_cleaners(spark, text, want):
    assert one(spark, text, T.english_cleaners) == want


def test_unreadable_is_null(spark):
    assert one(spark, "the 21st", lambda c: T.english_cleaners(c, "null")) is None
    assert one(spark, "12345678901", lambda c: T.english_cleaners(c, "null")) is None
    assert one(spark, "0000000000012", lambda c: T.english_cleaners(c, "null")) == "twelve"


@pytest.mark.parametrize("n, want", [
    (0, "zero"), (40, "fourty"), (123, "one hundred twenty three"), (1000, "one thousand"), (1001001, "one million one thousand one"),
    (999999999, "nine hundred ninety nine million nine hundred ninety nine thousand nine hundred ninety nine"), (1000000000, None), (-1, None),
])
def test_number_words(spark, n, want):
    assert spark.createDataFrame([(n,)], "n long").select(T.number_to_words(F.col("n"))).collect()[0][0] == want


def test_unknown_cleaner():
    with pytest.raises(ValueError):
        T.clean(F.lit("x"), ["nothing_like_it"])


def test_char_roundtrip(spark):
    text = "hello, world! it's a test-case."
    assert one(spark, text, S.text_to_ids)[-1] == 1
    assert one(spark, text, lambda c: S.ids_to_text(S.text_to_ids(c))) == text + "~"
    assert one(spark, "", S.text_to_ids) == [1]


def test_phone_ids(spark):
    assert one(spark, "@hh@ay! @dh@er", lambda c: S.ids_to_text(S.phones_to_ids(c), "phone")) == "@hh@ay! @dh@er ~"
    # a mark inside a word and a final dot lose the mark, not the phone
    assert one(spark, "@hh!@ay @dh@er.", lambda c: S.ids_to_text(S.phones_to_ids(c), "phone")) == "@hh@ay @dh@er ~"
    assert one(spark, "@hh@ay1 @dh", lambda c: S.ids_to_text(S.pause_phones_to_ids(c), "pause")) == "@hh@ay1@dh ~"


def test_braced(spark):
    got = one(spark, "on {HH AW1} st", S.braced_phones)
    assert [(r.id, r.is_phone) for r in got] == [(16, 0), (15, 0), (35, 0), (17, 1), (6, 1), (35, 0), (20, 0), (21, 0), (1, 0)]


def test_vocabulary(spark):
    sizes = {r.kind: r["count"] for r in S.vocabulary(spark).groupBy("kind").count().collect()}
    assert sizes == {"char": 36, "phone": 49, "pause": 46}


def test_letter_rules(spark):
    words = spark.createDataFrame([("thing",), ("cats",), ("school",), ("été",), ("thing",)], "word string")
    got = {r.word: r.phones for r in P.rule_g2p(words, letter_rules(spark)).collect()}
    assert got["thing"] == ["TH", "IH NG"]
    assert got["été"] is None
    assert len(got) == 4


def test_letter_rule_contexts(spark):
    lines = spark.createDataFrame(list(enumerate(["#[S]=/Z/;", "[S]=/S/;", "[A]T=/AE/;", "[A]=/EY/;", "[T]=/T/;", "[B]&=/P/;", "[B]=/B/"])), "line_no long, value string")
    rules = P.parse_letter_rules(lines)
    words = spark.createDataFrame([("AS",), ("SA",), ("AT",), ("ATA",), ("BS",), ("BA",)], "word string")
    got = {r.word: r.phones for r in P.rule_g2p(words, rules).collect()}
    # without context symbols the rest of the word must be exactly the right context
    assert got == {"AS": ["EY", "Z"], "SA": ["S", "EY"], "AT": ["AE", "T"], "ATA": ["EY", "T", "EY"], "BS": ["P", "S"], "BA": ["B", "EY"]}


def test_hyphenate(spark):
    # the few patterns that break this word
    pats = P.parse_hyphen_patterns(spark.createDataFrame([(p,) for p in ["hy3ph", "he2n", "hena4", "hen5at", "1na", "n2at", "1tio", "2io", "o2n"]], "pattern string"))
    words = spark.createDataFrame([("hyphenation",), ("word",), ("table",)], "word string")
    exc = spark.createDataFrame([("table", ["ta", "ble"])], "word string, pieces array<string>")
    got = {r.word: r.pieces for r in P.hyphenate(words, pats, exc).collect()}
    assert got == {"hyphenation": ["hy", "phen", "ation"], "word": ["word"], "table": ["ta", "ble"]}


def test_lookup_order(spark):
    words = spark.createDataFrame([("The", "the"), ("xx", "the"), ("xx", "yy")], "raw_word string, word string")
    got = [r.phones for r in P.lookup_pronunciation(words, lexicon(spark)).collect()]
    assert sorted(map(str, got)) == ["@dh@ah", "@dh@iy", "None"]


def test_pronounce(spark):
    df = spark.createDataFrame([(1, "The cats, in the house."), (2, "no cats")], "id long, text string")
    marked = {r.id: r.phones for r in MX.pronounce(df, "id", "text", lexicon(spark), letter_rules(spark), pause_marks=False).collect()}
    assert marked[1] == "@dh@ah @k@ae@t@s,@ih@n @dh@ah @hh@aw@z@eh.~"
    assert marked[2] == "@n@ow @k@ae@t@s"
    paused = {r.id: r.phones for r in MX.pronounce(df, "id", "text", lexicon(spark), letter_rules(spark)).collect()}
    assert paused[1].endswith(" ~") and "," not in paused[1]


def test_pronounce_inside_a_text_as_by_joins(spark, monkeypatch):
    words = ["the", "The", "cats,", "house.", "x-ray", "...", "don't", "qq!", "7", "of", "thing?", "a:b", "É", "\"in\"", "ß", ""]
    rng = random.Random(3)
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 40]))) for _ in range(60)] + [None, "", "  ", "!", "12.", "the", "the cats? "]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "the house."), (5, "of cats"), (5, "the, 3 cats")]
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    lex = lexicon(spark)
    alone = df.where("id is null or id <> 5")
    for rules, marks in ((letter_rules(spark), False), (None, True)):
        one, other = (sorted((str(r.id), r.phones) for r in MX.pronounce(alone, "id", "text", lex, rules, marks, size).collect()) for size in (1 << 20, 0))
        assert one == other and len(one) > 20
    # rows with one key make one text together, as before
    pair = MX.pronounce(df.where("id = 5"), "id", "text", lex).collect()
    assert len(pair) == 1 and "@ah@v" in pair[0].phones and "@dh@ah" in pair[0].phones
    nulls = spark.createDataFrame([(None, "the cats"), (None, "the house"), (1, "cats")], "id long, text string")
    got = {r.id: r.phones for r in MX.pronounce(nulls, "id", "text", lex, letter_rules(spark)).collect()}
    assert got[1] == "@k@ae@t@s" and got[None].count("@dh@ah") == 2 and len(got) == 2
    # words of rows with a key of their own are never taken apart
    monkeypatch.setattr(MX, "_joined_pronounce", None)
    assert MX.pronounce(alone, "id", "text", lex).count() == len(one)


def test_mix_modes(spark):
    df = spark.createDataFrame([(1, "the cat is on", "the cat is on"), (2, "cat", "cat")], "id long, clean string, raw string")
    chunks = MX.word_chunks(MX.text_words(df, "id", "clean", "raw"), lexicon(spark), "id").cache()
    back = lambda m: {r.id: r.t for r in m.select("id", S.unmix(F.col("ids"), F.col("mask")).alias("t")).collect()}
    assert back(MX.mix_representations(chunks, "id", "chars_only")) == {1: "the cat is on~", 2: "cat~"}
    assert back(MX.mix_representations(chunks, "id", "blended_pref")) == {1: "@dh@ah cat @ih@z @aa@n~", 2: "cat~"}
    both = {r.id: len(r.phone_ids) for r in MX.mix_representations(chunks, "id", "both").collect()}
    assert both == {1: 2 + 1 + 0 + 1 + 2 + 1 + 2, 2: 0}
    a, b = (MX.mix_representations(chunks, "id", "blended", 5).orderBy("id").collect() for _ in range(2))
    assert a == b
    for row in a:
        assert len(row["ids"]) == len(row["mask"]) and row["ids"][-1] == 1
    with pytest.raises(ValueError):
        MX.mix_representations(chunks, "id", "other")


ODD = ["", " ", "@hh@ay! @dh@er.", "!@aa", "?", "@a!b@zh,,@ ", "é@aa1@b23 x@~@_", "@aa  @ch1!", None, "@hh@ay! @hh@ay!"]


@pytest.mark.parametrize("encode, symbols, kind", [
    (S.phones_to_ids, S.phone_symbols, "phone"), (S.pause_phones_to_ids, S.pause_symbols, "pause")])
def test_ids_of_texts_word_by_word(spark, encode, symbols, kind):
    rows = spark.createDataFrame([(t,) for t in ODD * 3], "t string").coalesce(1)
    got = rows.select(encode(F.col("t")).alias("got"), F.concat(S.symbol_ids(symbols(F.col("t")), kind), F.array(F.lit(1))).alias("want"))
    assert all(r.got == r.want for r in got.collect())
    assert "transform(" not in rows.select(encode(F.col("t")))._jdf.queryExecution().toString()


def test_symbol_lookup_of_batches(spark):
    lists = [["a", "aa", None, "~", "_", "zz", " "], [], None, ["z"], ["é", "!"]]
    rows = spark.createDataFrame([(s,) for s in lists], "s array<string>").coalesce(1)
    for kind in S.VOCABULARY:
        got = rows.select(J.symbol_lookup(F.col("s"), kind).alias("got"), S.symbol_ids(F.col("s"), kind).alias("want")).collect()
        assert all(r.got == r.want for r in got)
    assert "array_position" not in rows.select(J.symbol_lookup(F.col("s"), "char"))._jdf.queryExecution().toString()


def test_lines_of_letter_rules_leave_python_as_texts(spark):
    spell = P.rulebased_cleaner(letter_rules(spark))
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["the cat", "", None, "x 9 b", "?", "9"] * 200)], "i int, t string").coalesce(1)
    out = rows.select("i", spell(F.col("t")).alias("p"))
    assert "array<array<string>>" not in out._jdf.queryExecution().toString() and "array_join" not in out._jdf.queryExecution().toString()
    got = [r.p for r in out.orderBy("i").collect()]
    assert got == ["th&eh^k&ae&t", "", None, "k s^b", "", ""] * 200


def test_mixes_of_words_in_any_order(spark):
    """Words of many texts, far apart and with shared numbers, against plain lists."""
    draw = random.Random(3)
    rows = [(k, i, [draw.randint(2, 36) for _ in range(draw.randint(0, 4))], [draw.randint(2, 45) for _ in range(draw.choice([0, 0, 2, 3]))])
            for k in [*range(30), None] for i in [*range(k or 4), *([1, 1] if k == 7 else [])]]
    draw.shuffle(rows)
    chunks = spark.createDataFrame(rows, "id long, idx int, chars array<int>, phones array<int>").repartition(5)
    texts = {}
    for k, i, c, p in sorted(rows, key=lambda r: r[1:]):
        texts.setdefault(k, []).append((c, p))

    def joined(parts, sep):
        return [v for j, p in enumerate(parts) for v in ([sep] if j else []) + p]

    for mode in MX.MODES:
        out = MX.mix_representations(chunks, "id", mode, 5)
        assert "sort_array" not in out._jdf.queryExecution().toString() or mode == "blended"
        got = {r[0]: (r[1], r[2]) for r in out.collect()}
        assert set(got) == set(texts)
        flags = {r[0]: r[1] for r in spark.createDataFrame([(k, len(w)) for k, w in texts.items()], "id long, n int").select("id", MX.blend_flags(F.col("n"), 5, F.col("id"))).collect()}
        for k, words in texts.items():
            if mode == "both":
                assert got[k] == (joined([c for c, _ in words], 35), joined([p for _, p in words], 41))
                continue
            f = {"chars_only": [0] * len(words), "phones_only": [1] * len(words), "blended_pref": [int(bool(p)) for _, p in words], "blended": flags[k]}[mode]
            parts = [p if p and g else c for (c, p), g in zip(words, f)]
            assert got[k] == (joined(parts, 35) + [1], joined([[g] * len(x) for x, g in zip(parts, f)], 0) + [int(mode == "phones_only")])
