"""The training-data operators against brute force on small rows with nulls, empty and long texts, ties and copies."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqprep.llm import compact_windows, hmm_lm, line_crf, line_rules, packing, permutation_index, simhash, style_tree, toxicity
from seqprep.llm.bpe import Encoder, decode_ids, encode_texts, read_vocabulary, round_trip
from seqprep.llm.queries import tokenizer

SCHEMA = "doc_id long, text string, source string, _text string, _row long, score double"
rng = random.Random(5)
VOCAB = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(600)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) for _ in range(n))


LONG = prose(4000, 1)
PASSAGE = prose(60, 2)
TEXTS = [
    "", None, "   \n\t ", "one", "Two words", prose(80, 3), prose(80, 3), prose(80, 3) + " extra", LONG, prose(90, 4) + " " + PASSAGE,
    PASSAGE + "\n" + prose(70, 5), "x" * 5000, "a b c d " * 40, "same line\nsame line\n\nother # line |", "<|endoftext|> tail <|endoftext|>", "naïve Ünïcode  　 text",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["h", None][i % 2], "clash", 7, 0.5) for i, t in enumerate(TEXTS)] + [(None, "null id " + prose(60, 6), "h", None, None, None), (5, TEXTS[5], "h", "again", 1, 1.0)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer())


def test_bpe_round_trip(spark, docs, empty, reference):
    got = round_trip(docs, "doc_id", "text", tokenizer()).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is not None:
            ids = reference.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids
            assert r.n_tokens == len(ids)
            assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256(reference.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = decode_ids(encode_texts(docs, "doc_id", "text", tokenizer()), "doc_id", "ids", tokenizer())
    assert sorted(r.text for r in back.collect()) == sorted((t or "") for t in [*TEXTS, "null id " + prose(60, 6), TEXTS[5]])
    assert round_trip(empty, "doc_id", "text", tokenizer()).count() == 0


def test_bpe_odd_white_space(reference):
    coder = Encoder(read_vocabulary(tokenizer()))
    for t in ["a  b", " x", "x \n y", "it's I'll 12 345", "\x1c a\x1d b", "́ x", "\r\n\r\n b", "a\x85b \x85 c", "​  z", "é" * 99]:
        assert list(memoryview(coder.encode(t)).cast("I")) == reference.encode(t, add_special_tokens=False).ids


def test_packing_is_gapless_and_within_capacity(docs, empty, reference):
    got = packing.pack_documents(docs, "doc_id", "text", tokenizer(), capacity=64, keep_ids=True, shard_pieces=40).toPandas()
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.length.sum() <= 64 and list(g.offset) == [0, *g.length.cumsum()[:-1]]
    for i, g in got[got.doc_id.notna() & (got.doc_id != 5)].groupby("doc_id"):
        ids = reference.encode(TEXTS[int(i)] or "", add_special_tokens=False).ids + [2]
        g = g.sort_values("piece")
        assert [x for part in g.ids for x in part] == ids and list(g.length[1:]) == [64] * (len(g) - 1)
        assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in g.itertuples())
    assert packing.pack_documents(empty, "doc_id", "text", tokenizer()).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_keeps_every_capacity(rule):
    length = np.sort(np.random.default_rng(0).integers(1, 100, 500))[::-1]
    bins, _ = packing.best_fit(length, (100, 3, 6000.0), rule=rule)
    for b in np.unique(bins):
        mine = length[bins == b]
        assert mine.sum() <= 100 and len(mine) <= 3 and ((mine**2).sum() <= 6000 or len(mine) == 1)


def test_line_rules_counts(docs, empty):
    got = line_rules.line_rules(docs).toPandas()
    word = re.compile(r"[^\x20\x09-\x0D]+")
    for r in got[got.doc_id.notna()].itertuples():
        t = TEXTS[int(r.doc_id)] or ""
        w = word.findall(t)
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        count = collections.Counter(grams)
        covered = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if word.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
    assert line_rules.line_rules(empty).count() == 0


def test_line_rules_remove_boilerplate_but_not_copies(spark):
    rows = [(i, "Read More  here\n" + prose(60, 100 + i), "h") for i in range(30)]
    rows += [(100 + i, prose(8, 7) + "\n" + prose(60, 8), "h") for i in range(200)]
    rows += [(400 + i, "read more here\n" * 40 + prose(10, 900 + i).replace(" ", "\n"), "h") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = line_rules.line_rules(df, max_repeat=1000).toPandas().set_index("doc_id")
    assert got.loc[0:29].kept.all() and (got.loc[0:29].removed_words == 3).all()
    assert got.loc[100:299].kept.all() and (got.loc[100:299].removed_words == 0).all()
    assert not got.loc[400:404].kept.any()
    cleaned = {r.doc_id: r.text for r in line_rules.clean_documents(df, max_repeat=1000).collect()}
    assert cleaned[0] == prose(60, 100) and 400 not in cleaned


def test_simhash_components(spark, docs, empty):
    base = prose(200, 11).split()
    near = [" ".join(base[:i] + ["zz"] + base[i + 1 :]) for i in range(0, 200, 4)]
    rows = [(i, t) for i, t in enumerate(near)] + [(100 + i, prose(50, 200 + i)) for i in range(40)] + [(500, None), (501, ""), (502, near[0]), (None, near[1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.near_duplicates(df, shard=8).collect()
    assert len(got) == len(rows)
    prints = {t: simhash.fingerprint(t) for _, t in rows}
    assert simhash.fingerprint(None) == 0
    values = sorted(set(prints.values()))
    group = {v: v for v in values}
    for _ in values:
        for a in values:
            group[a] = min(group[b] for b in values if (a ^ b).bit_count() <= 3)
    want = {}
    for i, t in rows:
        if i is not None:
            want.setdefault(group[prints[t]], []).append(i)
    for r in got:
        assert r.component == min(want[group[r.fp & (1 << 64) - 1]])
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.where("text is null or trim(text) = ''").count() <= 1


def test_fingerprint_bits():
    import xxhash

    words = "The quick BROWN fox jumps".lower().split()
    h = [xxhash.xxh64(" ".join(words[i : i + 3]).encode(), 42).intdigest() for i in range(3)]
    assert simhash.fingerprint("The quick\tBROWN fox\njumps") == sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > 3)


@pytest.mark.parametrize("n", [9, 60, 700])
def test_cartesian_windows(n):
    v = np.random.default_rng(n).integers(0, 1 << 63, n).astype(np.uint64)
    cut, width = n // 3, 10
    first, last = np.where(np.arange(n) < cut, 0, cut), np.where(np.arange(n) < cut, cut - 1, n - 1)
    got = set(zip(*(x.tolist() for x in compact_windows.cartesian_windows(*compact_windows.sliding_least(v, width), first, last, width))))
    key, want = v >> np.uint64(32), set()
    for c in range(n):
        l = r = c
        while l > first[c] and key[l - 1] > key[c]:
            l -= 1
        while r < last[c] and key[r + 1] >= key[c]:
            r += 1
        if r - l + 1 >= width:
            want.add((c, int(l), int(r)))
    assert got == want


def test_passages_are_found_and_cut(docs, empty):
    got = compact_windows.duplicate_passages(docs).toPandas()
    shared = got[got.doc_id.isin([9, 10]) & got.source.isin([9, 10])]
    assert len(shared) == 1 and shared.iloc[0].similarity == 1.0 and shared.iloc[0].end_word - shared.iloc[0].start_word == 60
    assert {(r.doc_id, r.source) for r in got[got.end_word - got.start_word >= 80].itertuples()} & {(6, 5), (6.0, 5.0)}
    left = compact_windows.remove_passages(docs)
    assert left.columns == docs.columns
    texts = {r.doc_id: r.text for r in left.collect()}
    assert (PASSAGE in texts[9]) + (PASSAGE in texts[10]) == 1 and texts[8] == LONG and texts[0] == "" and texts[1] is None
    assert compact_windows.duplicate_passages(empty).count() == 0


def test_permutation_index(spark):
    g = np.random.default_rng(3)
    x = g.normal(size=(400, 16))
    x[50:150] = x[50]
    rows = [(i, [float(v) for v in r], 1) for i, r in enumerate(x)] + [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [1.0], 1), (None, [1.0] * 16, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got = permutation_index.nearest(df, "vec_id", "embedding", F.col("id") % 20 == 0, block=100, query_block=8, least=64).toPandas()
    hit = 0
    for i, g in got.sort_values("rank").groupby("query_id"):
        s = x @ x[i]
        s[i] = -1e9
        best = np.lexsort((np.arange(400), -s))[:20]
        hit += len(set(best) & set(g.vec_id))
        assert list(g["rank"]) == list(range(1, 21)) and np.allclose(g.score, s[g.vec_id.to_numpy()], atol=1e-12)
    assert got.query_id.nunique() == 20 and hit >= 0.9 * 400
    assert permutation_index.nearest(df.limit(0), "vec_id", "embedding", F.lit(True)).count() == 0


def test_toxicity_and_quality_learn(spark, docs, empty):
    r = random.Random(1)
    sample = []
    for i in range(800):
        words = prose(40, 30000 + i).split()
        if i % 2:
            words[r.randrange(40)] = r.choice(["blockhead", "nitwit"])
        sample.append((" ".join(words), i % 2))
    model = toxicity.train(sample, epochs=12, batch=32)
    df = spark.createDataFrame([(1, prose(40, 9000)), (2, prose(20, 9001) + " Nitwit! " + prose(20, 9002)), (3, None), (4, "")], "doc_id long, text string")
    got = {x.doc_id: x.score for x in toxicity.score(df, "doc_id", "text", model).collect()}
    assert got[2] > 0.3 > got[1] and got[3] == got[4] < 0.3
    assert toxicity.score(docs, "doc_id", "text", model).count() == docs.count() and toxicity.score(empty, "doc_id", "text", model).count() == 0
    assert toxicity.train([])["slope"] == 1.0
    junk = [("BUY!! NOW!! " * 20 if i % 2 == 0 else prose(60, i), i % 2) for i in range(80)]
    crf = line_crf.train(junk)
    df = spark.createDataFrame([(1, prose(60, 77)), (2, "BUY!! NOW!! " * 9), (3, None), (4, "")], "doc_id long, text string")
    got = {x.doc_id: x.score for x in line_crf.score(df, "doc_id", "text", crf).collect()}
    assert got[1] > 0.5 > got[2] and got[3] == got[4]
    assert line_crf.score(docs, "doc_id", "text", crf).count() == docs.count()


def test_crf_marginals_match_enumeration():
    import itertools

    g = np.random.default_rng(2)
    unary, trans = g.normal(size=(7, 2)), g.normal(size=(2, 2))
    doc = np.array([0, 0, 0, 0, 1, 2, 2])
    p, _, log = line_crf.marginals(unary, doc, 3, trans)
    for d in range(3):
        rows = np.flatnonzero(doc == d)
        weights = {y: np.exp(sum(unary[i, s] for i, s in zip(rows, y)) + sum(trans[a, b] for a, b in zip(y, y[1:]))) for y in itertools.product((0, 1), repeat=len(rows))}
        total = sum(weights.values())
        assert np.isclose(np.log(total), log[d])
        for k, i in enumerate(rows):
            assert np.isclose(p[i, 1], sum(w for y, w in weights.items() if y[k] == 1) / total)


PAGE = """<html><head><title>t</title></head><body><header>top</header><nav>menu</nav><div class="ad">buy</div><article><h1>A &amp; B</h1>
<p>One <b>two<br>three<p>four&nbsp;five<ul><li>x<li>y</ul><div class="comments">no</div></article><footer>f</footer><script>if (a<b) "</p>"</script></body></html>"""


def test_style_tree(spark):
    rows = [(1, "http://a.x/1", PAGE, 1), (2, "odd", None, 1), (None, None, "", 1), (4, "http://a.x/2", "plain &lt;b&gt; text", 1), (5, "http://a.x/3", "<div><p>" * 2000 + "deep", 1)]
    rows += [(10 + i, f"http://s.y/{i}", f"<body><div class='strip'>always the same</div><div class='body'><p>{prose(20, i)}</p></div></body>", 1) for i in range(30)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = {r.page_id: r for r in style_tree.main_text(df).collect()}
    assert got[1].text == "A & B\nOne two three\nfour five\nx\ny" and got[1].n_chars == len(got[1].text)
    assert got[2].text == got[None].text == "" and got[4].text == "plain <b> text" and got[5].text == "deep"
    assert all(got[10 + i].text == prose(20, i) for i in range(30))
    assert style_tree.main_text(df.limit(0)).count() == 0


def test_crf_transitions_are_the_gradient():
    g = np.random.default_rng(8)
    unary, trans = g.normal(size=(7, 2)), g.normal(size=(2, 2))
    doc = np.array([0, 0, 0, 0, 1, 2, 2])
    share = 1 / np.bincount(doc)
    _, pairs, _ = line_crf.marginals(unary, doc, 3, trans, share[doc])
    for a, b in ((0, 0), (0, 1), (1, 0), (1, 1)):
        step = np.zeros((2, 2))
        step[a, b] = 1e-5
        up, down = (line_crf.marginals(unary, doc, 3, trans + s)[2] @ share for s in (step, -step))
        assert np.isclose(pairs[a, b], (up - down) / 2e-5, atol=1e-6)


ARTICLE = "<h1>Title</h1><p>First words.</p><p>More words.</p>"


@pytest.mark.parametrize(
    "page",
    [
        "<form id='aspnetForm'><article>{}</article><label>name</label></form>", "<form id='all'><div>{}</div></form>", "<div class='content no-sidebar'>{}</div>",
        "<div id='page' class='has-menu'><article>{}</article></div>", "<div class='share-price-report'>{}</div>", "<div class='menu'><main>{}</main></div>",
        "<form><input name='q'><p>Search</p></form><div class='entry-header'></div>{}<div id='comments'><article><h1>re</h1>bad</article></div>",
        "<form class='x'><div class='reader comment-list'><article>bad</article></div></form>{}", "<div class='cookie-banner wrap'>bad</div>{}<div class='siteFooter'>bad</div>",
        "{}<div class='x'><span class='ad'><p>bad</p></span></div><aside><h1>bad</h1></aside>",
    ],
)
def test_style_tree_keeps_articles_in_named_wrappers(page):
    texts = style_tree.read_page(f"<body>{page.format(ARTICLE)}</body>")[3]
    assert "bad" not in texts and "Search" not in texts and texts[:3] == ["Title", "First words.", "More words."]


def test_style_tree_importance_by_brute_force(spark):
    """Entropies of a small site counted page by page; an equal page counts once."""
    import math

    sites = [f"<body><div class='top'>same</div><div class='text'><p>{prose(9, i % 9)}</p>{'<ul><li>x</li></ul>' * (i % 3)}</div></body>" for i in range(12)]
    df = spark.createDataFrame([(i, "http://s.y/1", h) for i, h in enumerate([*sites, sites[0]])], "page_id long, url string, html string")
    styles, texts = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for page in sorted(set(sites)):
        found = style_tree.read_page(page)[4]
        for node, style in {(n, s) for n, s, _ in found}:
            styles[node][style] += 1
        for node, text in {(n, t) for n, _, t in found}:
            texts[node][text] += 1
    want = {}
    for node, seen in styles.items():
        m = sum(seen.values())
        if m < style_tree.MIN_PAGES:
            want[node] = 1.0
            continue
        entropy = -sum(c / m * math.log(c / m, m) for c in seen.values())
        same = sum(math.log(c, m) for c in texts[node].values()) / len(texts[node])
        want[node] = (1 - style_tree.MIX) * entropy + style_tree.MIX * (1 - min(same, 1.0))
    got = {r.node: r.importance for r in style_tree.importance(df)[0].collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert min(got.values()) < style_tree.THRESHOLD < max(got.values())


def test_hmm_likelihood_is_exact():
    g = np.random.default_rng(4)
    model = hmm_lm.first_model(6, 3)
    lengths = np.array([1, 5, 300, 129])
    symbols = g.integers(0, 6, lengths.sum())
    got = hmm_lm.likelihood(symbols, lengths, model)
    for want, part in zip(got, np.split(symbols, np.cumsum(lengths)[:-1])):
        state, log = model["start"][0] * model["emit"][part[0]], 0.0
        for s in part[1:]:
            log += np.log(state.sum())
            state = (state / state.sum()) @ model["move"] * model["emit"][s]
        assert np.isclose(want, log + np.log(state.sum()))


def test_hmm_scores(docs, empty):
    train = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(7)) != 2
    got = hmm_lm.score_documents(docs, "doc_id", "text", train, states=2, rounds=2).toPandas()
    tokens = lambda t: (t or "").encode().lower().split() + [b"\n"]
    count = collections.Counter()
    rows = [*enumerate(TEXTS), (None, "null id " + prose(60, 6)), (5, TEXTS[5])]
    for i, t in rows:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2:
            count.update(tokens(t))
    total, types = sum(count.values()), len(count)
    assert len(got) == len(rows) and (got.train_tokens == total).all()
    for r in got[got.doc_id.notna()].itertuples():
        w = tokens(TEXTS[int(r.doc_id)])
        assert r.n_tokens == len(w) and r.n_known == sum(x in count for x in w)
        assert np.isclose(r.base_score, sum(np.log10((count[x] + 1) / (total + types + 1)) for x in w)) and r.score < 0
    assert hmm_lm.score_documents(empty, "doc_id", "text", train, states=2, rounds=1).count() == 0


def edited(passage, changes, seed):
    """The passage with that many words changed."""
    r, words = random.Random(seed), passage.split()
    for i in r.sample(range(len(words)), changes):
        words[i] = f"edit{seed}x{i}"
    return " ".join(words)


def with_source(texts):
    """Texts (by number) of which an earlier one (by hash) has a similar passage, over all pairs."""
    import itertools

    import xxhash

    from seqprep.llm.common import Powers, Texts
    import pyarrow as pa

    t = Texts(pa.array(texts), Powers(), lower=True)
    grams, doc, _ = compact_windows._shingles(t)
    parts = [grams[doc == i] for i in range(len(texts))]
    rank = [xxhash.xxh64(x.encode(), 42).intdigest() for x in texts]
    rank = [x - (1 << 64) if x >> 63 else x for x in rank]
    out = set()
    for i, j in itertools.permutations(range(len(texts)), 2):
        if rank[i] < rank[j] and j not in out and compact_windows.same_passages(parts[i], parts[j], 46, 0.8):
            out.add(j)
    return out


def found_rows(spark, texts, parts):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        return {r.doc_id for r in compact_windows.duplicate_passages(df).select("doc_id").distinct().collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_passage_of_a_third_of_the_texts_over_many_parts(spark):
    passage = prose(52, 7000)
    texts = [prose(30, 7100 + i) + " " + (passage + " " if i % 3 == 0 else "") + prose(30, 7400 + i) for i in range(300)]
    assert found_rows(spark, texts, 61) == with_source(texts)


@pytest.mark.parametrize("group,groups,changes", [(2, 60, 1), (3, 40, 1), (150, 1, 1)])
def test_edited_passages_against_all_pairs(spark, group, groups, changes):
    texts = [
        prose(25, 8000 + g * 1000 + i) + " " + edited(prose(50 + (g + i) % 11 if group < 10 else 56, 9000 + g), changes, i) + " " + prose(25, 8500 + g * 1000 + i)
        for g in range(groups) for i in range(group)
    ]
    want, got = with_source(texts), found_rows(spark, texts, 8)
    print("recall", len(got & want), len(want), got - want)
    assert got <= want and len(got & want) >= (0.97 if group < 10 else 0.5) * len(want)


def test_lines_that_occur_together_and_lines_of_copies(spark):
    rows = [(i, f"Top of the page\n{prose(60, 5000 + i)}\nAll rights reserved", "h") for i in range(30)]
    rows += [(100 + i, f"share this\n{prose(60, 5100 + i)}", "c") for i in range(20)]
    rows += [(200 + i, f"share this\n{prose(60, 5200)}", "c") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = line_rules.line_rules(df).toPandas().set_index("doc_id")
    assert (got.loc[0:29].removed_words == 7).all() and (got.loc[100:499].removed_words == 2).all()


def test_pipeline_stages_on_planted_rows(spark, tmp_path):
    """Copies leave one document, a shared passage stays once, unfit and null texts go, clean texts come back word by word."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    clean = labels.where("toxic = 0 and quality = 1").select("doc_id")
    texts = [r.text for r in docs.where("lang = 'en'").join(clean, "doc_id", "left_semi").orderBy("doc_id").collect()]
    words = sorted({w for t in texts for w in re.findall(r"\b[a-z]+\b", t)})
    r = random.Random(9)

    def some(n):
        return " ".join(r.choice(words) for _ in range(n))

    copy, passage = some(120), some(70)
    planted = {10**6 + i: t for i, t in enumerate([copy, copy, copy.replace(copy.split()[60], "of", 1), some(90) + " " + passage, passage + " " + some(90)])}
    apart = {10**6 + 10 + i: some(n) for i, n in enumerate([60, 200, 3000])}
    unfit = {10**6 + 20: "", 10**6 + 21: None, 10**6 + 22: some(30), 10**6 + 23: "one two three four " * 40}
    rows = [(i, t, "en", "planted", len(t or ""), "clash", i) for i, t in {**planted, **apart, **unfit}.items()] + [(None, some(80), None, None, None, None, None)]
    extra = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _text string, _row long")
    docs.withColumn("doc_id", F.col("doc_id").cast("long")).unionByName(extra, allowMissingColumns=True).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))

    stages = [n for n, _ in corpus_pipeline.STAGES]
    assert stages == ["toxicity", "quality_rules", "simhash_near_dedup", "substring_dedup", "best_fit_packing"]
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    decode = Tokenizer.from_file(tokenizer()).decode
    back = {}
    for key, g in got[got.doc_id >= 10**6].groupby("doc_id"):
        ids = [x for part in g.sort_values("piece").ids for x in part]
        assert ids[-1] == 2 and list(g.sort_values("piece").start) == [0, *g.sort_values("piece").length.cumsum()[:-1]]
        back[key] = decode(ids[:-1], skip_special_tokens=False)
    assert not back.keys() & unfit.keys()
    assert {k: back.get(k) for k in apart} == apart
    assert len(back.keys() & {10**6, 10**6 + 1, 10**6 + 2}) == 1
    middle = " ".join(passage.split()[5:65])
    assert sum(middle in back[k] for k in (10**6 + 3, 10**6 + 4)) == 1
    assert planted[10**6 + 3][: -len(passage)].strip()[:300] in back[10**6 + 3] and planted[10**6 + 4][len(passage) + 40 :] in back[10**6 + 4]
    assert got.doc_id.isna().sum() == 1


def test_pipeline_returns_packed_ids(spark):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001").toPandas()
    assert len(got) and all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got.itertuples())
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert list(g.offset) == [0, *g.length.cumsum()[:-1]] and g.length.sum() <= 1024


def test_runs_of_frequent_windows_know_their_first_one(spark, monkeypatch):
    """A run over many parts is linked in its parts, whatever the cuts; only short runs at a cut are handed on."""
    rng = np.random.default_rng(11)
    rows = [(int(k), int(r), (100 << 32) | 60 + int(r) % 3, 160 << 4 | 1, int(r) % 5) for k, n in ((5, 4000), (-9, 700), (8, 2)) for r in rng.choice(1 << 40, n, replace=False)]
    rows += [(int(k), int(r), 100 << 32, 150 << 4, 0) for k, r in zip(rng.integers(-(1 << 40), 1 << 40, 3000), rng.choice(1 << 40, 3000))]
    rows += rows[:300]  # copies of texts
    found = spark.createDataFrame(rows, compact_windows.WINDOWS)
    tables, write = [], compact_windows.written
    monkeypatch.setattr(compact_windows, "written", lambda df, *a: tables.append(write(df, *a)) or tables[-1])
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        got = {tuple(r) for r in compact_windows._stars(found, 46, "links", True)[0].collect()}
        again = {tuple(r) for r in tables[0].where("kind in (2, 3)").drop("kind").collect()}
        assert tables[0].where("kind = 2").count() < 300
        monkeypatch.setattr(compact_windows, "_heads", lambda df: {})
        longer = {tuple(r) for r in compact_windows._stars(found, 46, "links", True)[0].collect()}
        assert tables[1].where("kind = 2").count() > 1000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    first = {}
    for k, r, *_ in sorted(rows):
        first.setdefault(k, r)
    # a link to the text before may be missing at a cut, and cuts are sampled
    to_first = lambda links: {x for x in links if x[0] in first.values()}
    pairs = {(a, b) for a, b, *_ in to_first(got)}
    assert to_first(got) == to_first(longer)
    assert all(first[k] == r or (first[k], r) in pairs for k, r, *_ in rows)
    assert {r for r in rows if r[0] in (5, -9)} <= again


def test_candidates_of_pairs_that_span_batches(spark):
    r = np.random.default_rng(4)
    rows = [(int(a), int(a + 1 + d), int(x << 32 | x + 60), int(y << 32 | y + 60), int(f)) for a, d, x, y, f in zip(*(r.integers(0, m, 400) for m in (3, 2, 900, 900, 4)))]
    linked = spark.createDataFrame(rows + rows[:50], compact_windows.LINKS)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in (7, 10000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            for need in (1, 2):
                found = compact_windows.candidates(linked, need)
                # links reach the task as rows; nothing collects them in the JVM
                assert "collect_set" not in found._jdf.queryExecution().toString()
                got = {(c.a, c.b): [tuple(s) for s in c.spans] for c in found.collect()}
                want = {}
                for a, b in sorted({x[:2] for x in rows}):
                    groups = []
                    for x in sorted({x[2:] for x in rows if x[:2] == (a, b)}, key=lambda x: x[1]):
                        (a0, a1), (b0, b1) = (divmod(v, 1 << 32) for v in x[:2])
                        if groups and b0 <= groups[-1][0][3]:
                            s, hit = groups[-1]
                            groups[-1] = ((min(s[0], a0), max(s[1], a1), s[2], max(s[3], b1)), hit | {x[2]})
                        else:
                            groups.append(((a0, a1, b0, b1), {x[2]}))
                    if kept := [s for s, hit in groups if len(hit) >= need]:
                        want[a, b] = kept
                assert got == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_same_passages_with_repeated_shingles():
    line, other = np.arange(100, 160, dtype=np.uint64), np.arange(500, 530, dtype=np.uint64)
    one = np.concatenate([line, other, line])
    # a repeated passage is matched where it comes first, and a run goes on where it is
    assert compact_windows.same_passages(one, line, 46, 0.8) == [(0, 59, 0, 59, 1.0)]
    assert compact_windows.same_passages(one, np.concatenate([other, line]), 46, 0.8) == [(60, 149, 0, 89, 1.0)]
    assert compact_windows.same_passages(line, np.concatenate([line, other, line]), 46, 0.8) == [(0, 59, 0, 59, 1.0), (0, 59, 90, 149, 1.0)]
    assert compact_windows.same_passages(line, other, 46, 0.8) == compact_windows.same_passages(line[:0], line, 46, 0.8) == []


def test_copies_of_short_texts_are_no_passages(spark):
    texts = [" ".join(f"w{i}" for i in range(n)) for n in (49, 50)] + ["", " \t\n", None]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(t for t in texts for _ in range(2))], "doc_id long, text string")
    found = compact_windows.duplicate_passages(docs)
    # words are counted without a regular expression over every text
    assert "split(" not in found._jdf.queryExecution().toString()
    assert [tuple(r) for r in found.collect()] == [(3, 0, 50, 2, 0, 50, 1.0)]


@pytest.mark.parametrize("group", [150, 1000])
def test_every_edited_copy_of_a_large_group_is_found(spark, group):
    """No copy is lost because its first text or the one before it is another one's copy, all pairs of a run count."""
    passage = prose(56, 9700)
    texts = [prose(25, 20000 + i) + " " + edited(passage, 1, i) + " " + prose(25, 22000 + i) for i in range(group)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    rows, want = compact_windows.duplicate_passages(df).collect(), with_source(texts)
    got = {r.doc_id for r in rows}
    print("recall", len(got & want), len(want))
    assert len(got & want) >= 0.97 * len(want)
    for r in rows:
        here, there = (texts[d].lower().split()[x:y] for d, x, y in ((r.doc_id, r.start_word, r.end_word), (r.source, r.source_start, r.source_end)))
        one, two = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (here, there))
        assert len(here) >= 50 and len(one & two) >= 0.8 * len(one | two)


def test_windows_that_an_earlier_text_has_twice(spark):
    """The second place of a signature in the only other text is met too."""
    texts = []
    for k in range(12):
        shared, other = prose(120, 9800 + k).split(), prose(200, 9820 + k).split()
        # all runs of five words of the passage come before it in other surroundings
        decoys = [w for i in range(0, 120, 5) for w in other[i : i + 60] + shared[i : i + 5]]
        texts += [" ".join(decoys + other + shared), " ".join(prose(40, 9840 + k).split() + shared)]
    assert found_rows(spark, texts, 4) >= with_source(texts)


def test_first_similar_against_all_pairs_and_in_blocks(spark, monkeypatch):
    import pyarrow as pa

    r = np.random.default_rng(12)
    base = r.integers(0, 1 << 32, (5, 91)).astype(np.uint32)
    key, role, row, parts = [], [], [], []
    for n in range(160):
        part = base[n % 5].copy()
        part[r.integers(0, 91, n % 9)] = r.integers(0, 1 << 32, n % 9)
        part = part[r.integers(0, 40) : 91 - r.integers(0, 10)]
        key.append(n % 5 // 2), role.append(int(r.integers(0, 3))), row.append(int(r.integers(-40, 40))), parts.append(part)
    order = np.argsort(key, kind="stable")
    key, role, row, parts = np.array(key)[order], np.array(role)[order], np.array(row)[order], [parts[i] for i in order]
    packed = pa.array([p.tobytes() for p in parts], pa.binary())
    cells = np.stack([key, np.zeros(len(key), np.int64)], 1)
    a, b = compact_windows.first_similar(cells, role, row, packed, 46, 0.8)
    want = {
        j: {i for i in range(160) if key[i] == key[j] and role[i] != 2 and row[i] < row[j] and compact_windows.same_passages(parts[i], parts[j], 46, 0.8)}
        for j in range(160) if role[j] != 0
    }
    assert set(b.tolist()) == {j for j, some in want.items() if some} and len(b) > 30
    assert all(i in want[j] for i, j in zip(a.tolist(), b.tolist()))

    texts = [prose(25, 24000 + i) + " " + edited(prose(56, 9900), 1, i) + " " + prose(25, 25000 + i) for i in range(120)]
    wanted = with_source(texts)
    monkeypatch.setattr(compact_windows, "BLOCK", 16)
    got = found_rows(spark, texts, 4)
    assert got <= wanted and len(got) >= 0.97 * len(wanted)
