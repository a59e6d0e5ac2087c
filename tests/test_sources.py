import glob
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from seqprep.operators import aggregates as AG
from seqprep.operators import batching as B
from seqprep.operators import filters as FL
from seqprep.operators import joins as J
from seqprep.operators import sampling as K
from seqprep.operators.blocks import lookup_join
from seqprep.plans import source_queries as SQ
from seqprep.sources import accessors as AC
from seqprep.sources import readers as R
from seqprep.sources import writers as W


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="seqprep-test-")


def put(path, text):
    with open(path, "w") as f:
        f.write(text)
    return path


def test_lines_and_manifest(spark, folder):
    assert [r.value for r in R.read_lines(spark, put(f"{folder}/a.txt", "  one \ntwo\n")).collect()] == ["one", "two"]
    rows = R.read_manifest(spark, put(f"{folder}/m.txt", 'a.npy|m.npy|512|say "hi", you|3\nb.npy|n.npy|256|no')).collect()
    assert [(r.audio, r.steps, r.text, r.speaker_id) for r in rows] == [("a.npy", 512, 'say "hi", you', 3), ("b.npy", 256, "no", None)]
    back = FL.speaker_filter(R.read_manifest(spark, f"{folder}/m.txt"), 3)
    assert back.count() == 1 and "speaker_id" not in back.columns


def test_manifest_roundtrip(spark, folder):
    df = spark.createDataFrame([("a", "m", 5, "x y", 1)], R.MANIFEST)
    W.write_manifest(df, df.columns, f"{folder}/out")
    assert R.read_manifest(spark, f"{folder}/out").collect() == df.collect()
    s = W.manifest_summary(df, "steps", "text", 10).collect()[0]
    assert (s.utterances, s.steps, s.longest_text) == (1, 5, 3)


def test_media_and_fingerprint(spark, folder):
    for n in ("b.wav", "a.wav", "c.txt"):
        put(f"{folder}/{n}", n)
    rows = R.list_media(spark, folder, [".wav"]).orderBy("index").collect()
    assert [(r["index"], r.path.split("/")[-1]) for r in rows] == [(1, "a.wav"), (2, "b.wav")]
    assert R.file_fingerprint(spark, f"{folder}/c.txt").collect()[0].md5 == __import__("hashlib").md5(b"c.txt").hexdigest()


def test_alignment(spark, folder):
    word = lambda w, case, phones=None: {"word": w, "case": case, **({"phones": [{"phone": p} for p in phones]} if phones else {})}
    doc = {"transcript": "the cat sat on", "words": [
        word("the", "success", ["dh_B", "ah_E"]), word("uh", "not-found-in-transcript"), word("cat", "success", ["k_B"]),
        word("sat", "not-found-in-audio"), word("on", "success", ["aa_S"]), word("more", "success", ["m_S"]),
    ]}
    put(f"{folder}/u1.json", json.dumps(doc, indent=1))
    records = R.read_alignment(spark, folder)
    assert R.aligned_words(records).count() == 6
    x = FL.alignment_case_filter(records.withColumn("clean", F.col("transcript"))).orderBy("place").collect()
    assert [(r.word, r.transcript_word, r.phones) for r in x] == [("the", "the", ["dh", "ah"]), ("cat", "cat", ["k"]), ("on", "on", ["aa"])]


def test_lexicon(spark, folder):
    text = ";;; note\nREAD  R EH1 D\nREAD(1)  R IY1 D\nBAD  Q Q\n'TIS  T IH1 Z\n"
    path = put(f"{folder}/lex", text)
    got = {r.word: r.prons for r in R.read_lexicon(spark, path).collect()}
    assert got == {"READ": [["R", "EH1", "D"], ["R", "IY1", "D"]], "'TIS": [["T", "IH1", "Z"]]}
    assert [r.word for r in R.read_lexicon(spark, path, keep_ambiguous=False).collect()] == ["'TIS"]
    assert len(R.VALID_PHONES) == 84


def test_strokes_xml(spark, folder):
    doc = lambda trans: f'<WhiteboardCaptureSession>{trans}<StrokeSet><Stroke><Point x="1" y="2"/><Point x="3" y="4"/></Stroke><Stroke><Point x="5" y="6"/></Stroke></StrokeSet></WhiteboardCaptureSession>'
    put(f"{folder}/d1.xml", doc('<Transcription><TextLine text="a &amp;amp; b"/><TextLine text="c"/></Transcription>'))
    put(f"{folder}/d2.xml", doc(""))
    out = R.read_strokes_xml(spark, folder)
    assert [(r.line, r.text) for r in out["lines"].orderBy("line").collect()] == [(0, "a & b"), (1, "c")]
    assert [(r.stroke, r.idx, r.x, r.y, r.eos) for r in out["points"].orderBy("stroke", "idx").collect()] == [(0, 0, 1, 2, 0), (0, 1, 3, 4, 1), (1, 0, 5, 6, 1)]


def test_word_counts(spark, folder):
    assert [r.word for r in R.read_word_counts(spark, put(f"{folder}/w", "b\t2\nc\t1\na\t9\n")).collect()] == ["c", "b", "a"]


def test_sinewaves(spark):
    x = R.make_sinewaves(spark, 20, 3, square=True)
    assert x.count() == 60 and {r.x for r in x.select("x").distinct().collect()} == {0.0, 1.0}
    plain = {(r.wave, r.pos): r.x for r in R.make_sinewaves(spark, 20, 3, harmonic=True).collect()}
    import math
    t, o = 3 * 7 / (2 * math.pi), 3 * 2 / (2 * math.pi)
    assert plain[(2, 7)] == pytest.approx(math.sin(t + o) + math.sin(1.7 * t + o) + math.sin(0.62 * t + o))


def test_feature_cache(spark, folder):
    seen = spark.sparkContext.accumulator(0)

    def compute(df):
        def count(batches):
            for b in batches:
                seen.add(len(b))
                yield b
        return df.mapInPandas(count, df.schema)

    src = spark.range(10).select(F.col("id"), (F.col("id") * 2).alias("v"))
    path = f"{folder}/cache"
    assert W.cached_features(spark, src.where("id < 4"), "id", {"a": 1}, compute, path).count() == 4
    assert W.cached_features(spark, src, "id", {"a": 1}, compute, path).count() == 10
    assert seen.value == 10
    assert W.cached_features(spark, src, "id", {"a": 2}, compute, path).count() == 10
    assert W.cached_features(spark, src, "id", {"a": 2}, compute, path, force_refresh=True).count() == 10
    assert W.cached_features(spark, src, "id", {"a": 1}, compute, path).count() == 10
    assert seen.value == 30


def test_quarantine_and_retry(spark):
    df = spark.createDataFrame([("1",), ("x",), ("y2",)], "t string")
    parts = W.quarantine(df, F.col("t").try_cast("int"))
    assert (parts["good"].count(), parts["rejects"].count()) == (1, 2)
    again = W.retry_rejects(parts, F.regexp_replace("t", "[a-z]", "").try_cast("int"))
    assert (again["good"].count(), again["rejects"].count()) == (2, 1)


def test_accessor(spark, folder):
    for n in range(3):
        put(f"{folder}/{n}.txt", "x" * (n + 1))
    files = spark.createDataFrame([(f"{folder}/{n}.txt",) for n in range(3)], "path string")

    def read(path):
        text = open(path).read()
        for i, c in enumerate(text):
            yield {"path": path, "pos": i, "c": c}

    assert AC.sequence_accessor(files, read, "path string, pos long, c string").count() == 6


def test_pair_by_stem_last_wins(spark):
    wav = spark.createDataFrame([("/a/x.1.wav",), ("/b/x.1.wav",), ("/a/y.wav",)], "path string")
    txt = spark.createDataFrame([("/t/x.json",), ("/t/z.json",)], "path string")
    assert [tuple(r) for r in J.pair_by_stem(wav, txt).collect()] == [("x", "/b/x.1.wav", "/t/x.json")]


def test_splits_are_disjoint_and_whole(spark):
    df = spark.range(101)
    parts = [K.shuffle_split(df, ["id"], a, b, 4) for a, b in ((0.0, 0.3), (0.3, 0.8), (0.8, None))]
    ids = [r.id for p in parts for r in p.collect()]
    assert len(ids) == 101 and len(set(ids)) == 101
    J.assert_disjoint(parts[0], parts[1], ["id"])
    with pytest.raises(ValueError):
        J.assert_disjoint(parts[0], parts[0], ["id"])


@pytest.mark.parametrize("n", [3, 16, 37, 300])
def test_similar_length_order_is_a_permutation(spark, n):
    df = spark.range(n).withColumn("len", F.col("id") % 17)
    out = K.similar_length_order(df, ["id"], F.col("len"), 4, 1, group=16)
    assert sorted(r.place for r in out.collect()) == list(range(n))
    assert out.columns == ["id", "len", "place"]


def test_grouped_shuffle_keeps_groups(spark):
    df = spark.range(50).select((F.col("id") % 7).alias("g"), "id")
    rows = K.grouped_shuffle(df, "g", ["id"], 8, 2).orderBy("place").collect()
    assert len(rows) == 48
    order = [r.g for r in rows]
    assert sum(a != b for a, b in zip(order, order[1:])) <= 6


def test_per_key_cap_on_a_heavy_key(spark):
    df = spark.range(5000).select(F.when(F.col("id") < 4000, 0).otherwise(F.col("id") % 3).alias("k"), "id")
    rows = K.per_key_cap(df, "k", ["id"], 4).collect()
    assert sorted((r.k, r.id) for r in rows if r.k == 0) == [(0, i) for i in range(4)]
    assert len(rows) == 12


def test_chunks_restore_the_sequence(spark):
    df = spark.range(31).select(F.lit(1).alias("utt"), F.col("id").alias("pos"), F.col("id").cast("double").alias("x"))
    c = B.chunk_overlap1(df, ["utt"], 10, block=7)
    assert c.groupBy("chunk").count().where("count <> 11").count() == 0
    assert sorted(r.pos for r in B.restored(c, ["utt"], 10).collect()) == list(range(30))
    p = B.chunk_padded(df, ["utt"], 10)
    assert p.agg(F.sum("mask")).collect()[0][0] == 31 and p.count() == 40


def test_lanes(spark):
    seq = spark.createDataFrame([(i, i % 3 + 1) for i in range(9)], "id long, n_chunks long")
    rows = B.assign_lanes(seq, ["id"], 2, block=2).collect()
    assert len({(r.lane, r.batch) for r in rows}) == len(rows) == 18
    for lane in (0, 1):
        assert sorted(r.batch for r in rows if r.lane == lane) == list(range(sum(r.lane == lane for r in rows)))


def test_group_rows_in_pieces(spark):
    df = spark.range(25).select(F.lit("k").alias("k"), "id")
    rows = AG.group_rows(df, "k", "id", piece=10).orderBy("piece").collect()
    assert [len(r.ids) for r in rows] == [10, 10, 5] and rows[2].ids == [20, 21, 22, 23, 24]


def test_pause_transcript(spark, folder):
    put(f"{folder}/u1.txt", "hh ay\n# Hi, you.\n## 0.0 0.03 x\n")
    put(f"{folder}/u2.txt", "hh\n")
    a, b = R.read_pause_transcripts(spark, folder).orderBy("id").collect()
    assert (a.id, a.phones, a.text, a.seconds) == ("u1", "hh ay", "Hi, you.", [0.0, 0.03, None])
    assert (b.id, b.phones, b.seconds) == ("u2", "hh", None)


def test_lookup_join_by_rows_and_bytes(spark):
    left = spark.createDataFrame([(1,), (2,), (1,)], "k int")
    right = spark.createDataFrame([(1, "a" * 1000, [1, 2]), (3, "b", None)], "k int, v string, xs array<int>")
    want = [(1, 1000), (1, 1000), (2, None)]
    for limits, broadcast in (({}, True), ({"max_rows": 1}, False), ({"max_bytes": 100}, False)):
        out = lookup_join(left, right, ["k"], **limits)
        assert sorted((r.k, r.v and len(r.v)) for r in out.collect()) == want
        assert ("_salt" not in out._jdf.queryExecution().optimizedPlan().toString()) == broadcast
    assert lookup_join(left, right.where("k > 9"), ["k"]).count() == 3


def test_files_per_key_are_written_by_many_tasks(spark, tmp_path):
    rows = spark.createDataFrame([(i % 40, "x") for i in range(80)], "k long, value string").coalesce(1)
    SQ.file_per_key(rows, "k").text(f"{tmp_path}/out")
    files = glob.glob(f"{tmp_path}/out/k=*/*.txt")
    assert len(files) == 40 and len({os.path.basename(f).split("-")[1] for f in files}) > 4
    assert all(open(f).read() == "x\nx\n" for f in files)


def test_session_files_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(SQ, "SESSIONS_PER_FILE", 10)
    items = [(k, n) for k in range(95) for n in (1, 2, 3)]
    spark.createDataFrame(items, "l_orderkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = SQ.sessions(spark, str(tmp_path))
    assert len(found["points"].inputFiles()) >= 10
    assert found["points"].count() == 285 and found["lines"].count() == 190


def test_records_are_paired_in_their_rows(spark):
    case = ["success", "not-found-in-transcript", "not-found-in-audio", None]
    schema = "id long, clean string, words array<struct<word string, case string, alignedWord string, phones array<struct<phone string>>>>"
    record = lambda i, n: (i, " ".join(f"t{j}" for j in range(n)), [(f"w{j}", case[(j * j + n) % 4], None, [("A_B",)]) for j in range(n + 1)])
    once = [record(i, i % 7) for i in range(20)] + [(90, None, []), (91, "a b", None)]
    plain = FL.alignment_case_filter(spark.createDataFrame(once, schema))
    assert "Window" not in plain._jdf.queryExecution().toString()
    for rows in (once, once + [record(3, 5), record(4, 6), record(4, 6), record(None, 4)]):
        records = spark.createDataFrame(rows, schema)
        want = FL._shared_places(records).select("id", "place", "w.word", "transcript_word")
        got = FL.alignment_case_filter(records).select("id", "place", "word", "transcript_word")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
