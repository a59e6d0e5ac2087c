"""Silent, constant, short, null and oversized inputs have defined results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqprep.functions import phones as P
from seqprep.functions import signal as S
from seqprep.functions import symbols as Y
from seqprep.functions import text as T
from seqprep.operators import aggregates as AG
from seqprep.operators import batching as B
from seqprep.operators import frames as W
from seqprep.operators import joins as J
from seqprep.operators import mix as MX
from seqprep.operators import sampling as K
from seqprep.operators import spectra as D
from seqprep.operators import strokes as ST
from seqprep.operators import vectors as VQ
from seqprep.plans.corpus_queries import letter_rules


@pytest.fixture(scope="module")
def two(spark):
    """Utterance 1 sounds, 2 is silent."""
    rows = [(1, i, float(np.sin(i / 2.0))) for i in range(64)] + [(2, i, 0.0) for i in range(64)]
    return spark.createDataFrame(rows, "utt long, pos long, x double")


def test_silent_signals(two):
    silent = lambda df: {r.x for r in df.where("utt = 2").collect()}
    assert silent(AG.peak_rescale(two, ["utt"])) == {0.0}
    assert silent(AG.minmax_rescale(two, ["utt"])) == {0}
    activity = W.voice_activity(D.activity_magnitudes(two, ["utt"], 8), ["utt"], 8, order=1, head=3).where("utt = 2").collect()
    assert activity and not any(r.voiced for r in activity) and {r.ratio for r in activity} == {0.0}
    power = D.log_power_spectrogram(two, ["utt"], 8, 4).where("utt = 2").collect()
    assert {round(v, 6) for r in power for v in r.feat} == {-100.0}


def test_constant_dimension(spark):
    rows = spark.createDataFrame([(1, [1.0, 5.0]), (2, [3.0, 5.0])], "id long, feat array<double>")
    stats = AG.masked_mean_std(rows)
    z = AG.normalize(rows, stats)
    assert {r.id: r.feat for r in z.collect()} == {1: [-1.0, 0.0], 2: [1.0, 0.0]}
    assert {r.id: r.feat for r in AG.denormalize(z, stats).collect()} == {1: [1.0, 5.0], 2: [3.0, 5.0]}


def test_level_line(spark):
    points = spark.createDataFrame([(1, i, float(i), 2.0) for i in range(4)], "line long, idx long, x double, y double")
    assert sorted((r.x, r.y) for r in ST.line_normalize(points, ["line"]).collect()) == [(float(i), 0.0) for i in range(4)]


@pytest.mark.parametrize("step, starts", [(10, [0, 10, 20]), (4, [0, 4, 8, 12, 16, 20, 24]), (3, [0, 3, 6, 9, 12, 15, 18, 21, 24])])
def test_frames_of_any_step(spark, step, starts):
    df = spark.range(24).select(F.lit(1).alias("utt"), F.col("id").alias("pos"), (F.col("id") + 1.0).alias("x"))
    got = {r.frame: r["values"] for r in W.frame(df, ["utt"], 4, step).collect()}
    assert got == {k: [p + 1.0 if p < 24 else 0.0 for p in range(s, s + 4)] for k, s in enumerate(starts)}


def test_frames_across_runs(spark, monkeypatch):
    monkeypatch.setattr(W, "FRAME_RUN", 20)
    df = spark.range(500).select(F.lit(1).alias("utt"), F.col("id").alias("pos"), F.col("id").cast("double").alias("x"))
    got = {r.frame: r["values"] for r in W.frame(df, ["utt"], 16, 6, pad=False).collect()}
    assert got == {k: [float(p) for p in range(6 * k, 6 * k + 16)] for k in range((500 - 16) // 6 + 1)}


@pytest.mark.parametrize("size, hop", [(8, 8), (8, 4)])
def test_utterance_frames_match_the_count(two, size, hop):
    got = D.utterance_features(two.where("utt = 1"), ["utt"], size, hop, 16000, 4)
    m = got["manifest"].collect()[0]
    assert sorted(r.frame for r in got["mel"].collect()) == list(range(m.n_frames))
    assert sorted(r.pos for r in got["codes"].collect()) == list(range(min(m.timesteps, m.n_frames * hop)))


def test_mel_bank_has_area_one():
    bank = S.mel_bank(20_001, 16000, 125.0, 7600.0, 10)
    assert np.allclose(bank.sum(axis=0) * (8000 / 20_000), 1.0, atol=1e-3)


def test_fewer_samples_than_frames(spark):
    samples = spark.createDataFrame([("a", i, 2, 3) for i in range(2)], "k string, pos long, n long, n_frames long")
    frames = spark.createDataFrame([("a", i, [1.0]) for i in range(3)], "k string, frame long, feat array<double>")
    assert [r.feat for r in J.repeat_to_resolution(samples, frames, "k").collect()] == [[0.0], [0.0]]


def test_null_vector_and_text(spark):
    rows = spark.createDataFrame([(1, None), (2, [1.0, 0.0]), (3, None), (4, [0.0, 3.0])], "id long, vec array<double>")
    book = spark.createDataFrame([(7, [1.0, 0.0]), (8, [0.0, 1.0])], "code_id long, vec array<double>")
    for find in (VQ.nearest_codeword, VQ.nearest_codeword_columns):
        got = {r.id: (r.code_id, r.distance, r.codeword) for r in find(rows, book).collect()}
        assert got == {1: (None,) * 3, 2: (7, 0.0, [1.0, 0.0]), 3: (None,) * 3, 4: (8, 4.0, [0.0, 1.0])}
        assert [r.code_id for r in find(rows.where("vec is null"), book).collect()] == [None, None]
    texts = spark.createDataFrame([(1, None), (2, "on")], "id long, t string")
    got = {r.id: r.phones for r in P.rulebased_g2p(texts, "id", "t", letter_rules(spark)).collect()}
    assert got[1] is None and got[2]


@pytest.mark.parametrize("text, want", [
    ("$1,234.50", "1234 dollars, 50 cents"), ("$,.50", "$,.50"), ("$.50", "50 cents"), ("$7", "7 dollars"), ("$1.2.3", "1.2.3 dollars"),
    ("$" + "1" * 30 + " x", "1" * 30 + " dollars x"),
])
def test_dollars(spark, text, want):
    assert spark.createDataFrame([(text,)], "v string").select(T.expand_dollars(F.col("v"))).collect()[0][0] == want


def test_no_bounds_on_phones(spark):
    df = spark.createDataFrame([("@ah" * 12_000, "{ABCDEFGHIJKLMNOP}")], "p string, braced string")
    ids, braced = df.select(F.size(MX.phone_ids_of(F.col("p"))), Y.braced_phones(F.col("braced"))).collect()[0]
    assert ids == 12_000 and braced[0].is_phone in (0, 1)


def test_ragged_rows(spark):
    rows = spark.createDataFrame([(i, [1.0] * (2 if i else 3)) for i in range(10)] + [(99, None)], "id long, v array<double>")
    assert {r.id for r in B.ragged_rows(rows, v=2).collect()} == {0, 99}
    assert B.fixed_batches(rows, ["id"], 4, 1, 3, "leave", v=2).groupBy("batch").count().where("count = 4").count() == 3
    with pytest.raises(Exception, match="another size"):
        B.fixed_batches(rows, ["id"], 4, 1, 3, v=2).collect()


def test_batches_in_one_scan_equal_single_ones(spark):
    rows = spark.range(200).withColumnRenamed("id", "k")
    many = K.sample_batches(rows, ["k"], 5, 3, 4).collect()
    for b in range(4):
        assert {r.k for r in many if r.batch == b} == {r.k for r in K.sample_batch(rows, ["k"], 5, 3, b).collect()}
