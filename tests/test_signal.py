import numpy as np
import pytest
from pyspark.sql import functions as F

from seqprep.functions import arrays as AR
from seqprep.functions import signal as S
from seqprep.operators import frames as W
from seqprep.operators import spectra as D
from seqprep.operators import vectors as VQ


@pytest.fixture(scope="module")
def wave(spark):
    t = np.arange(100)
    x = np.sin(t / 3.0) + 0.3 * np.cos(t / 1.7)
    return x, spark.createDataFrame([(1, int(i), float(v)) for i, v in enumerate(x)], "utt long, pos long, x double").cache()


def values(df, n):
    got = {r.pos: r.x for r in df.collect()}
    return np.array([got[i] for i in range(n)])


def test_frames_follow_the_padding_rule(spark):
    for n, frames in ((7, 1), (8, 3), (9, 3), (16, 5)):
        df = spark.range(n).select(F.lit(1).alias("utt"), F.col("id").alias("pos"), F.lit(1.0).alias("x"))
        assert W.frame(df, ["utt"], 8, 4).count() == frames


def test_cosine_roundtrip(wave):
    x, df = wave
    c = D.dct_compress(df, ["utt"], 16, 16)
    assert np.allclose(values(D.dct_uncompress(c, ["utt"], 16, 16), 100), x)


def test_lapped_roundtrip(wave):
    x, df = wave
    back = values(D.imdct(D.mdct(df, ["utt"], 8), ["utt"], 8), 100)
    # both windows overlap to one away from the edges
    assert np.allclose(back[8:92], x[8:92])


def test_spectrum_roundtrip(wave):
    x, df = wave
    spec = D.spectrum(df, ["utt"], 16, center=False)
    back = values(D.inverse_spectrum(spec, ["utt"], 16, center=False, whole=True), 100)
    assert np.allclose(back[8:92], x[8:92])


def test_gain_control_keeps_length(wave):
    _, df = wave
    out = D.gain_control(df, ["utt"], 16000, 16, 3)
    assert out.where("x is null or isnan(x)").count() == 0 and out.count() > 100


def test_companding_roundtrip(spark):
    df = spark.range(-50, 51).select((F.col("id") / 50.0).alias("x"))
    worst = df.select(F.max(F.abs(S.inv_mulaw(S.mulaw(F.col("x"))) - F.col("x"))), F.max(F.abs(S.inv_mulaw_quantize(S.mulaw_quantize(F.col("x"))) - F.col("x"))),
                      F.min(S.mulaw_quantize(F.col("x"))), F.max(S.mulaw_quantize(F.col("x")))).collect()[0]
    assert worst[0] < 1e-9 and worst[1] < 0.03 and (worst[2], worst[3]) == (0, 255)


def test_decibel_roundtrip(spark):
    df = spark.range(1, 50).select((F.col("id") / 10.0).alias("x"))
    assert df.select(F.max(F.abs(S.db_to_amp(S.amp_to_db(F.col("x"))) - F.col("x")))).collect()[0][0] < 1e-9


def test_mel_filters():
    w = S.mel_weights(257, 16000, 125, 7800, 80)
    assert w.shape == (257, 80) and (w[0] == 0).all() and (w >= 0).all() and w.max() <= 1
    assert S.mel_weights_wide(64, 8000, 10).shape == (10, 64)


def test_utterance_features_lengths(wave):
    _, df = wave
    out = D.utterance_features(df, ["utt"], 16, 4, 16000, 5)
    row = out["manifest"].collect()[0]
    assert row.timesteps == row.n_frames * 4
    assert out["codes"].count() == row.timesteps and out["mel"].count() == row.n_frames


def test_masks(spark):
    df = spark.createDataFrame([([1.0, 0.0, 2.0, 0.0, 0.0],), ([0.0, 0.0],)], "v array<double>")
    got = [r[0] for r in df.select(AR.trailing_zero_mask(F.col("v"))).collect()]
    assert got == [[1, 1, 1, 0, 0], [0, 0]]


def test_nearest_codeword_ties_take_the_lowest(spark):
    rows = spark.createDataFrame([(0, [0.0, 0.0]), (1, [2.0, 0.1])], "id long, vec array<double>")
    book = spark.createDataFrame([(3, [1.0, 0.0]), (1, [-1.0, 0.0]), (2, [0.0, 1.0])], "code_id long, vec array<double>")
    for f in (VQ.nearest_codeword, VQ.nearest_codeword_columns):
        got = {r.id: (r.code_id, list(r.codeword)) for r in f(rows, book).collect()}
        assert got == {0: (1, [-1.0, 0.0]), 1: (3, [1.0, 0.0])}


def test_a_hundred_thousand_codewords(spark, monkeypatch):
    """Shards of the codebook against one matrix product, with ties across shards, null vectors and one codeword near most rows."""
    rng = np.random.default_rng(7)
    codes = rng.normal(size=(100_000, 4))
    codes[70_000] = codes[5]
    rows = np.concatenate([rng.normal(size=(200, 4)), np.repeat(codes[5:6], 300, axis=0) + 1e-9])
    table = [(i, v, i) for i, v in enumerate(rows.tolist())] + [(900, None, 1)]
    left = spark.createDataFrame(table, "id long, vec array<double>, _blk int").repartition(5)
    book = spark.createDataFrame(list(enumerate(codes.tolist())), "code_id int, vec array<double>")
    monkeypatch.setattr(VQ, "ROW_BLOCK", 100)
    out = VQ.nearest_codeword(left, book, shard_bytes=1 << 20)
    assert out.columns == ["id", "vec", "_blk", "code_id", "distance", "codeword"]
    got = {r.id: r for r in out.collect()}
    assert len(got) == len(table) and got[900].code_id is None and got[900].distance is None and got[900].codeword is None
    for i, x in enumerate(rows):
        d = ((codes - x) ** 2).sum(axis=1)
        assert got[i].code_id == d.argmin() and abs(got[i].distance - d.min()) < 1e-12 and got[i].codeword == codes[d.argmin()].tolist()
    assert got[400].code_id == 5
    one = {r.id: (r.code_id, r.distance) for r in VQ.nearest_codeword(left, book).collect()}
    assert one == {i: (r.code_id, r.distance) for i, r in got.items()}
    many = {r.id: r.code_id for r in VQ.nearest_codeword_columns(left.limit(20), book, max_codes=64).collect()}
    assert all(one[i][0] == c for i, c in many.items())


def test_label_trim(spark):
    labels = spark.createDataFrame([("u", 0, 10, "pau"), ("u", 10, 30, "a"), ("u", 30, 35, "pau"), ("u", 35, 50, "b"), ("u", 50, 60, "pau")], "utt string, begin long, end long, label string")
    assert tuple(W.label_trim(labels, ["utt"]).collect()[0]) == ("u", 10, 50)
