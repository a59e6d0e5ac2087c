"""Block kernels of signals against direct formulas, with small runs, nulls, edges and one long key."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqprep.operators import frames as W
from seqprep.operators import runs as R
from seqprep.operators import spectra as D

U = ["utt"]


def signal(spark, parts, partitions=4):
    rows = [(k, i, None if v is None else float(v)) for k, x in parts.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "utt string, pos long, x double").repartition(partitions)


def by_key(df, value="x", at="pos"):
    out = {}
    for r in df.collect():
        assert r[at] not in out.setdefault(r.utt, {})
        out[r.utt][r[at]] = r[value]
    return out


@pytest.fixture(scope="module")
def parts():
    r = np.random.default_rng(4)
    return {"a": r.normal(size=1000), "b": r.normal(size=7), "c": r.normal(size=64) + 1e6, None: r.normal(size=40)}


@pytest.mark.parametrize("size", [1, 2, 5, 16, 1200])
def test_sliding_max(size):
    rows = np.random.default_rng(size).normal(size=(1100, 3))
    want = np.array([rows[i : i + size].max(axis=0) for i in range(len(rows) - size + 1)]).reshape(-1, 3)
    assert np.array_equal(R.sliding_max(rows, size), want)


@pytest.mark.parametrize("size, block", [(1, 8), (5, 8), (16, 8), (100, 64), (300, 1 << 16)])
def test_rolling_mean(spark, parts, size, block):
    got = by_key(W.rolling_mean(signal(spark, parts), U, size, block), "mean")
    for k, x in parts.items():
        want = {i: x[i : i + size].mean() for i in range(len(x) - size + 1)}
        assert got.get(k, {}).keys() == want.keys() and all(abs(got[k][i] - v) < 1e-9 * max(1, abs(v)) for i, v in want.items())


def test_rolling_mean_of_nulls_and_infinities(spark):
    x = [1.0, None, None, 3.0, float("nan"), 5.0, float("inf"), 7.0, float("-inf"), 9.0, 2.0, None, None]
    got = by_key(W.rolling_mean(signal(spark, {"a": x}), U, 2, 4), "mean")["a"]
    want = [1.0, None, 3.0, np.nan, np.nan, np.inf, np.inf, -np.inf, -np.inf, 5.5, 2.0, None]
    assert all(g is w is None or (g is not None and w is not None and np.array_equal([g], [w], equal_nan=True)) for g, w in zip([got[i] for i in range(12)], want))


def test_rolling_mean_costs_the_same_at_any_size(spark):
    x = spark.range(400_000).select(F.lit("a").alias("utt"), F.col("id").alias("pos"), (F.col("id") % 1000).cast("double").alias("x"))
    got = W.rolling_mean(x, U, 10_000).agg(F.count("*"), F.min("mean"), F.max("mean")).first()
    assert got[0] == 390_001 and abs(got[1] - 499.5) < 1e-9 and abs(got[2] - 499.5) < 1e-9


@pytest.mark.parametrize("size, step, block", [(6, 3, 8), (5, 1, 20), (4, 9, 30), (7, 7, 7)])
def test_rolling_window(spark, parts, size, step, block):
    got = by_key(W.rolling_window(signal(spark, parts), U, size, step, block), "values", "window")
    for k, x in parts.items():
        want = {i // step: list(x[i : i + size]) for i in range(0, len(x) - size + 1, step)}
        assert got.get(k, {}) == want


def test_null_samples_stay_null_in_frames(spark):
    got = by_key(W.frame(signal(spark, {"a": [1, None, 3, 4, 5]}), U, 4, 2), "values", "frame")["a"]
    assert got == {0: [1, None, 3, 4], 1: [3, 4, 5, 0], 2: [5, 0, 0, 0]}


@pytest.mark.parametrize("size, step, block", [(8, 4, 16), (8, 3, 32), (6, 6, 8), (4, 9, 16), (10, 2, 1 << 14)])
def test_overlap_add(spark, parts, size, step, block):
    frames = W.frame(signal(spark, parts), U, size, step)
    got = by_key(W.overlap_add(frames.repartition(3), U, step, block=block))
    want = {}
    for r in frames.collect():
        for i, v in enumerate(r["values"]):
            place = want.setdefault(r.utt, {})
            place[r.frame * step + i] = place.get(r.frame * step + i, 0.0) + v
    assert got.keys() == want.keys()
    for k in want:
        assert got[k].keys() == want[k].keys() and np.allclose([got[k][p] for p in want[k]], list(want[k].values()))


def shuffled(df):
    """Bytes that each exchange of a finished plan carried, the last one first."""
    def walk(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(node.plan())
        children = node.children()
        below = [x for i in range(children.size()) for x in walk(children.apply(i))]
        return ([node.metrics().apply("dataSize").value()] if kind == "ShuffleExchangeExec" else []) + below

    return walk(df._jdf.queryExecution().executedPlan())


def test_overlap_add_shuffles_each_sample_about_once(spark):
    n, size, step = 200_000, 1024, 256
    x = spark.range(n).select(F.lit("a").alias("utt"), F.col("id").alias("pos"), F.sin(F.col("id").cast("double")).alias("x"))
    out = W.overlap_add(W.frame(x, U, size, step), U, step)
    assert len(out.collect()) == n + size - n % size
    assert 8 * n <= shuffled(out)[0] <= 1.1 * 8 * n


def lags(x, y, largest):
    x, y = x - x.mean(), y - y.mean()
    return {d: sum(x[p] * y[p - d] for p in range(max(0, d), min(len(x), len(y) + d))) for d in range(-largest, largest + 1) if -len(y) < d < len(x)}


@pytest.mark.parametrize("largest, block", [(3, 8), (20, 8), (90, 64), (400, 128)])
def test_best_lag(spark, largest, block):
    r = np.random.default_rng(largest)
    a = {"a": r.normal(size=500), "b": r.normal(size=9), "c": np.zeros(30), "d": r.normal(size=20)}
    b = {"a": np.roll(a["a"], 7)[:430], "b": r.normal(size=300), "c": np.ones(12), "d": r.normal(size=90)}
    got = {x.utt: (x.lag, x.score) for x in W.best_lag(signal(spark, a), signal(spark, b), U, largest, block).collect()}
    for k in a:
        s = lags(a[k], b[k], largest)
        energy = np.sqrt((a[k] ** 2).sum() * (b[k] ** 2).sum())
        best = min(d for d, v in s.items() if v >= max(s.values()) - 1e-12 * energy)
        assert got[k][0] == best and abs(got[k][1] - s[best]) < 1e-8, k


def test_best_lag_with_many_lags(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=30_000)
    got = W.best_lag(signal(spark, {"a": x}), signal(spark, {"a": x[3210:]}), U, 4096).first()
    assert got.lag == 3210 and abs(got.score - ((x[3210:] - x.mean()) * (x[3210:] - x[3210:].mean())).sum()) < 1e-6


@pytest.mark.parametrize("m, n_taps, block", [(2, 8, 16), (3, 7, 9), (4, 3, 64), (1, 5, 8), (5, 40, 16)])
def test_downsample(spark, parts, m, n_taps, block):
    taps = list(np.random.default_rng(m).normal(size=n_taps))
    got = by_key(W.downsample(signal(spark, parts), U, m, taps, block))
    for k, x in parts.items():
        whole = np.convolve(x, taps)
        count = (len(x) + m - 1) // m + -(-n_taps // m)
        want = [whole[i * m] if i * m < len(whole) else 0.0 for i in range(count)]
        assert sorted(got[k]) == list(range(count)) and np.allclose([got[k][i] for i in range(count)], want)


def test_spectrum_equals_framing_then_transform(spark, parts):
    got = {(r.utt, r.frame): np.array(r.re) + 1j * np.array(r.im) for r in D.spectrum(signal(spark, parts), U, 16, 6).collect()}
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(16) / 16)
    for k, x in parts.items():
        padded = np.concatenate([x - x.mean(), np.zeros(16 - len(x) % 16)])
        frames = [padded[i : i + 16] for i in range(0, len(padded) - 15, 6)]
        assert sum(key == k for key, _ in got) == len(frames)
        assert all(np.allclose(got[k, i], np.fft.rfft(f * hann)) for i, f in enumerate(frames))


@pytest.mark.parametrize("order, block", [(2, 5), (7, 8), (3, 1 << 10)])
def test_voice_activity(spark, order, block):
    r = np.random.default_rng(order)
    mags = {"a": np.abs(r.normal(size=(60, 5))), "b": np.zeros((9, 5)), "c": np.abs(r.normal(size=(3, 5)))}
    mags["a"][:, 3] = 0
    rows = [(k, i, [float(v) for v in m]) for k, x in mags.items() for i, m in enumerate(x)]
    spec = spark.createDataFrame(rows, "utt string, frame long, mag array<double>").repartition(3)
    power = {x.utt: x.power for x in W.noise_spectrum(spec, U, 4).collect()}
    around = {k: [x[max(i - order, 0) : i + order + 1].max(axis=0) for i in range(len(x))] for k, x in mags.items()}
    for k, got in by_key(W.long_term_envelope(spec, U, order, block), "envelope", "frame").items():
        assert np.allclose([got[i] for i in range(len(got))], around[k])
    for k, got in by_key(W.voice_activity(spec, U, 8, 3.0, order, 4, block), "ratio", "frame").items():
        noise = mags[k][:4].mean(axis=0) ** 2
        assert np.allclose(power[k], noise)
        for i in range(len(mags[k])):
            total = sum((1 if b in (0, 4) else 2) * around[k][i][b] ** 2 / noise[b] for b in range(5) if noise[b] > 0)
            want = 0.0 if i < order or i + order > len(mags[k]) - 1 or total == 0 else 10 * np.log10(total / 8)
            assert abs(got[i] - want) < 1e-9


def test_empty_signals(spark):
    none = signal(spark, {"a": [1.0]}).limit(0)
    for df in (W.rolling_mean(none, U, 3), W.rolling_window(none, U, 3), W.frame(none, U, 4), W.downsample(none, U, 2, [1.0]), W.best_lag(none, none, U, 4),
               D.spectrum(none, U, 4), D.inverse_spectrum(D.spectrum(none, U, 4), U, 4), W.voice_activity(D.activity_magnitudes(none, U, 4), U, 4)):
        assert df.count() == 0


def test_a_task_holds_few_results_of_runs(spark):
    rows, kept = spark.range(0, 100, 1, 1).select(F.col("id").alias("utt"), F.col("id").alias("n")), []

    def kernel(row):
        import weakref

        # bytes of results that wait to leave the task
        held = sum(x.nbytes for x in (ref() for ref in kept) if x is not None)
        out = np.full(1 << 14, held), np.full(1 << 14, row["n"])
        kept.extend(weakref.ref(x) for x in out)
        return out

    got = R.map_runs(rows, U, "held long, n long", kernel).groupBy("utt").agg(F.max("held").alias("held"), F.sum("n").alias("n")).collect()
    assert {r.utt: r.n for r in got} == {i: i << 14 for i in range(100)}
    assert 0 < max(r.held for r in got) <= 2 << 20
