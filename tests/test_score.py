import pytest
from pyspark.sql import functions as F

from seqprep.functions import music as M
from seqprep.operators import rules as R
from seqprep.operators import score as S


def notes(spark, voices, durs=None):
    rows = [("p", v, i, p, float((durs or {}).get(v, [4.0] * len(line))[i]), 0) for v, line in enumerate(voices) for i, p in enumerate(line)]
    return spark.createDataFrame(rows, "piece string, voice int, idx long, pitch int, dur double, fermata int")


def steps(spark, voices, rule, ignored=(), durs=None, relaxed=False):
    n = notes(spark, voices, durs)
    ctx = S.with_context(R.with_mode(S.pair_voices(n), n))
    return [r.ok for r in R.verdicts(ctx, [rule], relaxed, ignored).orderBy("idx").collect()]


def test_note_names(spark):
    df = spark.createDataFrame([("C4",), ("F#3",), ("Bb5",), ("E-4",), ("R",)], "n string")
    assert [r[0] for r in df.select(M.note_to_midi(F.col("n"))).collect()] == [60, 54, 82, 63, 0]
    back = spark.createDataFrame([(60,), (54,), (82,), (0,)], "p int").select(M.midi_to_note(F.col("p"))).collect()
    assert [r[0] for r in back] == ["C4", "F#3", "Bb5", "R"]


def test_intervals(spark):
    df = spark.createDataFrame([(67, 60), (60, 67), (72, 60), (0, 60), (60, 10)], "a int, b int")
    assert [r[0] for r in df.select(M.interval_name(F.col("a"), F.col("b"))).collect()] == ["P5", "-P5", "P8", "RP1", None]


def test_parallel_fifths_fail(spark):
    assert steps(spark, [[67, 69, 71], [60, 62, 60]], "parallel_rule") == [None, False, True]


def test_start_rule(spark):
    assert steps(spark, [[67, 69, 72], [60, 62, 60]], "key_start_rule") == [True, None, None]
    assert steps(spark, [[64, 69, 72], [60, 62, 60]], "key_start_rule") == [False, None, None]
    assert steps(spark, [[64, 69, 72], [60, 62, 60]], "key_start_rule", relaxed=True) == [True, None, None]


def test_next_step(spark):
    assert steps(spark, [[60, 66, 68, 78], [48, 50, 52, 53]], "next_step_rule") == [None, False, True, False]
    assert steps(spark, [[60, 66, 68, 78], [48, 50, 52, 53]], "next_step_rule", ignored=(0,)) == [None, True, True, True]


def test_leap(spark):
    assert steps(spark, [[60, 67, 65, 64], [48, 48, 48, 48]], "leap_rule", ignored=(1,)) == [None, None, True, None]
    assert steps(spark, [[60, 67, 69, 64], [48, 48, 48, 48]], "leap_rule", ignored=(1,)) == [None, None, False, None]


def test_bar_consonance(spark):
    # a seventh on the downbeat resolves to a sixth
    d = {0: [4.0, 4.0, 4.0], 1: [4.0, 4.0, 4.0]}
    assert steps(spark, [[71, 69, 72], [60, 60, 60]], "bar_consonance_rule", durs=d) == [True, True, True]
    assert steps(spark, [[71, 74, 72], [60, 60, 60]], "bar_consonance_rule", durs=d)[0] is False


def test_passing_tone_at_the_edge_is_null(spark):
    d = {0: [2.0, 2.0, 2.0, 2.0], 1: [2.0, 2.0, 2.0, 2.0]}
    assert steps(spark, [[64, 65, 67, 66], [60, 60, 60, 60]], "passing_tone_rule", durs=d, ignored=(1,)) == [None, True, None, None]


def test_motion(spark):
    ctx = S.with_context(S.pair_voices(notes(spark, [[60, 62, 62, 64, 60], [48, 50, 48, 47, 45]])))
    got = [r.motion for r in S.motion_list(ctx).orderBy("idx").collect()]
    assert got == ["START", "DIRECT", "OBLIQUE", "CONTRARY", "SIMILAR", "END"]


def test_species_and_three_voices(spark):
    n = notes(spark, [[67, 69, 72], [64, 65, 67], [60, 62, 60]])
    full = R.check_species(n, "three_voice_species1")
    assert full.where("rule = 'key_start_rule'").select("pair").distinct().count() == 1
    assert full.select("pair").distinct().count() == 3
    minimal = R.check_species(n, "three_voice_species1_minimal")
    assert {r.rule for r in minimal.select("rule").distinct().collect()} == {"bar_consonance_rule", "next_step_rule", "parallel_rule"}
    with pytest.raises(KeyError):
        R.check_species(n, "species9")


def test_align_voices(spark):
    n = notes(spark, [[60, 62], [50, 52, 53]], {0: [2.0, 2.0], 1: [1.0, 1.0, 2.0]})
    got = [(r.voice, r.idx, r.pitch, r.dur) for r in S.align_voices(n, block_beats=1.0).orderBy("voice", "idx").collect()]
    assert got == [(0, 0, 60, 1.0), (0, 1, 60, 1.0), (0, 2, 62, 2.0), (1, 0, 50, 1.0), (1, 1, 52, 1.0), (1, 2, 53, 2.0)]


def test_quantize_and_runs(spark):
    n = notes(spark, [[60, 0, 62]], {0: [0.5, 0.25, 1.5]})
    roll = S.quantize(n, block=2)
    assert [r.symbol for r in roll.orderBy("step").collect()] == [61, 1, 0, 63, 1, 1, 1, 1, 1]
    plain = S.quantize(n, hold=False)
    runs = S.run_lengths(plain, ["piece", "voice"], max_hold=4, block=3).orderBy("start").collect()
    assert [(r.pitch, r.dur) for r in runs] == [(60, 0.5), (0, 0.25), (62, 1.0), (62, 0.5)]


def test_score_blocks(spark):
    n = notes(spark, [[60 + i % 5 for i in range(40)], [50 + i % 7 for i in range(40)]], {0: [0.5, 1.0] * 20, 1: [1.0] * 40})
    a, b = (S.with_context(S.pair_voices(n), block=k).orderBy("idx").collect() for k in (5, 1000))
    assert a == b
