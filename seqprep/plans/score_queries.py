"""Queries on scores: the events of users as the notes of voices."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqprep.functions import music as M
from seqprep.operators import filters as FL
from seqprep.operators import joins as J
from seqprep.operators import rules as RU
from seqprep.operators import score as SC
from seqprep.plans import sql as Q
from seqprep.plans import views as V
from seqprep.plans.registry import query

NOTE = f"WITH {Q.notes(2)}"
TRIO = f"WITH {Q.notes(3)}"


def pairs_sql(three=False):
    one = (
        "SELECT a.piece, {n} AS pair, a.idx, a.pitch AS top, b.pitch AS bottom, a.dur FROM note a JOIN note b "
        "ON a.piece = b.piece AND a.idx = b.idx AND a.voice = {a} AND b.voice = {b}"
    )
    pairs = SC.VOICE_PAIRS[3 if three else 2]
    return "pr AS (" + " UNION ALL ".join(one.format(n=n, a=a, b=b) for n, (a, b) in enumerate(pairs)) + ")"


def context_sql(three=False):
    w = "PARTITION BY piece, pair ORDER BY idx"
    around = ", ".join(
        f"{f}({v}{', 2' if two else ''}) OVER w AS {p}{v}"
        for f, two, p in (("lag", True, "bb_"), ("lag", False, "b_"), ("lead", False, "n_"), ("lead", True, "nn_"))
        for v in ("top", "bottom", "iv", "beat")
    )
    return (
        f"{pairs_sql(three)}, c0 AS (SELECT *, {Q.interval('top', 'bottom')} AS iv, "
        f"(coalesce(sum(dur) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) % 4.0)::DOUBLE AS beat FROM pr), "
        f"c1 AS (SELECT *, {around} FROM c0 WINDOW w AS ({w})), "
        f"ctx AS (SELECT *, {Q.motion('(top - b_top)', '(bottom - b_bottom)')} AS motion FROM c1)"
    )


MODE = (
    "md AS (SELECT piece, CASE WHEN p = 0 THEN '' ELSE " + Q.words(M.NOTE_CLASSES)
    + "[p % 12 + 1] END AS mode FROM (SELECT piece, arg_max(pitch, voice * 1000000 + idx) AS p FROM note GROUP BY piece))"
)


def _in(e, names):
    return f"{e} IN ({', '.join(Q.lit(n) for n in names)})"


def step_rule(ignored=()):
    """Two voices in turn; ``v`` is the verdict so far."""
    verdict = "NULL::BOOLEAN"
    for n, v in enumerate(("top", "bottom")):
        d, name = f"({v} - b_{v})", Q.interval(v, f"b_{v}")
        ok = f"(CASE WHEN abs({d}) = 6 THEN false WHEN {_in('(' + name + ')', RU.FREE_SKIPS)} THEN true WHEN abs({d}) > 7 THEN false ELSE true END)"
        judged = verdict if n in ignored else f"(CASE WHEN ({verdict}) = false THEN false ELSE {ok} END)"
        verdict = f"(CASE WHEN abs({d}) > 28 AND b_{v} = 0 THEN {verdict} WHEN abs({d}) > 28 THEN false ELSE {judged} END)"
    return f"CASE WHEN b_top IS NOT NULL THEN {verdict} END"


def small(a, b, ignored=()):
    at = lambda p, v: f"{p}{v}"
    parts = [f"abs({at(b, v)} - {at(a, v)}) < 3" for n, v in enumerate(("top", "bottom")) if n not in ignored]
    return "(" + " AND ".join(parts) + ")"


def wide(ignored=()):
    return "(" + " + ".join(f"coalesce((abs(n_{v} - {v}) >= 3)::INT, 0)" for n, v in enumerate(("top", "bottom")) if n not in ignored) + ")"


def leap_rule_sql(ignored=()):
    last = [v for n, v in enumerate(("top", "bottom")) if n not in ignored][-1]
    j, s = f"(b_{last} - bb_{last})", f"({last} - b_{last})"
    return f"CASE WHEN bb_top IS NOT NULL AND abs({j}) > 3 THEN (CASE WHEN {s} < 0 THEN -1 ELSE 1 END <> CASE WHEN {j} < 0 THEN -1 ELSE 1 END) AND abs({s}) IN (1, 2) END"


def rule_sql(name, relaxed=False, ignored=()):
    ok = Q.consonant("iv")
    came, goes = small("b_", "", ignored), small("", "n_", ignored)
    names = [*M.CONSONANT, M.REST_INTERVAL]
    return {
        "key_start_rule": f"CASE WHEN idx = 0 THEN coalesce({_in('iv', RU.OPENING_RELAXED if relaxed else RU.OPENING)} AND "
        f"(bottom = 0 OR {Q.words(M.NOTE_CLASSES)}[bottom % 12 + 1] = mode), false) END",
        "next_step_rule": step_rule(ignored),
        "leap_rule": leap_rule_sql(ignored),
        "parallel_rule": "CASE WHEN b_top IS NOT NULL THEN "
        + ("" if relaxed else "CASE WHEN b_iv IN ('M10', 'm10') AND iv = 'P8' AND beat = 0 THEN false ELSE ")
        + f"CASE WHEN {Q.perfect('iv')} THEN motion IN ('CONTRARY', 'OBLIQUE') ELSE true END" + ("" if relaxed else " END") + " END",
        "beat_parallel_rule": "CASE WHEN b_top IS NOT NULL THEN CASE WHEN coalesce(iv IN ('P8', 'P5') AND bb_iv = iv AND beat = 0 AND bb_beat = 0 AND "
        f"abs(list_position({Q.INTERVAL_NAMES}, ltrim(b_iv, '-')) - 1) < 5, false) THEN iv = 'P5' AND len(list_distinct([top, bottom, b_top, b_bottom, bb_top, bb_bottom])) = 4 ELSE true END END",
        "bar_consonance_rule": f"CASE WHEN beat = 0 THEN CASE WHEN {ok} THEN true ELSE coalesce({Q.consonant('n_iv')} AND right(iv, 1) <> '0' AND right(n_iv, 1) <> '0' AND "
        "abs(right(iv, 1)::INT - right(n_iv, 1)::INT) = 1, false) END END",
        "passing_tone_rule": f"CASE WHEN beat <> 0 THEN CASE WHEN {ok} THEN true WHEN b_top IS NOT NULL AND n_top IS NOT NULL THEN {came} AND {goes} END END",
        "sequence_step_rule": "CASE WHEN b_top IS NOT NULL AND (CASE WHEN beat = 0 AND b_beat = 3 THEN 1.0 ELSE abs(beat - b_beat) END) = 1.0 AND beat IN (0, 1, 2, 3) THEN coalesce("
        f"CASE WHEN {ok} THEN true WHEN n_top IS NULL THEN {came} AND beat NOT IN (0, 2) WHEN beat = 0 THEN false "
        f"WHEN beat = 1 THEN CASE WHEN {came} AND {goes} THEN {Q.consonant('n_iv')} ELSE {wide(ignored)} = 1 AND {small('n_', 'nn_', ignored)} AND {_in('nn_iv', names)} END "
        f"ELSE {came} AND {goes} AND {Q.consonant('n_iv')} END, false) END",
    }[name]


def verdict_sql(rules, relaxed=False, ignored=(), three=False):
    base = TRIO if three else NOTE
    picks = " UNION ALL ".join(
        f"SELECT piece, pair, idx, {Q.lit(n)} AS rule, {rule_sql(n, relaxed, ignored)} AS ok FROM m"
        + (" WHERE pair = 0" if n == "key_start_rule" else "") for n in rules
    )
    return f"{base}, {context_sql(three)}, {MODE}, m AS (SELECT ctx.*, md.mode FROM ctx JOIN md USING (piece)), v AS ({picks})"


def named(checks):
    return checks.select("piece", "pair", "idx", "rule", F.coalesce(F.col("ok").cast("string"), F.lit("none")).alias("verdict"))


def rule_query(name, rule, ignored=()):
    @query(name, f"{verdict_sql([rule], ignored=ignored)} SELECT piece, pair, idx, rule, coalesce(ok::VARCHAR, 'none') AS verdict FROM v")
    def run(spark, folder):
        n = V.notes(spark, folder)
        ctx = SC.with_context(RU.with_mode(SC.pair_voices(n), n))
        return named(RU.verdicts(ctx, [rule], ignored=ignored))


for _rule, _ignored in (
    ("key_start_rule", ()), ("next_step_rule", (1,)), ("leap_rule", ()), ("parallel_rule", ()), ("beat_parallel_rule", ()),
    ("bar_consonance_rule", ()), ("passing_tone_rule", (1,)), ("sequence_step_rule", (1,)),
):
    rule_query(f"score_{_rule}", _rule, _ignored)


def species_query(species, ignored=(0,)):
    three = species.startswith("three")
    sql = verdict_sql(RU.RULE_SETS[species], three, () if three else ignored, three)

    @query(f"score_check_{species}", f"{sql} SELECT piece, bool_and(coalesce(ok, true)) AS passes, count(*)::BIGINT AS checked, count(*) FILTER (WHERE NOT coalesce(ok, true))::BIGINT AS failed FROM v GROUP BY piece")
    def run(spark, folder):
        notes = V.notes_of(V.signal(spark, folder), 3) if three else V.notes(spark, folder)
        return RU.rule_verdict(RU.check_species(notes, species, ignored))


for _species in RU.RULE_SETS:
    species_query(_species)


@query("score_verdict_steps", f"{verdict_sql(RU.RULE_SETS['species1'])} SELECT DISTINCT piece, coalesce(ok, true) AS ok, idx FROM v")
def verdict_steps(spark, folder):
    return RU.verdict_steps(RU.check_species(V.notes(spark, folder), "species1"))


@query("score_combine_step_verdicts", f"{verdict_sql(RU.RULE_SETS['species2'])} SELECT piece, idx, bool_and(coalesce(ok, true)) AS ok FROM v GROUP BY ALL")
def combine_step_verdicts(spark, folder):
    return RU.combine_step_verdicts(RU.check_species(V.notes(spark, folder), "species2"))


@query("score_custom_rule", f"{NOTE}, {context_sql()} SELECT piece, pair, idx, 'no_unison' AS rule, CASE WHEN idx = 0 THEN 'none' WHEN top <> bottom THEN 'true' ELSE 'false' END AS verdict FROM ctx")
def custom_rule(spark, folder):
    RU.RULES["no_unison"] = lambda relaxed=False, ignored=(): F.when(F.col("idx") > 0, F.col("top") != F.col("bottom"))
    return named(RU.verdicts(SC.with_context(SC.pair_voices(V.notes(spark, folder))), ["no_unison"]))


@query("score_pair_voices", f"{TRIO}, {pairs_sql(True)} SELECT * FROM pr")
def pair_voices(spark, folder):
    return SC.pair_voices(V.notes_of(V.signal(spark, folder), 3), 3)


@query("score_intervals", f"{TRIO}, {context_sql(True)} SELECT piece, pair, idx, iv AS interval FROM ctx")
def intervals(spark, folder):
    x = SC.pair_voices(V.notes_of(V.signal(spark, folder), 3), 3)
    return x.select("piece", "pair", "idx", M.interval_name(F.col("top"), F.col("bottom")).alias("interval"))


@query("score_motion", f"{NOTE}, {context_sql()} SELECT piece, pair, idx, motion FROM ctx UNION ALL SELECT piece, pair, max(idx) + 1, 'END' FROM ctx GROUP BY piece, pair")
def motion(spark, folder):
    return SC.motion_list(SC.with_context(SC.pair_voices(V.notes(spark, folder))))


@query("score_transition", f"""{NOTE}, {context_sql()}, t AS (SELECT *, lag(motion) OVER (PARTITION BY piece, pair ORDER BY idx) AS lm FROM ctx)
SELECT piece, pair, idx, CASE WHEN b_iv IS NOT NULL THEN concat_ws(':', lm, b_iv, concat_ws(',', {Q.note_name('b_top')}, {Q.note_name('b_bottom')})) ELSE 'KC,' || concat_ws(',', {Q.note_name('top')}, {Q.note_name('bottom')}) END
 || '->' || concat_ws(':', motion, iv, concat_ws(',', {Q.note_name('top')}, {Q.note_name('bottom')})) AS line FROM t""")
def transition(spark, folder):
    t = SC.transitions(SC.with_context(SC.pair_voices(V.notes(spark, folder))))
    return SC.transition_text(t).select("piece", "pair", "idx", "line")


@query("score_onset_beats", f"{NOTE} SELECT piece, voice, idx, (coalesce(sum(dur) OVER (PARTITION BY piece, voice ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) % 4.0)::DOUBLE AS beat FROM note")
def onset_beats(spark, folder):
    return SC.onset_beats(V.notes(spark, folder), ["piece", "voice"]).select("piece", "voice", "idx", "beat")


@query("score_note_times", f"{NOTE} SELECT piece, voice, idx, sum(dur) OVER (PARTITION BY piece, voice ORDER BY idx) AS end_time FROM note")
def note_times(spark, folder):
    return SC.note_times(V.notes(spark, folder)).select("piece", "voice", "idx", "end_time")


@query("score_estimate_mode", f"{NOTE}, {MODE} SELECT piece, mode FROM md")
def estimate_mode(spark, folder):
    return SC.estimate_mode(V.notes(spark, folder))


SNAP = "[" + ", ".join(f"{g!r}::DOUBLE" for g in SC.snap_gaps()) + "]"
ALIGNED = f"""{NOTE}, t AS (SELECT *, sum(dur) OVER (PARTITION BY piece, voice ORDER BY idx) AS e FROM note), o AS (SELECT piece, voice, pitch, e - dur AS onset FROM t),
u AS (SELECT DISTINCT piece, onset FROM o), l AS (SELECT piece, max(e) AS last FROM t GROUP BY piece), vc AS (SELECT DISTINCT piece, voice FROM note),
g AS (SELECT piece, onset, row_number() OVER w - 1 AS idx, coalesce(lead(onset) OVER w, last) - onset AS gap FROM u JOIN l USING (piece) WINDOW w AS (PARTITION BY piece ORDER BY onset)),
al AS (SELECT g.piece, vc.voice, g.idx, last_value(o.pitch IGNORE NULLS) OVER (PARTITION BY g.piece, vc.voice ORDER BY g.idx) AS pitch,
 {SNAP}[list_position(list_transform({SNAP}, lambda c: abs(c - gap)), list_min(list_transform({SNAP}, lambda c: abs(c - gap))))] AS dur
 FROM g JOIN vc USING (piece) LEFT JOIN o ON o.piece = g.piece AND o.voice = vc.voice AND o.onset = g.onset)"""


@query("score_align_voices", f"{ALIGNED} SELECT piece, voice, idx, pitch, dur FROM al")
def align_voices(spark, folder):
    return SC.align_voices(V.notes(spark, folder))


@query("score_fixup_parts", f"""{ALIGNED}, cnt AS (SELECT piece FROM (SELECT piece, voice, count(*) AS n FROM note GROUP BY ALL) GROUP BY piece HAVING min(n) <> max(n))
SELECT piece, voice, idx, pitch, dur FROM al WHERE piece IN (SELECT piece FROM cnt) UNION ALL SELECT piece, voice, idx, pitch, dur FROM note WHERE piece NOT IN (SELECT piece FROM cnt)""")
def fixup_parts(spark, folder):
    return SC.fixup_parts(V.notes(spark, folder))


GRID = f"""{NOTE}, q AS (SELECT *, greatest(floor(dur / 0.25)::INT, 1) AS n FROM note), s AS (SELECT *, sum(n) OVER (PARTITION BY piece, voice ORDER BY idx) - n AS a FROM q),
cell AS (SELECT piece, voice, (a + i)::BIGINT AS step, CASE WHEN i > 0 THEN 1 WHEN pitch = 0 THEN 0 ELSE pitch + 1 END AS symbol, pitch, fermata FROM (SELECT *, unnest(range(0, n)) AS i FROM s)),
len AS (SELECT piece, min(m) AS m FROM (SELECT piece, voice, max(step) + 1 AS m FROM cell GROUP BY ALL) GROUP BY piece),
roll AS (SELECT cell.* FROM cell JOIN len USING (piece) WHERE step < m)"""


@query("score_quantize", f"{GRID} SELECT piece, voice, step, symbol, fermata FROM roll")
def quantize(spark, folder):
    return SC.quantize(V.notes(spark, folder))


@query("score_quantize_plain", f"{GRID} SELECT piece, voice, step, pitch AS symbol, fermata FROM roll")
def quantize_plain(spark, folder):
    return SC.quantize(V.notes(spark, folder), hold=False)


@query("score_quantize_warnings", f"{NOTE} SELECT piece, count(*) FILTER (WHERE dur / 0.5 <> floor(dur / 0.5))::BIGINT AS uneven, count(*)::BIGINT AS notes FROM note GROUP BY piece")
def quantize_warnings(spark, folder):
    return SC.quantize_warnings(V.notes(spark, folder), 0.5)


@query("score_collapse_fermatas", f"{GRID} SELECT piece, step, max(fermata) AS fermata FROM roll GROUP BY ALL")
def collapse_fermatas(spark, folder):
    return SC.collapse_fermatas(SC.quantize(V.notes(spark, folder)))


@query("score_subbeat", f"{GRID} SELECT DISTINCT piece, step, (step % 4 + 1)::INT AS subbeat FROM roll")
def subbeat(spark, folder):
    x = SC.quantize(V.notes(spark, folder)).select("piece", "step").distinct()
    return x.withColumn("subbeat", SC.subbeat(F.col("step")))


@query("score_run_lengths", f"""{GRID}, c AS (SELECT piece, voice, step, pitch, CASE WHEN pitch = lag(pitch) OVER w THEN 0 ELSE 1 END AS new FROM roll WINDOW w AS (PARTITION BY piece, voice ORDER BY step)),
d AS (SELECT *, sum(new) OVER (PARTITION BY piece, voice ORDER BY step) AS island FROM c), e AS (SELECT *, step - min(step) OVER (PARTITION BY piece, voice, island) AS i FROM d)
SELECT piece, voice, min(step) AS start, any_value(pitch) AS pitch, count(*) * 0.25::DOUBLE AS dur FROM e GROUP BY piece, voice, island, i // 4""")
def run_lengths(spark, folder):
    return SC.run_lengths(SC.quantize(V.notes(spark, folder), hold=False), ["piece", "voice"])


def chords(sig):
    return sig.select(
        F.expr("utt div 2").alias("piece"), (F.col("pos") * 2 + F.col("utt") % 2).alias("idx"), F.col("event_type").alias("chord"),
        (F.col("event_id") % 7).cast("string").alias("function"), F.element_at(F.array(F.lit(0.5), F.lit(1.0), F.lit(4.0)), (F.col("event_id") % 3 + 1).cast("int")).alias("dur"),
    )


CHORDS = """ch AS (SELECT utt // 2 AS piece, pos * 2 + utt % 2 AS idx, event_type AS chord, (event_id % 7)::VARCHAR AS function, [0.5, 1.0, 4.0][event_id % 3 + 1]::DOUBLE AS dur FROM signal),
cg AS (SELECT piece, (a + i)::BIGINT AS step, chord, function FROM (SELECT *, unnest(range(0, n)) AS i FROM (SELECT *, sum(n) OVER (PARTITION BY piece ORDER BY idx) - n AS a FROM (SELECT *, floor(dur / 0.25)::INT AS n FROM ch))))"""


@query("score_attach_chords", f"WITH {Q.SIGNAL}, {CHORDS} SELECT * FROM cg")
def attach_chords(spark, folder):
    return SC.attach_chords(chords(V.signal(spark, folder))).withColumn("step", F.col("step").cast("long"))


@query("score_quantized_corpus", f"""{GRID}, {CHORDS}, f AS (SELECT piece, step, max(fermata) AS fermata FROM roll GROUP BY ALL), two AS (SELECT piece FROM note GROUP BY piece HAVING count(DISTINCT voice) = 2)
SELECT r.piece, r.voice, r.step, r.symbol AS pitch_hold, r.pitch, f.fermata, cg.chord, cg.function, (r.step % 4 + 1)::INT AS subbeat
FROM roll r JOIN two USING (piece) JOIN f USING (piece, step) LEFT JOIN cg USING (piece, step)""")
def quantized_corpus(spark, folder):
    sig = V.signal(spark, folder)
    return SC.quantized_corpus(V.notes_of(sig, 2), chords(sig), 2)


@query("score_transpose", f"""{NOTE} SELECT piece, voice, idx, CASE WHEN pitch = 0 THEN 0 ELSE pitch + half END AS pitch FROM (
 SELECT *, CASE WHEN piece % 2 = 0 THEN [{', '.join(str(v) for v in M.MAJOR_SHIFT.values())}][(piece % 14 + 1)] ELSE [{', '.join(str(v) for v in M.MINOR_SHIFT.values())}][(piece % 14 + 1)] END AS half FROM note)""")
def transpose(spark, folder):
    n = V.notes(spark, folder)
    tonic = F.element_at(F.array(*map(F.lit, M.MAJOR_SHIFT)), (F.col("piece") % 14 + 1).cast("int"))
    half = M.transpose_offset(tonic, F.when(F.col("piece") % 2 == 0, "major").otherwise("minor"))
    return n.select("piece", "voice", "idx", F.when(F.col("pitch") == 0, 0).otherwise(F.col("pitch") + half).alias("pitch"))


@query("score_note_names", f"""{NOTE} SELECT piece, voice, idx, {Q.note_name('pitch')} AS note, pitch AS back FROM note""")
def note_names(spark, folder):
    n = V.notes(spark, folder).select("piece", "voice", "idx", M.midi_to_note(F.col("pitch")).alias("note"))
    return n.withColumn("back", M.note_to_midi(F.col("note")))


@query("score_duration_names", f"""{NOTE} SELECT piece, voice, idx, CASE dur WHEN 0.25 THEN '16th' WHEN 0.5 THEN '8th' WHEN 1.0 THEN '1' WHEN 2.0 THEN '2' END AS name, dur AS back FROM note""")
def duration_names(spark, folder):
    n = V.notes(spark, folder).select("piece", "voice", "idx", M.duration_name(F.col("dur")).alias("name"))
    return n.withColumn("back", M.duration_value(F.col("name")))


@query("filter_equal_voices", f"WITH {Q.notes(4)}, k AS (SELECT piece FROM note GROUP BY piece HAVING count(DISTINCT voice) = 4) SELECT piece, voice, idx, pitch FROM note JOIN k USING (piece)")
def equal_voices(spark, folder):
    n = V.notes_of(V.signal(spark, folder), 4)
    return FL.equal_voice_filter(n, 4).select("piece", "voice", "idx", "pitch")


@query("filter_exclude_invalids", f"{NOTE} SELECT piece, voice, idx, pitch FROM note WHERE piece NOT IN (SELECT piece FROM note WHERE pitch = 0 AND idx = 0)")
def exclude_invalids(spark, folder):
    n = V.notes(spark, folder)
    return J.exclude_invalids(n, n.where("pitch = 0 and idx = 0").select("piece").distinct(), ["piece"]).select("piece", "voice", "idx", "pitch")


@query("filter_chord_only_part", f"""
WITH {Q.SIGNAL}, e AS (SELECT utt AS piece, pos // 3 AS part, pos % 3 AS idx, x > 30 AS is_chord FROM signal), k AS (SELECT piece, part FROM e GROUP BY ALL HAVING NOT bool_and(is_chord)) SELECT e.* FROM e JOIN k USING (piece, part)""")
def chord_only_part(spark, folder):
    e = V.signal(spark, folder).select(F.col("utt").alias("piece"), F.expr("pos div 3").alias("part"), (F.col("pos") % 3).alias("idx"), (F.col("x") > 30).alias("is_chord"))
    return FL.chord_only_part_filter(e)


@query("filter_score", f"""{NOTE}, p AS (SELECT DISTINCT piece, CASE WHEN piece % 3 = 0 THEN 'dorian' WHEN piece % 3 = 1 THEN 'major' ELSE 'minor' END AS mode FROM note),
g AS (SELECT piece, CASE WHEN dur = 2.0 THEN '3/8' WHEN dur = 1.0 THEN '4/4' ELSE '3/4' END AS ts FROM note WHERE pitch = 71), h AS (SELECT piece, min(ts) AS ts, count(DISTINCT right(ts, 1)) AS k FROM g GROUP BY piece)
SELECT p.piece, p.mode, coalesce(h.ts, '4/4') AS time_sig FROM p LEFT JOIN h USING (piece) WHERE p.mode <> 'dorian' AND coalesce(k, 1) = 1""")
def score_filter(spark, folder):
    n = V.notes(spark, folder)
    mode = F.when(F.col("piece") % 3 == 0, "dorian").when(F.col("piece") % 3 == 1, "major").otherwise("minor")
    pieces = n.select("piece").distinct().withColumn("mode", mode)
    sig = n.where("pitch = 71").select("piece", F.when(F.col("dur") == 2.0, "3/8").when(F.col("dur") == 1.0, "4/4").otherwise("3/4").alias("time_sig"))
    return FL.score_filters(pieces, sig)
