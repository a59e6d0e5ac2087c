"""Counterpoint rules as columns over the context of each event, and the rule sets built from them.

A rule is a function of a context DataFrame (see ``score.with_context``) that gives a nullable boolean column: NULL means
the rule does not apply. Users add their own rules to ``RULES`` and name them in a set.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqprep.functions import music as M
from seqprep.operators.score import estimate_mode, pair_voices, with_context

# Interval lists of the rules.
OPENING = ["P12", "P8", "P5", "P1", "RP1"]
OPENING_RELAXED = OPENING + ["M10", "m10", "M6", "m6", "M3", "m3"]
FREE_SKIPS = ["P8", "-P8", "m6", "M6", "-m6", "-M6", "-M3", "-m3"]

c = F.col


def _yes_no(ok: Column) -> Column:
    return F.coalesce(ok, F.lit(False))


def key_start_rule(relaxed: bool = False, ignored: tuple = ()) -> Column:
    """The opening interval is from the list and the bass is on the mode (or rests)."""
    opens = c("interval").isin(*(OPENING_RELAXED if relaxed else OPENING))
    on_mode = (M.note_class(c("bottom")) == c("mode")) | (c("bottom") == 0)
    return F.when(c("idx") == 0, _yes_no(opens & on_mode))


def next_step_rule(relaxed: bool = False, ignored: tuple = ()) -> Column:
    """No tritone step, no step outside the named intervals, and over seven half-steps only listed skips."""
    verdict = F.lit(None).cast("boolean")
    for n, v in enumerate(("top", "bottom")):
        step = c(v) - c(f"before.{v}")
        from_rest = (F.abs(step) > 28) & (c(f"before.{v}") == 0)
        too_far = (F.abs(step) > 28) & ~from_rest
        name = M.interval_name(c(v), c(f"before.{v}"))
        ok = (
            F.when(F.abs(step) == 6, False).when(name.isin(*FREE_SKIPS), True).when(F.abs(step) > 7, False).otherwise(True)
        )
        settled = verdict.isNotNull() & ~verdict
        judged = verdict if n in ignored else F.when(settled, verdict).otherwise(ok)
        verdict = F.when(from_rest, verdict).when(too_far, F.lit(False)).otherwise(judged)
    return F.when(c("before").isNotNull(), verdict)


def leap_rule(relaxed: bool = False, ignored: tuple = ()) -> Column:
    """A leap above three half-steps is followed by an opposite step of one or two; the last judged voice counts."""
    verdict = F.lit(None).cast("boolean")
    for n, v in enumerate(("top", "bottom")):
        if n in ignored:
            continue
        jump, step = c(f"before.{v}") - c(f"before2.{v}"), c(v) - c(f"before.{v}")
        opposite = F.when(step < 0, -1).otherwise(1) != F.when(jump < 0, -1).otherwise(1)
        verdict = F.when(F.abs(jump) > 3, opposite & F.abs(step).isin(1, 2))
    return F.when(c("before2").isNotNull(), verdict)


def parallel_rule(relaxed: bool = False, ignored: tuple = ()) -> Column:
    """Perfect intervals only by contrary or oblique motion; no tenth to octave on a downbeat."""
    battuta = c("before.interval").isin("M10", "m10") & (c("interval") == "P8") & (c("beat") == 0)
    free = F.when(M.is_perfect(c("interval")), c("motion").isin("CONTRARY", "OBLIQUE")).otherwise(True)
    return F.when(c("before").isNotNull(), free if relaxed else F.when(battuta, False).otherwise(free))


def beat_parallel_rule(relaxed: bool = False, ignored: tuple = ()) -> Column:
    """The same fifth or octave on two downbeats, one event between, is forbidden unless a fifth is syncopated."""
    same = c("interval").isin("P8", "P5") & (c("before2.interval") == c("interval"))
    close = (c("beat") == 0) & (c("before2.beat") == 0) & (F.abs(M.interval_size(c("before.interval"))) < 5)
    notes = F.array("top", "bottom", "before.top", "before.bottom", "before2.top", "before2.bottom")
    syncopated = (c("interval") == "P5") & (F.size(F.array_distinct(notes)) == 4)
    return F.when(c("before").isNotNull(), F.when(_yes_no(same & close), syncopated).otherwise(True))


def bar_consonance_rule(relaxed: bool = False, ignored: tuple = ()) -> Column:
    """A dissonant downbeat resolves by one degree to a consonance at the next event."""
    degree, after = F.substring("interval", -1, 1).cast("int"), F.substring("next.interval", -1, 1).cast("int")
    resolves = M.is_consonant(c("next.interval")) & (degree != 0) & (after != 0) & (F.abs(degree - after) == 1)
    return F.when(c("beat") == 0, F.when(M.is_consonant(c("interval")), True).otherwise(_yes_no(resolves)))


def _small_steps(a: str, b: str, ignored: tuple) -> Column:
    """All judged voices move by less than three half-steps from event ``a`` to event ``b``."""
    ok = F.lit(True)
    for n, v in enumerate(("top", "bottom")):
        if n not in ignored:
            ok = ok & (F.abs(_at(b, v) - _at(a, v)) < 3)
    return ok


def _at(event: str, voice: str) -> Column:
    return c(voice) if event == "here" else c(f"{event}.{voice}")


def passing_tone_rule(relaxed: bool = False, ignored: tuple = ()) -> Column:
    """Off-beat dissonance only between small steps; NULL on the first or last event."""
    inner = c("before").isNotNull() & c("next").isNotNull()
    passing = _small_steps("before", "here", ignored) & _small_steps("here", "next", ignored)
    return F.when(
        c("beat") != 0, F.when(M.is_consonant(c("interval")), True).otherwise(F.when(inner, passing))
    )


def sequence_step_rule(relaxed: bool = False, ignored: tuple = ()) -> Column:
    """Quarter-note line: dissonance by place in the bar, resolving next or by the three-note turning figure."""
    gap = F.when((c("beat") == 0) & (c("before.beat") == 3), 1.0).otherwise(F.abs(c("beat") - c("before.beat")))
    ok = M.is_consonant(c("interval"))
    came, goes = _small_steps("before", "here", ignored), _small_steps("here", "next", ignored)
    judged = [v for n, v in enumerate(("top", "bottom")) if n not in ignored]
    wide = sum((F.when(F.abs(_at("next", v) - _at("here", v)) >= 3, 1).otherwise(0) for v in judged), F.lit(0))
    figure = (wide == 1) & _small_steps("next", "next2", ignored) & c("next2.interval").isin(*M.CONSONANT, M.REST_INTERVAL)
    continuation = came & goes & M.is_consonant(c("next.interval"))
    last = F.when(ok, True).otherwise(came & ~c("beat").isin(0.0, 2.0))
    middle = (
        F.when(ok, True)
        .when(c("beat") == 0, False)
        .when(c("beat") == 1, F.when(came & goes, M.is_consonant(c("next.interval"))).otherwise(figure))
        .otherwise(continuation)
    )
    on_quarter = c("beat").isin(0.0, 1.0, 2.0, 3.0)
    return F.when(
        c("before").isNotNull() & (gap == 1.0) & on_quarter, _yes_no(F.when(c("next").isNull(), last).otherwise(middle))
    )


RULES: dict[str, Callable[..., Column]] = {
    "key_start_rule": key_start_rule,
    "next_step_rule": next_step_rule,
    "leap_rule": leap_rule,
    "parallel_rule": parallel_rule,
    "beat_parallel_rule": beat_parallel_rule,
    "bar_consonance_rule": bar_consonance_rule,
    "passing_tone_rule": passing_tone_rule,
    "sequence_step_rule": sequence_step_rule,
}

# The rules of each set, in order.
RULE_SETS: dict[str, list[str]] = {
    "species1_minimal": ["next_step_rule", "parallel_rule", "bar_consonance_rule"],
    "species1": ["key_start_rule", "bar_consonance_rule", "next_step_rule", "parallel_rule"],
    "species2": [
        "key_start_rule", "bar_consonance_rule", "parallel_rule", "beat_parallel_rule", "next_step_rule",
        "passing_tone_rule",
    ],
    "species3": [
        "key_start_rule", "bar_consonance_rule", "parallel_rule", "beat_parallel_rule", "next_step_rule",
        "sequence_step_rule",
    ],
    "species4": [
        "key_start_rule", "bar_consonance_rule", "parallel_rule", "beat_parallel_rule", "next_step_rule",
        "sequence_step_rule",
    ],
    "three_voice_species1_minimal": ["bar_consonance_rule", "next_step_rule", "parallel_rule"],
    "three_voice_species1": ["key_start_rule", "bar_consonance_rule", "next_step_rule", "parallel_rule"],
}


def with_mode(pairs: DataFrame, notes: DataFrame) -> DataFrame:
    """mode on the first event only, where the start rule looks.

    The join is equal on (piece, idx), the keys by which the voices were paired, so paired rows are not moved again.
    """
    first = estimate_mode(notes).withColumn("idx", F.lit(0).cast("long"))
    return pairs.join(first, ["piece", "idx"], "left")


def verdicts(context: DataFrame, rules: list[str], relaxed: bool = False, ignored: tuple = ()) -> DataFrame:
    """(piece, pair, idx, rule, ok): every rule of the list in one pass over the context."""
    items = F.array(*[
        F.struct(F.lit(r).alias("rule"), RULES[r](relaxed=relaxed, ignored=ignored).alias("ok")) for r in rules
    ])
    out = context.select("piece", "pair", "idx", F.explode(items).alias("v")).select(
        "piece", "pair", "idx", "v.rule", "v.ok"
    )
    return out.where((c("pair") == 0) | (c("rule") != "key_start_rule"))


def check_species(notes: DataFrame, species: str = "species1", ignored: tuple = ()) -> DataFrame:
    """Verdicts of a named rule set; three-voice sets relax the rules, skip no voice and judge all three pairs."""
    three = species.startswith("three_voice")
    context = with_context(with_mode(pair_voices(notes, 3 if three else 2), notes))
    return verdicts(context, RULE_SETS[species], relaxed=three, ignored=() if three else ignored)


def rule_verdict(checks: DataFrame) -> DataFrame:
    """(piece, passes, checked, failed): a piece passes when every verdict is true or NULL."""
    ok = F.coalesce(c("ok"), F.lit(True))
    return checks.groupBy("piece").agg(
        F.bool_and(ok).alias("passes"), F.count("*").alias("checked"), F.count_if(~ok).alias("failed")
    )


def verdict_steps(checks: DataFrame) -> DataFrame:
    """(piece, ok, idx) without repeats: the passing and the failing steps, one row each."""
    return checks.select("piece", F.coalesce("ok", F.lit(True)).alias("ok"), "idx").distinct()


def combine_step_verdicts(checks: DataFrame) -> DataFrame:
    """Logical and per step over the rules."""
    return checks.groupBy("piece", "idx").agg(F.bool_and(F.coalesce("ok", F.lit(True))).alias("ok"))
