"""Scores as tables: note(piece, voice, idx, pitch, dur, fermata) with dense idx per voice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqprep.functions import music as M
from seqprep.operators.blocks import BLOCK, local_window, lookup_join, running, spread
from seqprep.scratch import written

# Compared voice pairs, by number of voices.
VOICE_PAIRS = {2: [(0, 1)], 3: [(0, 2), (1, 2), (0, 1)]}
# The short onset gaps that aligned voices snap to, and the beats whose sums of three are the longer ones.
SHORT_GAPS = [0.0, 0.0625, 0.125]
BEATS = [0.25, 0.5, 1.0, 2.0, 4.0]


def snap_gaps() -> list[float]:
    """In the order that settles ties: the first of two equally near gaps wins."""
    return SHORT_GAPS + list(dict.fromkeys(a + b + c for a in BEATS for b in BEATS for c in BEATS))


def nearest(value: Column, centers: list[float], symbols: list | None = None) -> Column:
    """The nearest center (or its symbol); ties go to the earlier one."""
    items = F.array(*[
        F.struct(F.abs(F.lit(float(c)) - value).alias("d"), F.lit(i).alias("i"), F.lit(symbols[i] if symbols else float(c)).alias("s"))
        for i, c in enumerate(centers)
    ])
    return F.array_min(items)["s"]


# Pause lengths in seconds and the symbols that stand for them.
TIMING_CENTERS = [0.0, 0.01, 0.02, 0.08, 0.25]
TIMING_SYMBOLS = [" ", "1", "2", "3", "4"]


def nearest_timing_symbol(seconds: Column) -> Column:
    """The symbol of the nearest pause length; ties go to the shorter one, null stays null."""
    return F.when(seconds.isNotNull(), nearest(seconds, TIMING_CENTERS, TIMING_SYMBOLS))


def pair_voices(notes: DataFrame, voices: int = 2) -> DataFrame:
    """pair(piece, pair, idx, top, bottom, dur): voices of a piece side by side, equal join on (piece, idx)."""
    pairs = VOICE_PAIRS[voices]
    out = None
    for n, (a, b) in enumerate(pairs):
        top = notes.where(F.col("voice") == a).select("piece", "idx", F.col("pitch").alias("top"), "dur")
        bottom = notes.where(F.col("voice") == b).select("piece", "idx", F.col("pitch").alias("bottom"))
        one = top.join(bottom, ["piece", "idx"]).withColumn("pair", F.lit(n))
        out = one if out is None else out.unionByName(one)
    return out


def onset_beats(rows: DataFrame, keys: list[str], bar: float = 4.0, block: int = BLOCK) -> DataFrame:
    """beat: running start time modulo the bar."""
    out = running(rows, keys, {"_start": ("sum", F.col("dur"))}, order=("idx",), inclusive=False, block=block)
    return out.withColumn("beat", F.coalesce("_start", F.lit(0.0)) % bar).drop("_start")


def note_times(notes: DataFrame, block: int = BLOCK) -> DataFrame:
    """end_time: running end of each note."""
    return running(notes, ["piece", "voice"], {"end_time": ("sum", F.col("dur"))}, order=("idx",), block=block)


def with_context(pairs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Everything the rules look at: intervals, motion, beats and up to two events around each event."""
    keys = ["piece", "pair"]
    x = onset_beats(pairs, keys, block=block).withColumn("interval", M.interval_name(F.col("top"), F.col("bottom")))
    here = F.struct("top", "bottom", "interval", "beat")
    x = local_window(
        x, keys, 2, 2,
        {
            "before2": lambda w: F.lag(here, 2).over(w), "before": lambda w: F.lag(here, 1).over(w),
            "next": lambda w: F.lead(here, 1).over(w), "next2": lambda w: F.lead(here, 2).over(w),
        },
        pos="idx", block=block,
    )
    return x.withColumn("motion", M.motion(F.col("top") - F.col("before.top"), F.col("bottom") - F.col("before.bottom")))


def transitions(context: DataFrame) -> DataFrame:
    """Previous and current interval, motion and notes of each event."""
    x = local_window(context, ["piece", "pair"], 1, 0, {"last_motion": lambda w: F.lag("motion").over(w)}, pos="idx")
    return x.select(
        "piece", "pair", "idx", "last_motion", F.col("before.interval").alias("last_interval"),
        M.midi_to_note(F.col("before.top")).alias("last_top"), M.midi_to_note(F.col("before.bottom")).alias("last_bottom"),
        "motion", "interval", M.midi_to_note(F.col("top")).alias("top_note"), M.midi_to_note(F.col("bottom")).alias("bottom_note"),
    )


def transition_text(t: DataFrame, key: str = "C") -> DataFrame:
    """The transitions as one line of text each."""
    now = F.concat_ws(":", "motion", "interval", F.concat_ws(",", "top_note", "bottom_note"))
    then = F.when(
        F.col("last_interval").isNotNull(),
        F.concat_ws(":", "last_motion", "last_interval", F.concat_ws(",", "last_top", "last_bottom")),
    ).otherwise(F.concat(F.lit(f"K{key},"), F.concat_ws(",", "top_note", "bottom_note")))
    return t.withColumn("line", F.concat(then, F.lit("->"), now))


def motion_list(context: DataFrame) -> DataFrame:
    """(piece, pair, idx, motion), closed by an END after the last event."""
    moves = context.select("piece", "pair", "idx", "motion")
    ends = context.groupBy("piece", "pair").agg((F.max("idx") + 1).alias("idx")).withColumn("motion", F.lit("END"))
    return moves.unionByName(ends)


def estimate_mode(notes: DataFrame) -> DataFrame:
    """mode: note class of the last note of the lowest voice of each piece."""
    return notes.groupBy("piece").agg(
        M.note_class(F.max_by("pitch", F.struct("voice", "idx"))).alias("mode")
    )


def align_voices(notes: DataFrame, block_beats: float = 65536.0) -> DataFrame:
    """All voices on the union of their onsets: aligned(piece, voice, idx, pitch, dur).

    Each voice carries its sounding pitch forward. New durations are the gaps between onsets, snapped to exact values;
    the last gap runs to the end of the longest voice. Work is blocked by onset time, which bounds the rows of a block
    because durations have a least value.
    """
    timed = running(notes, ["piece", "voice"], {"end_time": ("sum", F.col("dur"))}, order=("idx",))
    # timed notes, onsets and the grid are each read several times below: written once
    timed = written(timed.select("piece", "voice", "pitch", "end_time", (F.col("end_time") - F.col("dur")).alias("onset")), "timed")
    ends = timed.groupBy("piece", "voice").agg(F.max("end_time").alias("end_time"))
    voices = ends.select("piece", "voice")
    last = ends.groupBy("piece").agg(F.max("end_time").alias("onset"))
    blk = F.floor(F.col("onset") / block_beats)

    marks = timed.select("piece", "onset").distinct()
    steps = running(marks, ["piece"], {"_n": ("sum", F.lit(1))}, order=("onset",), blk=blk)
    steps = written(steps.withColumn("idx", (F.col("_n") - 1).cast("long")).drop("_n"), "onsets")
    tail = steps.groupBy("piece").agg((F.max("idx") + 1).alias("idx")).join(last, "piece")
    gaps = local_window(
        steps.unionByName(tail), ["piece"], 0, 1, {"_next": lambda w: F.lead("onset").over(w)}, pos="idx"
    ).where("_next is not null")
    gaps = gaps.select("piece", "idx", "onset", nearest(F.round(F.col("_next") - F.col("onset"), 4), snap_gaps()).alias("dur"))

    # every block of a piece's onsets meets its voices, so a long piece is many join keys
    per_block = spread(voices.join(tail.select("piece", F.expr(f"idx div {BLOCK}").alias("_top")), "piece"), "_top", "_b").drop("_top")
    grid = gaps.withColumn("_b", F.expr(f"idx div {BLOCK}")).join(per_block, ["piece", "_b"]).drop("_b").join(
        timed.select("piece", "voice", "onset", F.col("pitch").alias("_p")), ["piece", "voice", "onset"], "left"
    )
    grid = written(grid.select("piece", "voice", "idx", "dur", "_p"), "grid")
    return running(grid, ["piece", "voice"], {"pitch": ("last", F.col("_p"))}, order=("idx",)).select(
        "piece", "voice", "idx", "pitch", "dur"
    )


def fixup_parts(notes: DataFrame) -> DataFrame:
    """Align the voices of the pieces whose first two voices have unequal numbers of notes; others pass unchanged."""
    per_voice = notes.where(F.col("voice") < 2).groupBy("piece", "voice").agg(F.count("*").alias("_n"))
    uneven = per_voice.groupBy("piece").agg(F.min("_n").alias("_a"), F.max("_n").alias("_b")).where("_a <> _b").select("piece")
    columns = ["piece", "voice", "idx", "pitch", "dur"]
    even = lookup_join(notes.select(*columns), uneven, ["piece"], "left_anti")
    odd = lookup_join(notes, uneven, ["piece"], "left_semi")
    return even.unionByName(align_voices(odd).select(*columns))


def quantize(notes: DataFrame, step: float = 0.25, hold: bool = True, block: int = BLOCK) -> DataFrame:
    """roll(piece, voice, step, symbol, fermata): notes on a grid, voices cut to the shortest."""
    return _rolled(notes, step, {"symbol": hold}, block)


def _rolled(notes: DataFrame, step: float, symbols: dict[str, bool], block: int = BLOCK) -> DataFrame:
    """(piece, voice, step, symbols, fermata): held and plain symbols of a note come from one explode.

    A note shorter than a step takes a cell if it is held; beside a held symbol a plain one has the same cells.
    """
    grid = lambda hold: M.quantize_note(F.col("pitch"), F.col("dur"), step, hold)
    beside = F.array_repeat("pitch", F.size(grid(True))) if any(symbols.values()) else grid(False)
    grids = [(grid(True) if hold else beside).alias(name) for name, hold in symbols.items()]
    x = notes.select("piece", "voice", "idx", "fermata", *grids).withColumn("_grid", F.arrays_zip(*symbols)).drop(*symbols).where(F.size("_grid") > 0)
    x = running(x, ["piece", "voice"], {"_end": ("sum", F.size("_grid"))}, order=("idx",), block=block)
    x = written(x.select("piece", "voice", "fermata", "_end", "_grid"), "quantized")
    shortest = x.groupBy("piece", "voice").agg(F.max("_end").alias("_len")).groupBy("piece").agg(F.min("_len").alias("_len"))
    cells = x.select(
        "piece", "voice", "fermata", (F.col("_end") - F.size("_grid")).alias("_start"), F.posexplode("_grid").alias("_i", "_g")
    ).select("piece", "voice", (F.col("_start") + F.col("_i")).cast("long").alias("step"), *[F.col("_g")[n].alias(n) for n in symbols], "fermata")
    lengths = spread(shortest.withColumn("_top", F.expr(f"(_len - 1) div {block}")), "_top", "_b").drop("_top")
    return (
        cells.withColumn("_b", F.expr(f"step div {block}")).join(lengths, ["piece", "_b"]).where("step < _len").drop("_b", "_len")
    )


def attach_chords(chords: DataFrame, step: float = 0.25, block: int = BLOCK) -> DataFrame:
    """chord(piece, idx, chord, function, dur) held on the grid: (piece, step, chord, function)."""
    x = chords.withColumn("_n", F.floor(F.col("dur") / step).cast("int")).where("_n > 0")
    x = running(x, ["piece"], {"_end": ("sum", F.col("_n"))}, order=("idx",), block=block)
    return x.select(
        "piece", F.explode(F.expr("sequence(_end - _n, _end - 1)")).alias("step"), "chord", "function"
    )


def collapse_fermatas(roll: DataFrame) -> DataFrame:
    return roll.groupBy("piece", "step").agg(F.max("fermata").alias("fermata"))


def subbeat(step: Column) -> Column:
    return (F.pmod(step, F.lit(4)) + 1).cast("int")


def quantize_warnings(notes: DataFrame, step: float = 0.25) -> DataFrame:
    """Notes per piece whose duration is not a multiple of the grid."""
    d = F.col("dur") / step
    return notes.groupBy("piece").agg(F.count_if(d != F.floor(d)).alias("uneven"), F.count("*").alias("notes"))


def run_lengths(roll: DataFrame, keys: list[str], bin_size: float = 0.25, max_hold: int = 4, block: int = BLOCK) -> DataFrame:
    """(keys, idx, pitch, dur): equal neighbours compressed; a run longer than ``max_hold`` steps is broken."""
    x = local_window(roll.select(*keys, "step", "symbol"), keys, 1, 0, {"_prev": lambda w: F.lag("symbol").over(w)}, pos="step", block=block)
    start = F.when(F.col("_prev").isNull() | (F.col("_prev") != F.col("symbol")), F.col("step"))
    x = running(x, keys, {"_start": ("last", start)}, order=("step",), block=block)
    x = x.withColumn("_piece", F.expr(f"(step - _start) div {max_hold}"))
    return x.groupBy(*keys, "_start", "_piece").agg(
        F.first("symbol").alias("pitch"), (F.count("*") * F.lit(bin_size)).alias("dur")
    ).select(*keys, (F.col("_start") + F.col("_piece") * max_hold).alias("start"), "pitch", "dur")


def quantized_corpus(notes: DataFrame, chords: DataFrame, voices: int, step: float = 0.25) -> DataFrame:
    """All grid columns of the pieces that have exactly ``voices`` voices."""
    from seqprep.operators.filters import equal_voice_filter

    roll = written(_rolled(equal_voice_filter(notes, voices), step, {"pitch_hold": True, "pitch": False}), "roll")
    return (
        roll.drop("fermata").join(collapse_fermatas(roll), ["piece", "step"])
        .join(attach_chords(chords, step), ["piece", "step"], "left")
        .withColumn("subbeat", subbeat(F.col("step")))
    )
