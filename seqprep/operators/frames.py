"""Signals as tables signal(utt, pos, x): sliding windows, frames, overlap-add, trimming and voice activity.

``pos`` is dense from 0 per utterance. Every step works per (utterance, block) or per (utterance, frame), so one long
recording is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqprep.functions.text import let
from seqprep.operators.blocks import BLOCK, local_window, running, with_totals
from seqprep.operators.runs import floats, map_runs, overlap_sum, sliding_max, sliding_mean, value_runs
from seqprep.scratch import written

FRAME_RUN = 1 << 13


def rolling_mean(signal: DataFrame, keys: list[str], size: int, block: int = 1 << 16) -> DataFrame:
    """Mean over full windows only; row k is the window that ends at pos k + size - 1.

    A window is a difference of prefix sums, so its size does not matter. Nulls are left out; a window of nulls is null.
    """
    runs = value_runs(signal.withColumn("x", F.col("x").cast("double")), keys, max(block, size), before=size - 1)

    def means(row: dict) -> tuple | None:
        if len(row["_v"]) < size:
            return None
        x, first = row["_v"].field("v"), row["_v"].field("pos")[0].as_py()
        mean, any_value = sliding_mean(floats(x), x.is_valid().to_numpy(zero_copy_only=False), size)
        return np.arange(first, first + len(mean)), pa.array(mean, mask=~any_value)

    return map_runs(runs, keys, "pos long, mean double", means)


def rolling_window(signal: DataFrame, keys: list[str], size: int, step: int = 1, block: int = 1 << 13) -> DataFrame:
    """(keys, window, values): full sliding windows, every ``step``-th one, cut from runs of samples."""
    return _cut(signal, keys, size, step, False, None, block).withColumnRenamed("frame", "window")


def unwindow(windows: DataFrame, keys: list[str], step: int) -> DataFrame:
    """The mean of each window, repeated ``step`` times."""
    mean = F.aggregate("values", F.lit(0.0), lambda a, v: a + v) / F.size("values")
    return windows.select(*keys, "window", F.explode(F.sequence(F.lit(0), F.lit(step - 1))).alias("_i"), mean.alias("x")).select(
        *keys, (F.col("window") * step + F.col("_i")).alias("pos"), "x"
    )


def frame_runs(
    signal: DataFrame, keys: list[str], size: int, step: int, pad: bool = True, lengths: DataFrame | None = None,
    stats: dict[str, Column] | None = None, run_samples: int | None = None,
) -> tuple[DataFrame, Callable[[dict], tuple[int, int]]]:
    """Runs of samples that hold whole frames, and a function from a run to its first frame and number of frames.

    Consecutive runs share ``size - step`` samples, a small part of a run.
    """
    span = run_samples or max(FRAME_RUN, 16 * (size - step))
    per_run = max(1, span // step)
    count = f"((_n - _n % {size}) div {step} + 1)" if pad else f"if(_n < {size}, 0, (_n - {size}) div {step} + 1)"
    kept = signal.where(F.col("pos") % step < size) if step > size else signal
    runs = value_runs(
        kept.withColumn("x", F.col("x").cast("double")), keys, per_run * step, after=max(size - step, 0),
        runs=f"({count} + {per_run - 1}) div {per_run}", stats=stats, lengths=signal if lengths is None else lengths,
    )

    def frames_of(row: dict) -> tuple[int, int]:
        n = row["_n"]
        total = (n - n % size) // step + 1 if pad else (n - size) // step + 1
        first = row["_run"] * per_run
        return first, min(per_run, total - first)

    return runs, frames_of


def _cut(signal: DataFrame, keys: list[str], size: int, step: int, pad: bool, lengths: DataFrame | None, run_samples: int | None = None) -> DataFrame:
    runs, frames_of = frame_runs(signal, keys, size, step, pad, lengths, run_samples=run_samples)
    # samples between frames were left out, so frames without an overlap stand side by side
    stride = min(step, size)

    def cut(row: dict) -> tuple:
        first, count = frames_of(row)
        at = (np.arange(count)[:, None] * stride + np.arange(size)[None, :]).reshape(-1)
        x = row["_v"].field("v")
        # places behind the last sample point at one zero; nulls stay nulls
        values = pa.concat_arrays([x, pa.array([0.0])]).take(pa.array(np.minimum(at, len(x))))
        return np.arange(first, first + count), pa.ListArray.from_arrays(pa.array(np.arange(count + 1) * size, pa.int32()), values)

    return map_runs(runs, keys, "frame long, values array<double>", cut)


def frame(
    signal: DataFrame, keys: list[str], size: int, step: int | None = None, pad: bool = True, lengths: DataFrame | None = None
) -> DataFrame:
    """(keys, frame, values): overlapping frames; ``step=None`` is half the size.

    The tail gets ``size - n mod size`` zeros, a whole extra frame of them when the length divides; ``pad=False`` keeps
    only the frames inside the signal. A step beyond the size skips samples. A shuffle group is a run of frames of about
    ``FRAME_RUN`` samples: only the samples that two runs share are copied, and frames are cut behind the shuffle.
    """
    if size % 2:
        raise ValueError("the frame size must be even")
    return _cut(signal, keys, size, step or size // 2, pad, lengths)


def overlap_add(frames: DataFrame, keys: list[str], step: int, value: str = "values", whole: bool = False, block: int = 1 << 14) -> DataFrame:
    """signal(keys, pos, x): the sum of the overlapping frames at each place.

    Consecutive frames of an Arrow batch are summed before the shuffle, so it carries each sample about once, as arrays,
    and the edges that two such stretches share. Nulls add nothing. ``whole`` adds a step of zeros behind an even number
    of frames.
    """
    schema = T.StructType([
        *[frames.schema[k] for k in keys], T.StructField("_blk", T.LongType()), T.StructField("_at", T.LongType()), T.StructField("_x", T.ArrayType(T.DoubleType()))
    ])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.and_(batch.column("frame").is_valid(), batch.column(value).is_valid()))
            if not batch.num_rows:
                continue
            number, values = batch.column("frame").to_numpy(), batch.column(value)
            size = values.value_lengths().to_numpy()
            joint = np.zeros(batch.num_rows, bool)
            joint[1:] = (number[1:] == number[:-1] + 1) & (size[1:] == size[:-1])
            for k in keys:
                joint[1:] &= _equal_neighbours(batch.column(k))
            if (step > size).any():
                joint[:] = False
            flat, ends = floats(pc.fill_null(values.flatten(), 0.0)), np.append(0, np.cumsum(size))
            starts = np.flatnonzero(~joint)
            owner, blocks, places, sums = [], [], [], []
            for a, b in zip(starts, np.append(starts[1:], len(number))):
                x = overlap_sum(flat[ends[a] : ends[b]].reshape(b - a, -1), step)
                if whole and number[b - 1] % 2:
                    x = np.append(x, np.zeros(step))
                at = int(number[a]) * step
                while len(x):
                    room = block - at % block
                    owner.append(a), blocks.append(at // block), places.append(at), sums.append(x[:room])
                    at, x = at + len(x[:room]), x[room:]
            offsets = np.append(0, np.cumsum([len(s) for s in sums]))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(sums) if sums else np.zeros(0)))
            repeated = [batch.column(k).take(pa.array(np.array(owner, np.int64))) for k in keys]
            yield pa.RecordBatch.from_arrays([*repeated, pa.array(blocks, pa.int64()), pa.array(places, pa.int64()), lists], names=schema.fieldNames())

    parts = frames.select(*keys, F.col("frame").cast("long").alias("frame"), F.col(value).cast("array<double>").alias(value)).mapInArrow(partial, schema)
    held = parts.groupBy(*keys, "_blk").agg(F.collect_list("_at").alias("_at"), F.collect_list("_x").alias("_x"))

    def total(row: dict) -> tuple:
        places, lists = row["_at"].to_numpy(), row["_x"]
        low, ends = int(places.min()), places + lists.value_lengths().to_numpy()
        x, held = np.zeros(int(ends.max()) - low), np.zeros(int(ends.max()) - low, bool)
        # pieces come in any order; adding them by place makes the sums the same in every run
        for i in np.lexsort((ends, places)):
            x[places[i] - low : ends[i] - low] += lists[i].values.to_numpy()
            held[places[i] - low : ends[i] - low] = True
        at = np.flatnonzero(held)
        return at + low, x[at]

    return map_runs(held, keys, "pos long, x double", total)


def _equal_neighbours(column: pa.Array) -> np.ndarray:
    """Whether each value but the first is the one before it; two nulls are equal."""
    if pa.types.is_nested(column.type):
        values = column.to_pylist()
        return np.array([a == b for a, b in zip(values[1:], values[:-1])], bool)
    codes = pc.fill_null(column.dictionary_encode(null_encoding="encode").indices, -1).to_numpy()
    return codes[1:] == codes[:-1]


def invert_halfoverlap(frames: DataFrame, keys: list[str], size: int, value: str = "values") -> DataFrame:
    """Overlap-add at half the size; an even number of frames leaves half a frame of zeros at the end."""
    return overlap_add(frames, keys, size // 2, value, whole=True)


def trim_edges(signal: DataFrame, keys: list[str], threshold: int = 2, code: str = "code", block: int = BLOCK) -> DataFrame:
    """Drop leading and trailing codes within ``threshold`` of 127; the last loud sample is exclusive."""
    loud = F.when(F.abs(F.col(code) - 127) > threshold, F.col("pos"))
    x = with_totals(signal, keys, {"_a": F.min(loud), "_b": F.max(loud)}, block=block)
    return x.where("pos >= _a and pos < _b").withColumn("pos", F.col("pos") - F.col("_a")).drop("_a", "_b")


def label_trim(labels: DataFrame, keys: list[str], pauses: tuple = ("pau", "sil", "silB", "silE")) -> DataFrame:
    """start, stop of the speech part: labels(keys, begin, end, label)."""
    spoken = labels.where(~F.col("label").isin(*pauses))
    return spoken.groupBy(*keys).agg(F.min_by("begin", "begin").alias("start"), F.max_by("end", "begin").alias("stop"))


def decaying_max(rows: DataFrame, keys: list[str], alpha: float, value: str = "x", pos: str = "pos", block: int = BLOCK) -> DataFrame:
    """state: max(alpha * state, x) along the sequence, for values of at least 0.

    In logs the recurrence is a running maximum of ``ln x - t ln alpha``; zeros are left out of the maximum.
    """
    log_a = F.log(F.lit(alpha))
    lifted = F.when(F.col(value) > 0, F.log(value) - F.col(pos) * log_a)
    out = running(rows, keys, {"_top": ("max", lifted)}, order=(pos,), block=block)
    return out.withColumn("state", F.coalesce(F.exp(F.col("_top") + F.col(pos) * log_a), F.lit(0.0))).drop("_top")


def fixed_chunks(signal: DataFrame, keys: list[str], n: int, block: int = BLOCK) -> DataFrame:
    """chunk: equal chunks of n rows, the last keeps the remainder; shorter signals yield none."""
    x = with_totals(signal, keys, {"_n": F.count("*")}, block=block)
    last = F.expr(f"_n div {n} - 1")
    return x.withColumn("chunk", F.least(F.expr(f"pos div {n}"), last)).where(last >= 0).drop("_n")


def linear_upsample(signal: DataFrame, keys: list[str], factor: int, block: int = BLOCK) -> DataFrame:
    """Linear interpolation between neighbours: (n - 1) * factor + 1 samples."""
    x = local_window(signal, keys, 0, 1, {"_next": lambda w: F.lead("x").over(w)}, block=block)
    steps = F.when(F.col("_next").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(factor - 1)))
    x = x.select(*keys, "pos", "x", "_next", F.explode(steps).alias("_i"))
    t = F.col("_i") / float(factor)
    return x.select(
        *keys, (F.col("pos") * factor + F.col("_i")).alias("pos"), ((1 - t) * F.col("x") + t * F.coalesce("_next", F.lit(0.0))).alias("x")
    )


def voice_activity(
    spectrum: DataFrame, keys: list[str], size: int, threshold: float = 9.0, order: int = 5, head: int = 39, block: int = 1 << 10
) -> DataFrame:
    """(keys, frame, ratio, voiced) from one-sided magnitudes(keys, frame, mag) of frames of ``size`` samples.

    The noise level of a bin is its mean magnitude over the first ``head`` frames; the envelope is the maximum over
    ``order`` frames on either side; the ratio is in decibels and 0 within ``order`` frames of an edge. Inner bins count
    twice, as they stand for both halves of the full spectrum. Bins without noise are left out; without any the ratio is 0.
    """
    # read for the noise and for the envelope: written once
    spectrum = written(spectrum.select(*keys, "frame", "mag"), "magnitudes")
    runs = value_runs(spectrum, keys, block, order, order, value="mag", pos="frame", stats={"_noise": _head(head)}).withColumn("_noise", _power(F.col("_noise")))

    def ratios(row: dict) -> tuple:
        at, envelope = _envelope(row, order, block)
        noise = np.zeros(envelope.shape[1]) if row["_noise"] is None else floats(row["_noise"])
        twice = np.full(len(noise), 2.0)
        twice[[b for b in (0, size // 2) if b < len(noise)]] = 1.0
        weight = np.divide(twice, noise, out=np.zeros(len(noise)), where=noise > 0)
        with np.errstate(divide="ignore"):
            level = 10.0 * np.log10((envelope**2) @ weight / size)
        inside = (at >= order) & (at + order < row["_n"]) & ~np.isneginf(level)
        ratio = np.where(inside, level, 0.0)
        return at, ratio, ratio >= threshold

    return map_runs(runs, keys, "frame long, ratio double, voiced boolean", ratios)


def _head(head: int) -> Column:
    """The magnitudes of the first frames, at most ``head`` arrays per key."""
    return F.collect_list(F.when(F.col("frame") < head, F.struct("frame", "mag")))


def _power(first: Column) -> Column:
    """Squared mean per bin."""
    rows = F.sort_array(first)["mag"]
    bins = F.sequence(F.lit(0), F.size(F.get(rows, F.lit(0))) - 1)
    mean = lambda r, b: F.aggregate(F.transform(r, lambda v: F.get(v, b)), F.lit(0.0), lambda s, v: s + v) / F.size(r)
    return let(rows, lambda r: F.when(F.size(r) > 0, F.transform(bins, lambda b: let(mean(r, b), lambda m: m * m))))


def _envelope(row: dict, order: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Frames of a run and, per frame, the maxima of the frames around it."""
    at, lists = row["_v"].field("pos").to_numpy(), row["_v"].field("v")
    rows = floats(lists.flatten()).reshape(len(at), -1)
    edge = np.full((order, rows.shape[1]), -np.inf)
    top = sliding_max(np.concatenate([edge, rows, edge]), 2 * order + 1)
    home = at // block == row["_run"]
    return at[home], top[home]


def noise_spectrum(spectrum: DataFrame, keys: list[str], head: int = 39) -> DataFrame:
    """(keys, power): per bin the squared mean magnitude over the first ``head`` frames, as one array per key."""
    first = spectrum.where(F.col("frame") < head).groupBy(*keys).agg(_head(head).alias("_first"))
    return first.select(*keys, _power(F.col("_first")).alias("power"))


def long_term_envelope(spectrum: DataFrame, keys: list[str], order: int = 5, block: int = 1 << 10) -> DataFrame:
    """(keys, frame, envelope): per bin the largest magnitude from ``order`` frames before to ``order`` after, one array per frame."""
    runs = value_runs(spectrum, keys, block, order, order, value="mag", pos="frame")
    return map_runs(runs, keys, "frame long, envelope array<double>", lambda row: _envelope(row, order, block))


def voiced_samples(signal: DataFrame, activity: DataFrame, keys: list[str], size: int, block: int = BLOCK) -> DataFrame:
    """Samples that fall into a voiced frame.

    With L half-overlapped frames, frame k + 1 decides the k-th of L - 1 equal parts of ``(L + 1) * size / 2`` samples,
    moved one frame to the front. The part of a sample is arithmetic, so the join is equal on (keys, frame).
    """
    x = with_totals(signal, keys, {"_n": F.count("*")}, block=block)
    x = x.withColumn("_l", F.expr(f"_n div {size // 2} - 1")).where("_l > 1")
    x = x.withColumn("_s", F.expr(f"(_l + 1) * {size} div 2")).where(f"pos + {size} < _s")
    x = x.withColumn("frame", F.expr(f"((pos + {size} + 1) * (_l - 1) + _s - 1) div _s"))
    voiced = activity.where("voiced").select(*keys, "frame")
    return x.join(voiced, [*keys, "frame"], "left_semi").drop("frame", "_n", "_l", "_s")


def best_lag(a: DataFrame, b: DataFrame, keys: list[str], largest: int, block: int = 1 << 15) -> DataFrame:
    """(keys, lag, score): the lag of b against a within ±largest with the largest sum of products.

    Both sides are mean-centered; nulls count as the mean. Blocks of a meet the part of b that the lags reach, and a
    block's scores are one product of transforms (overlap-save), added up per lag. Scores that differ by less than
    rounding (1e-12 of the signals' energy) tie; the first lag wins.
    """
    span = max(block, 2 * largest)
    side = lambda df: df.select(*keys, "pos", F.col("x").cast("double").alias("x"))
    stats = {"_mean": F.avg("x"), "_square": F.sum(F.col("x") * F.col("x"))}
    left = value_runs(side(a), keys, span, stats=stats)
    # the lags carry b into runs behind its own end
    right = value_runs(side(b), keys, span, largest, largest, runs=f"(_n + {largest + span - 1}) div {span}", stats=stats)
    left, right = (x.select(*keys, "_run", *[F.col(c).alias(c + tag) for c in ("_n", "_mean", "_square", "_v")]) for x, tag in ((left, "a"), (right, "b")))
    met = left.join(right, [*keys, "_run"])

    def scores(row: dict) -> tuple:
        if not len(row["_va"]) or not len(row["_vb"]):
            return None
        x, y = (np.nan_to_num(floats(row[v].field("v")) - (row[m] or 0.0)) for v, m in (("_va", "_meana"), ("_vb", "_meanb")))
        start, first = (row[v].field("pos")[0].as_py() for v in ("_va", "_vb"))
        # y on the places start - largest … start + len(x) + largest
        wide = np.zeros(len(x) + 2 * largest)
        low = first - (start - largest)
        y = y[max(-low, 0) :]
        low = max(low, 0)
        y = y[: len(wide) - low]
        wide[low : low + len(y)] = y
        if len(x) * (2 * largest + 1) <= 1 << 14:
            score = np.correlate(wide, x, "valid")
        else:
            size = 1 << (len(wide) - 1).bit_length()
            score = np.fft.irfft(np.fft.rfft(wide, size) * np.conj(np.fft.rfft(x, size)), size)[: 2 * largest + 1]
        # place i of the scores is lag largest - i
        lag = largest - np.arange(2 * largest + 1)
        met = (lag < row["_na"]) & (lag > -row["_nb"])
        energy = np.sqrt(max(row["_squarea"] or 0.0, 0.0) * max(row["_squareb"] or 0.0, 0.0))
        return lag[met], score[met], np.full(int(met.sum()), energy)

    per_lag = map_runs(met, keys, "lag long, score double, energy double", scores).groupBy(*keys, "lag").agg(F.sum("score").alias("score"), F.max("energy").alias("energy"))
    top = per_lag.groupBy(*keys).agg(F.max("score").alias("_top"), F.sort_array(F.collect_list(F.struct("lag", "score"))).alias("_s"), F.max("energy").alias("_e"))
    best = F.get(F.filter("_s", lambda s: s["score"] >= F.col("_top") - 1e-12 * F.col("_e")), F.lit(0))
    return top.select(*keys, best.alias("s")).select(*keys, "s.lag", "s.score")


def downsample(signal: DataFrame, keys: list[str], m: int, taps: list[float], block: int = 1 << 14) -> DataFrame:
    """Filter with a fixed list of taps and keep every m-th value of the whole convolution, tail included; nulls count as 0.

    A polyphase bank: samples in rows of m meet the taps in rows of m, so an output sums a few products of rows. Runs
    share as many samples as there are taps.
    """
    rows = -(-len(taps) // m)
    bank = np.zeros((rows, m))
    # output k takes taps j * m + i from sample (k - j) * m - i: the row of samples that ends at (k - j) * m
    bank.reshape(-1)[: len(taps)] = taps
    span = max(block // m, rows, 1) * m
    outputs = f"((_n + {m - 1}) div {m} + {rows})"
    runs = value_runs(signal.withColumn("x", F.col("x").cast("double")), keys, span, before=rows * m, runs=f"({outputs} + {span // m - 1}) div {span // m}")

    def filtered(row: dict) -> tuple:
        first, start = row["_run"] * (span // m), row["_run"] * span
        count = min(span // m, (row["_n"] + m - 1) // m + rows - first)
        low = start - rows * m + 1
        x = np.zeros((count + rows - 1) * m)
        values = row["_v"]
        if len(values):
            at = values.field("pos")[0].as_py() - low
            v = np.nan_to_num(floats(values.field("v")))[max(-at, 0) :]
            v = v[: max(len(x) - max(at, 0), 0)]
            x[max(at, 0) : max(at, 0) + len(v)] = v
        # row r of x ends at sample start + (r + 1 - rows) * m; reversed, its first value is that sample
        phases = x.reshape(-1, m)[:, ::-1] @ bank.T
        y = sum(phases[rows - 1 - j : rows - 1 - j + count, j] for j in range(rows))
        return np.arange(first, first + count), y

    return map_runs(runs, keys, "pos long, x double", filtered)
