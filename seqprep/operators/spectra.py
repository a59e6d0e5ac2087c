"""Frame transforms: spectra, mel features, cosine and lapped transforms, and the features of an utterance.

Spark deals the signal out in runs (one shuffle); the frames of a run are views of it and one NumPy call transforms them;
overlapping frames are summed before their shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqprep.functions import signal as S
from seqprep.operators import aggregates as A
from seqprep.operators import frames as W
from seqprep.operators.blocks import BLOCK, spread, with_totals
from seqprep.operators.runs import floats, map_runs, window_rows
from seqprep.scratch import written


def spectrum(signal: DataFrame, keys: list[str], size: int, step: int | None = None, center: bool = True, pad: bool = True) -> DataFrame:
    """(keys, frame, re, im): mean-centered, framed, Hann-windowed one-sided transform, straight from runs of samples."""
    def transform(row: dict, frames: np.ndarray) -> tuple:
        f = np.fft.rfft(frames * window)
        return f.real, f.imag

    window = S.hann(size)
    stats, change = ({"_mean": F.avg("x")}, lambda x, row: x - row["_mean"]) if center else (None, None)
    return framed(signal, keys, size, step or size // 2, pad, "re array<double>, im array<double>", transform, stats, change)


def framed(
    signal: DataFrame, keys: list[str], size: int, step: int, pad: bool, columns: str, transform: Callable[[dict, np.ndarray], tuple],
    stats: dict[str, Column] | None = None, change: Callable[[np.ndarray, dict], np.ndarray] | None = None,
) -> DataFrame:
    """(keys, frame, columns): ``transform`` of the frames of a run as one matrix, whose rows are views of the run.

    ``change`` is applied to the samples first, with the ``stats`` of their key; padding stays zero. A null sample makes
    its frames nan.
    """
    if size % 2:
        raise ValueError("the frame size must be even")
    runs, frames_of = W.frame_runs(signal, keys, size, step, pad, stats=stats)

    def cut(row: dict) -> tuple:
        first, count = frames_of(row)
        x = floats(row["_v"].field("v"))
        x = change(x, row) if change and len(x) else x
        return np.arange(first, first + count), *transform(row, window_rows(x, size, min(step, size), count))

    return map_runs(runs, keys, f"frame long, {columns}", cut)


def activity_magnitudes(signal: DataFrame, keys: list[str], size: int) -> DataFrame:
    """(keys, frame, mag) for voice activity: values scaled to 0 … 2^15 (a constant signal: 0) and cut to integers, frames inside the signal."""
    def scaled(x: np.ndarray, row: dict) -> np.ndarray:
        low, high = row["_lo"], row["_hi"]
        return np.trunc((x - low) / (1.0 if high == low else high - low) * 32768.0)

    window = np.hanning(size)
    stats = {"_lo": F.min(F.col("x").cast("double")), "_hi": F.max(F.col("x").cast("double"))}
    return framed(signal, keys, size, size // 2, False, "mag array<double>", lambda row, frames: (np.abs(np.fft.rfft(frames * window)),), stats, scaled)


def magnitudes(spec: DataFrame) -> Column:
    return F.zip_with("re", "im", lambda a, b: F.hypot(a, b))


def with_magnitudes(spec: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, frame, mag): one array of magnitudes per frame."""
    return spec.select(*keys, "frame", magnitudes(spec).alias("mag"))


def inverse_spectrum(
    spec: DataFrame, keys: list[str], size: int, step: int | None = None, center: bool = True, whole: bool = False
) -> DataFrame:
    """signal(keys, pos, x) by inverse transform and overlap-add.

    By default the missing half of the spectrum counts as zeros, on ``size + 2`` places; ``whole`` restores it by
    symmetry, which inverts ``spectrum`` exactly up to the window.
    """
    width = size if whole else size + 2
    f = spec.withColumn("values", S.inverse_fourier(F.col("re"), F.col("im"), width, whole))
    out = W.invert_halfoverlap(f, keys, width) if step is None else W.overlap_add(f, keys, step)
    return A.mean_center(out, keys) if center else out


def log_mel(
    signal: DataFrame, keys: list[str], size: int, step: int, rate: float, low: float = 125.0, high: float = 7800.0, n_filters: int = 80
) -> DataFrame:
    """(keys, frame, feat): log1p of the mel-weighted magnitudes; the upper edge is at most half the rate."""
    spec = spectrum(signal, keys, size, step)
    weights = S.mel_weights(size // 2 + 1, rate, low, min(rate // 2, high), n_filters)
    mel = S.project(magnitudes(spec), weights)
    return spec.select(*keys, "frame", mel.alias("_m")).select(*keys, "frame", F.transform("_m", lambda v: F.log1p(v)).alias("feat"))


def mel_spectrogram(
    signal: DataFrame, keys: list[str], size: int, step: int, rate: float, low: float = 125.0, high: float = 7600.0,
    n_filters: int = 80, ref_db: float = 20.0, floor_db: float = -100.0,
) -> DataFrame:
    """(keys, frame, feat): mel magnitudes in decibels below the reference level, normalized to [0, 1].

    The signal is padded by ``size - step`` zeros before it and to whole frames after it.
    """
    padded, _ = pad_for_frames(signal.withColumn("x", F.col("x").cast("double")), keys, size, step, x=F.lit(0.0))
    return mel_levels(spectrum(padded, keys, size, step, center=False, pad=False), keys, size, rate, low, high, n_filters, ref_db, floor_db)


def pad_for_frames(signal: DataFrame, keys: list[str], size: int, hop: int, **fill: Column) -> tuple[DataFrame, DataFrame]:
    """The columns of ``fill`` after ``size - hop`` filled places, filled up at the end to whole frames; and (keys, _n, n_frames)."""
    left = size - hop
    n = F.col("_n")
    pad = signal.groupBy(*keys).agg((F.max("pos") + 1).alias("_n")).select(
        *keys, "_n", S.lws_num_frames(n, size, hop).alias("n_frames"), S.lws_pad(n, size, hop)["right"].alias("_right")
    )
    none = "cast(array() as array<bigint>)"
    before = f"sequence(0L, {left - 1}L)" if left else none
    after = f"if(_right > 0, sequence(_n + {left}, _n + {left - 1} + _right), {none})"
    places = pad.select(*keys, F.explode(F.expr(f"concat({before}, {after})")).alias("pos"), *[v.alias(c) for c, v in fill.items()])
    moved = signal.select(*keys, (F.col("pos") + left).alias("pos"), *fill)
    return moved.unionByName(places), pad.drop("_right")


def mel_levels(
    spec: DataFrame, keys: list[str], size: int, rate: float, low: float, high: float, n_filters: int, ref_db: float = 20.0, floor_db: float = -100.0
) -> DataFrame:
    mel = spec.select(*keys, "frame", S.project(magnitudes(spec), S.mel_bank(size // 2 + 1, rate, low, high, n_filters)).alias("_m"))
    level = F.transform("_m", lambda v: S.level_normalize(S.amp_to_db(v, floor_db) - ref_db, floor_db))
    return mel.select(*keys, "frame", level.alias("feat"))


def log_power_spectrogram(signal: DataFrame, keys: list[str], size: int, step: int, path: Column | None = None, floor_db: float = -100.0) -> DataFrame:
    """(keys, frame, feat): 20 log10 of the magnitudes, at least the floor; ``label`` is the first part of the file name if a path is given."""
    from seqprep.functions.arrays import speaker_from_name

    spec = spectrum(signal, keys, size, step)
    out = spec.select(*keys, "frame", F.transform(magnitudes(spec), lambda v: S.amp_to_db(v, floor_db)).alias("feat"))
    return out.withColumn("label", speaker_from_name(path)) if path is not None else out


def blocks_of(signal: DataFrame, keys: list[str], size: int) -> DataFrame:
    """(keys, frame, values): blocks without overlap, the last one padded with zeros."""
    place = F.struct((F.col("pos") % size).cast("int").alias("i"), "x")
    x = signal.groupBy(*keys, F.expr(f"pos div {size}").alias("frame")).agg(F.sort_array(F.collect_list(place)).alias("_v"))
    return x.select(*keys, "frame", F.concat("_v.x", F.array_repeat(F.lit(0.0), F.lit(size) - F.size("_v"))).alias("values"))


def dct_compress(signal: DataFrame, keys: list[str], n: int, size: int = 128, overlapped: bool = False) -> DataFrame:
    """(keys, frame, coef): the first n orthonormal cosine coefficients of each block (or half-overlapped frame)."""
    f = W.frame(signal, keys, size) if overlapped else blocks_of(signal, keys, size)
    return f.select(*keys, "frame", S.project(F.col("values"), S.cosine_basis(size)[:, :n]).alias("coef"))


def dct_uncompress(coefs: DataFrame, keys: list[str], n: int, size: int = 128, overlapped: bool = False) -> DataFrame:
    f = coefs.withColumn("values", S.project(F.col("coef"), S.cosine_basis(size)[:, :n].T))
    return W.invert_halfoverlap(f, keys, size) if overlapped else W.overlap_add(f, keys, size)


def mdct(signal: DataFrame, keys: list[str], half: int = 128) -> DataFrame:
    """(keys, frame, coef): sine-windowed half-overlap lapped transform."""
    basis = S.sine(2 * half)[:, None] * S.lapped_basis(half)
    return W.frame(signal, keys, 2 * half).select(*keys, "frame", S.project(F.col("values"), basis).alias("coef"))


def imdct(coefs: DataFrame, keys: list[str], half: int = 128) -> DataFrame:
    basis = (S.sine(2 * half)[:, None] * S.lapped_basis(half)).T / (half / 2)
    f = coefs.withColumn("values", S.project(F.col("coef"), basis))
    return W.invert_halfoverlap(f, keys, 2 * half)


def gain_control(signal: DataFrame, keys: list[str], rate: int, size: int, n_bands: int = 20, t_scale: float = 0.5, width: float = 2.0) -> DataFrame:
    """signal(keys, pos, x): each spectrum divided by its decaying band energies and inverted.

    A zero energy takes the smallest positive one of its utterance.
    """
    cut = size // 2 + 1
    weights = S.mel_weights_wide(size, rate, n_bands, width)[:, :cut]
    alpha = float(np.exp(-(1.0 / (rate / (size // 2))) / t_scale))
    spec = written(spectrum(signal, keys, size, center=False), "spectrum")
    bands = spec.select(*keys, "frame", S.project(magnitudes(spec), weights.T).alias("_b"))
    rows = bands.select(*keys, "frame", F.posexplode("_b").alias("band", "x"))
    state = W.decaying_max(rows, [*keys, "band"], alpha, pos="frame")
    held = state.groupBy(*keys, "frame").agg(F.sort_array(F.collect_list(F.struct("band", "state"))).alias("_s"))
    total = weights.sum(axis=0)
    spread = weights / (total + (total == 0))
    energy = held.select(*keys, "frame", S.project(F.col("_s.state"), spread).alias("_e"))
    least = F.min(F.array_min(F.filter("_e", lambda v: v > 0)))
    energy = with_totals(written(energy, "energy"), keys, {"_least": least}, "frame")
    x = spec.join(energy, [*keys, "frame"])
    safe = F.transform("_e", lambda v: F.when(v > 0, v).otherwise(F.col("_least")))
    x = x.withColumn("_g", safe).select(
        *keys, "frame", F.zip_with("re", "_g", lambda a, g: a / g).alias("re"), F.zip_with("im", "_g", lambda a, g: a / g).alias("im")
    )
    return inverse_spectrum(x, keys, size, center=False)


def utterance_features(
    signal: DataFrame, keys: list[str], size: int, hop: int, rate: float, n_filters: int, channels: int = 256, threshold: int = 2,
    low: float = 125.0, high: float = 7600.0,
) -> dict[str, DataFrame]:
    """Rescale, compand, trim, mel, pad and cut to a multiple of the hop.

    Returns ``codes(keys, pos, code)``, ``mel(keys, frame, feat)`` and ``manifest(keys, timesteps, n_frames)``. The
    padded frames of the mel part start ``size - hop`` zeros before the signal, so frame f is aligned with code f*hop.
    """
    x = A.peak_rescale(signal, keys).withColumn("code", S.mulaw_quantize(F.col("x"), channels))
    x = written(W.trim_edges(x, keys, threshold).select(*keys, "pos", "x", "code"), "trimmed")
    silent = int((0 + 1.0) / 2.0 * (channels - 1) + 0.5)
    padded, pad = pad_for_frames(x, keys, size, hop, x=F.lit(0.0), code=F.lit(silent))
    mel = mel_levels(spectrum(padded, keys, size, hop, center=False, pad=False), keys, size, rate, low, high, n_filters)
    manifest = pad.select(*keys, (F.col("n_frames") * hop).alias("timesteps"), "n_frames")
    limit = spread(manifest.withColumn("_top", F.expr(f"(n_frames * {hop} - 1) div {BLOCK}")), "_top").select(*keys, "_blk", "timesteps")
    codes = padded.withColumn("_blk", F.expr(f"pos div {BLOCK}")).join(limit, [*keys, "_blk"]).where("pos < timesteps")
    return {"codes": codes.select(*keys, "pos", "code"), "mel": mel, "manifest": manifest}
