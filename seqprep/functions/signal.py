"""Scalar and frame functions on signals as column expressions, with NumPy kernels for whole-frame transforms."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


# -- mel scales -------------------------------------------------------------------------------------------------------
# Constants of the two mel scales.
MEL_BREAK, MEL_Q = 700.0, 1127.0
LINEAR_STEP, LINEAR_TOP = 200.0 / 3.0, 1000.0
LOG_STEP = math.log(6.4) / 27.0


def hertz_to_mel(hz: Column) -> Column:
    return MEL_Q * F.log(1.0 + hz / MEL_BREAK)


def herz_to_mel(hz: Column) -> Column:
    """Linear below 1000 Hz, logarithmic above."""
    return F.when(hz < LINEAR_TOP, hz / LINEAR_STEP).otherwise(LINEAR_TOP / LINEAR_STEP + F.log(hz / LINEAR_TOP) / LOG_STEP)


def mel_to_herz(mel: Column) -> Column:
    knee = LINEAR_TOP / LINEAR_STEP
    return F.when(mel < knee, mel * LINEAR_STEP).otherwise(LINEAR_TOP * F.exp(LOG_STEP * (mel - knee)))


def _mel(hz):
    return MEL_Q * np.log(1.0 + np.asarray(hz, dtype=float) / MEL_BREAK)


def mel_weights(n_bins: int, rate: float, low: float = 125.0, high: float = 3800.0, n_filters: int = 20) -> np.ndarray:
    """(n_bins, n_filters) triangular filters on the log mel scale; the lowest bin has no weight."""
    bins = _mel(np.linspace(0.0, rate / 2.0, n_bins))[:, None]
    edges = np.linspace(_mel(low), _mel(high), n_filters + 2)
    rise = (bins - edges[:-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[2:] - bins) / (edges[2:] - edges[1:-1])
    weights = np.maximum(0.0, np.minimum(rise, fall))
    weights[0] = 0.0
    return weights


def mel_weights_wide(n_fft: int, rate: int, n_filters: int, width: float = 1.0) -> np.ndarray:
    """(n_filters, n_fft) filters on the linear-then-log scale with width and area scaling; upper half is zero."""
    knee = LINEAR_TOP / LINEAR_STEP
    top = rate // 2
    top_mel = top / LINEAR_STEP if top < LINEAR_TOP else knee + math.log(top / LINEAR_TOP) / LOG_STEP
    mels = np.arange(n_filters + 2) / (n_filters + 1.0) * top_mel
    edges = np.where(mels < knee, mels * LINEAR_STEP, LINEAR_TOP * np.exp(LOG_STEP * (mels - knee)))
    bins = np.arange(n_fft // 2) / n_fft * rate
    mid = edges[1:-1, None]
    low, high = mid + width * (edges[:-2, None] - mid), mid + width * (edges[2:, None] - mid)
    shape = np.maximum(0.0, np.minimum((bins - low) / (mid - low), (high - bins) / (high - mid)))
    out = np.zeros((n_filters, n_fft))
    out[:, : n_fft // 2] = shape * (2.0 / (edges[2:] - edges[:-2]))[:, None]
    return out


def mel_bank(n_bins: int, rate: float, low: float, high: float, n_filters: int) -> np.ndarray:
    """(n_bins, n_filters) triangles of area one between frequencies evenly spaced on the linear-then-log scale."""
    knee = LINEAR_TOP / LINEAR_STEP
    ends = [hz / LINEAR_STEP if hz < LINEAR_TOP else knee + math.log(hz / LINEAR_TOP) / LOG_STEP for hz in (low, high)]
    corners = [m * LINEAR_STEP if m < knee else LINEAR_TOP * math.exp(LOG_STEP * (m - knee)) for m in np.linspace(*ends, n_filters + 2)]
    grid = np.linspace(0.0, rate / 2.0, n_bins)
    triangles = zip(corners, corners[1:], corners[2:])
    return np.stack([np.interp(grid, abc, [0.0, 2.0 / (abc[2] - abc[0]), 0.0], 0.0, 0.0) for abc in triangles], axis=1)


def mel_weight_table(spark, weights: np.ndarray):
    """weight(bin, filter, w): the non-zero weights; its size depends on parameters only."""
    at = np.argwhere(weights > 0)
    rows = [(int(b), int(f), float(weights[b, f])) for b, f in at]
    return spark.createDataFrame(rows, "bin int, filter int, w double")


# -- companding and levels --------------------------------------------------------------------------------------------
def mulaw(x: Column, channels: int = 256) -> Column:
    mu = float(channels - 1)
    return F.signum(x) * F.log1p(mu * F.abs(x)) / math.log1p(mu)


def inv_mulaw(y: Column, channels: int = 256) -> Column:
    mu = float(channels - 1)
    return F.signum(y) * (1.0 / mu) * (F.pow(F.lit(1.0 + mu), F.abs(y)) - 1.0)


def mulaw_quantize(x: Column, channels: int = 256) -> Column:
    """Codes 0 … channels-1."""
    return ((mulaw(x, channels) + 1.0) / 2.0 * float(channels - 1) + 0.5).cast("int")


def inv_mulaw_quantize(code: Column, channels: int = 256) -> Column:
    return inv_mulaw(2.0 * (code / float(channels - 1)) - 1.0, channels)


def amp_to_db(x: Column, floor_db: float = -100.0) -> Column:
    return 20.0 * F.log10(F.greatest(F.lit(10.0 ** (floor_db / 20.0)), x))


def db_to_amp(x: Column) -> Column:
    return F.pow(F.lit(10.0), x * 0.05)


def level_normalize(db: Column, floor_db: float = -100.0) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (db - floor_db) / -floor_db))


def level_denormalize(level: Column, floor_db: float = -100.0) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), level)) * -floor_db + floor_db


# -- complex forms ----------------------------------------------------------------------------------------------------
def complex_to_abs(c: Column) -> Column:
    return F.hypot(c["re"], c["im"])


def complex_to_angle(c: Column) -> Column:
    return F.atan2(c["im"], c["re"])


def abs_and_angle_to_complex(size: Column, angle: Column) -> Column:
    return F.struct((size * F.cos(angle)).alias("re"), (size * F.sin(angle)).alias("im"))


def angle_to_sin_cos(angle: Column) -> Column:
    return F.struct(F.sin(angle).alias("sin"), F.cos(angle).alias("cos"))


def sin_cos_to_angle(sin: Column, cos: Column) -> Column:
    return F.atan2(sin, cos)


def complex_to_real_view(values: Column) -> Column:
    """[struct(re, im), …] to [re, im, re, im, …]."""
    return F.flatten(F.transform(values, lambda c: F.array(c["re"], c["im"])))


def real_to_complex_view(values: Column) -> Column:
    return F.transform(
        F.sequence(F.lit(0), (F.size(values) / 2).cast("int") - 1),
        lambda i: F.struct(F.get(values, i * 2).alias("re"), F.get(values, i * 2 + 1).alias("im")),
    )


# -- windows ----------------------------------------------------------------------------------------------------------
def hann(size: int) -> np.ndarray:
    """Periodic for even sizes."""
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / (size if size % 2 == 0 else size - 1))


def sine(size: int) -> np.ndarray:
    return np.sin(np.pi * (np.arange(size) + 0.5) / size)


def kaiserbessel(size: int, alpha: float = 6.5) -> np.ndarray:
    return np.kaiser(size, np.pi * alpha)


def windowed(frame: Column, window: np.ndarray) -> Column:
    return F.zip_with(frame, F.array(*[F.lit(float(v)) for v in window]), lambda x, w: x * w)


# -- whole-frame kernels (Arrow batches) ------------------------------------------------------------------------------
def _frames(values: pd.Series) -> np.ndarray:
    return np.stack(values.to_numpy()).astype(float) if len(values) else np.zeros((0, 1))


def fourier(frame: Column, window: np.ndarray | None = None) -> Column:
    """One-sided transform of each frame: struct(re array, im array)."""

    @F.pandas_udf("re array<double>, im array<double>")
    def kernel(values: pd.Series) -> pd.DataFrame:
        x = _frames(values)
        f = np.fft.rfft(x if window is None else x * window)
        return pd.DataFrame({"re": list(f.real), "im": list(f.imag)})

    return kernel(frame)


def inverse_fourier(re: Column, im: Column, size: int, whole: bool = False) -> Column:
    """Real part of the inverse of a one-sided spectrum; the upper half is zero, or by symmetry with ``whole``."""

    @F.pandas_udf("array<double>")
    def kernel(a: pd.Series, b: pd.Series) -> pd.Series:
        half = _frames(a) + 1j * _frames(b)
        if whole:
            return pd.Series(list(np.fft.irfft(half, size)))
        full = np.zeros((len(half), size), dtype=complex)
        full[:, : half.shape[1]] = half
        return pd.Series(list(np.fft.ifft(full).real))

    return kernel(re, im)


def project(values: Column, matrix: np.ndarray) -> Column:
    """Each array times a (size, outputs) matrix."""

    @F.pandas_udf("array<double>")
    def kernel(v: pd.Series) -> pd.Series:
        return pd.Series(list(_frames(v) @ matrix))

    return kernel(values)


def cosine_basis(size: int) -> np.ndarray:
    """Orthonormal cosine transform as a (size, size) matrix; its transpose is the inverse."""
    n, k = np.arange(size)[:, None], np.arange(size)[None, :]
    scale = np.where(k == 0, math.sqrt(1.0 / size), math.sqrt(2.0 / size))
    return scale * np.cos(np.pi * (2 * n + 1) * k / (2 * size))


def lapped_basis(half: int) -> np.ndarray:
    """(2*half, half) lapped cosine transform."""
    n, k = np.arange(2 * half)[:, None], np.arange(half)[None, :]
    return np.cos(np.pi * (n + (half + 1) / 2) * (k + 0.5) / half)


def lowpass_taps(n_taps: int, cutoff: float) -> np.ndarray:
    """Hamming-windowed low-pass filter with unit gain at zero; ``cutoff`` is a fraction of half the rate."""
    t = np.arange(n_taps) - (n_taps - 1) / 2.0
    taps = cutoff * np.sinc(cutoff * t) * np.hamming(n_taps)
    return taps / taps.sum()


# -- frame arithmetic -------------------------------------------------------------------------------------------------
def lws_num_frames(length: Column, size: int, step: int) -> Column:
    room = F.floor((length + 2 * (size - step) - size) / step).cast("long")
    return F.when(length % step == 0, room + 1).otherwise(room + 2)


def lws_pad(length: Column, size: int, step: int) -> Column:
    """struct(left, right) padding."""
    pad = size - step
    rest = (lws_num_frames(length, size, step) - 1) * step + size - (length + 2 * pad)
    return F.struct(F.lit(pad).cast("long").alias("left"), (rest + pad).alias("right"))
