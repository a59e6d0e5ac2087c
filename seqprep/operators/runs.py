"""Sequences as runs: one row per (key, run) that holds its values as an array, and Arrow kernels over such rows.

A run is a bounded stretch of positions with the few values that its kernel needs from before and behind it, so a long
key is many rows and a value crosses the shuffle about once, whatever the size of a window or the number of taps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqprep.operators.blocks import spread

# a worker holds several times this much: the parts, the joined columns and their places
BATCH_BYTES = 1 << 20


def value_runs(
    seq: DataFrame, keys: list[str], span: int, before: int = 0, after: int = 0, runs: str | None = None,
    stats: dict[str, Column] | None = None, value: str = "x", pos: str = "pos", lengths: DataFrame | None = None,
) -> DataFrame:
    """(keys, _run, _n, stats, _v): run r holds the positions r * span … (r + 1) * span - 1, ``before`` more ahead of it and ``after`` behind.

    ``_v`` has (pos, value) in order, ``_n`` is the length of the key and ``stats`` are aggregates of it; ``lengths`` may
    be a cheaper table with the same positions. ``runs`` is the number of runs as SQL over ``_n`` (default: as many as
    have values); a run without values has an empty array. One shuffle: the lengths travel as rows among the values.
    """
    stats = stats or {}
    totals = (seq if lengths is None else lengths).groupBy(*keys).agg((F.max(pos) + 1).alias("_n"), *[a.alias(n) for n, a in stats.items()])
    last = F.expr(f"({runs or f'(_n + {span - 1}) div {span}'}) - 1").cast("long")
    heads = spread(totals.withColumn("_last", last).where("_last >= 0"), "_last", "_run").drop("_last")
    first, final = F.expr(f"greatest(({pos} - {after}) div {span}, 0L)"), F.expr(f"({pos} + {before}) div {span}")
    home = F.when(first == final, F.array(first)).otherwise(F.sequence(first, final))
    rows = seq.select(*keys, F.explode(home).alias("_run"), F.struct(F.col(pos).alias("pos"), F.col(value).alias("v")).alias("_s"))
    parts = rows.unionByName(heads, allowMissingColumns=True)
    # one row of a run has the numbers of its key
    held = parts.groupBy(*keys, "_run").agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in ("_n", *stats)], F.sort_array(F.collect_list("_s")).alias("_v")
    )
    return held.where("_n is not null").select(*keys, "_run", "_n", *stats, "_v")


def floats(values: pa.Array) -> np.ndarray:
    """Doubles with nan for null."""
    return values.cast(pa.float64()).to_numpy(zero_copy_only=False)


def _lists(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(len(rows) + 1) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(rows.reshape(-1)))


def _joined(parts: list) -> pa.Array:
    """One Arrow column from arrays of numbers, matrices (a list per row) or Arrow arrays."""
    arrays = [p if isinstance(p, pa.Array) else _lists(p) if p.ndim == 2 else pa.array(p) for p in parts]
    return arrays[0] if len(arrays) == 1 else pa.concat_arrays(arrays)


def _size(part) -> int:
    return part.nbytes if isinstance(part, (np.ndarray, pa.Array)) else 0


def map_runs(rows: DataFrame, keys: list[str], columns: str, kernel: Callable[[dict], tuple | None]) -> DataFrame:
    """(keys, columns): ``kernel`` turns a row into equally long columns, or nothing; the row's keys are repeated beside them.

    It gets a dictionary of the row's other columns: numbers as they are, arrays as Arrow arrays.
    """
    out = T.StructType([*[rows.schema[k] for k in keys], *T.StructType.fromDDL(columns).fields])
    names = out.fieldNames()
    others = [c for c in rows.columns if c not in keys]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            taken, parts, size = [], [], 0

            def flush() -> pa.RecordBatch:
                at = np.repeat([t[0] for t in taken], [t[1] for t in taken])
                cols = [batch.column(batch.schema.get_field_index(k)).take(pa.array(at)) for k in keys]
                return pa.RecordBatch.from_arrays([*cols, *[_joined([p[i] for p in parts]) for i in range(len(parts[0]))]], names=names)

            plain = {c: batch.column(batch.schema.get_field_index(c)) for c in others}
            numbers = {c: v.to_pylist() for c, v in plain.items() if not pa.types.is_nested(v.type)}
            for i in range(batch.num_rows):
                row = {c: numbers[c][i] if c in numbers else v[i].values for c, v in plain.items()}
                got = kernel(row)
                if got is None or not len(got[0]):
                    continue
                taken.append((i, len(got[0])))
                parts.append(got)
                size += sum(_size(p) for p in got)
                if size > BATCH_BYTES:
                    yield flush()
                    taken, parts, size = [], [], 0
            if parts:
                yield flush()
            # nothing of this batch is kept while the next one is read
            batch = plain = numbers = row = got = taken = parts = None

    return rows.mapInArrow(work, out)


def window_rows(values: np.ndarray, size: int, step: int, count: int) -> np.ndarray:
    """``count`` windows of ``size`` values, ``step`` apart, as a view; zeros stand behind the last value."""
    short = (count - 1) * step + size - len(values)
    if short > 0:
        values = np.concatenate([values, np.zeros(short)])
    return np.lib.stride_tricks.sliding_window_view(values, size)[::step][:count]


def sliding_max(rows: np.ndarray, size: int) -> np.ndarray:
    """Maximum of every ``size`` rows in a row, in two passes whatever the size: prefix and suffix maxima of blocks of ``size``."""
    n = len(rows) - size + 1
    if size == 1 or n < 1:
        return rows[: max(n, 0)]
    pad = -len(rows) % size
    blocks = np.concatenate([rows, np.full((pad, *rows.shape[1:]), -np.inf)]).reshape(-1, size, *rows.shape[1:])
    ahead = np.maximum.accumulate(blocks, axis=1).reshape(-1, *rows.shape[1:])
    behind = np.maximum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1, *rows.shape[1:])
    return np.maximum(behind[:n], ahead[size - 1 : size - 1 + n])


def moving_sum(values: np.ndarray, size: int) -> np.ndarray:
    """Sum of every ``size`` values as a difference of prefix sums."""
    sums = np.zeros(len(values) + 1, np.int64 if values.dtype == bool else values.dtype)
    np.cumsum(values, out=sums[1:])
    return sums[size:] - sums[:-size]


def sliding_mean(values: np.ndarray, have: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean of every ``size`` values over those at hand, and whether there is any.

    The sums run over values less their common mean, in extended precision, so that differences of them lose nothing.
    """
    finite = have & np.isfinite(values)
    shift = values[finite].mean() if finite.any() else 0.0
    n = moving_sum(have, size)
    sums = moving_sum(np.where(finite, values - shift, 0.0).astype(np.longdouble), size)
    mean = (sums / np.maximum(n, 1)).astype(float) + shift
    if not finite[have].all():
        up, down, nan = (moving_sum(have & f, size) > 0 for f in (values == np.inf, values == -np.inf, np.isnan(values)))
        mean = np.where(up, np.inf, np.where(down, -np.inf, mean))
        mean = np.where(nan | (up & down), np.nan, mean)
    return mean, n > 0


def overlap_sum(frames: np.ndarray, step: int) -> np.ndarray:
    """Consecutive frames added at their places: one addition per part of ``step`` values."""
    count, size = frames.shape
    parts = -(-size // step)
    out = np.zeros((count + parts - 1, step))
    for j in range(parts):
        piece = frames[:, j * step : (j + 1) * step]
        out[j : j + count, : piece.shape[1]] += piece
    return out.reshape(-1)[: (count - 1) * step + size]
