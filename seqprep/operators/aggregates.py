"""Corpus statistics and normalization."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqprep.functions import symbols as S
from seqprep.operators.blocks import BLOCK, position, with_row, with_totals


def moments(frames: DataFrame, feat: str = "feat", by: list[str] | None = None) -> DataFrame:
    """(by, dim, n, c, mean, m2) per dimension: frames, values without nulls, their mean and sum of squared deviations.

    A task folds its frames into arrays, one state per group, with one NumPy pass over each batch; states of the tasks
    merge per dimension. Frames may differ in size.
    """
    by = by or []
    schema = T.StructType([*[frames.schema[k] for k in by], *[T.StructField(c, T.ArrayType(T.DoubleType() if c in ("mean", "m2") else T.LongType())) for c in ("n", "c", "mean", "m2")]])

    def rows(held: dict, keys: list) -> pa.RecordBatch:
        columns = [pa.array([k[i] for k in held], t.type) for i, t in enumerate(keys)]
        return pa.RecordBatch.from_arrays([*columns, *[pa.array([s[i] for s in held.values()]) for i in range(4)]], names=schema.fieldNames())

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, keys = {}, []
        for batch in batches:
            keys = [batch.schema.field(k) for k in by]
            values = batch.column(feat)
            sizes = pc.fill_null(pc.list_value_length(values), 0).to_numpy()
            groups = list(zip(*[batch.column(k).to_pylist() for k in by])) if by else [()] * batch.num_rows
            places: dict = {}
            for i, key in enumerate(zip(groups, sizes.tolist())):
                places.setdefault(key, []).append(i)
            for (key, size), at in places.items():
                if size:
                    flat = (values if len(at) == batch.num_rows else values.take(pa.array(at))).flatten()
                    x = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(at), size)
                    have = None if not flat.null_count else flat.is_valid().to_numpy(zero_copy_only=False).reshape(x.shape)
                    held[key] = merged_moments(held[key], array_moments(x, have)) if key in held else array_moments(x, have)
            if len(held) > 4096:
                yield rows(held, keys)
                held = {}
        if held:
            yield rows(held, keys)

    states = frames.select(*by, F.col(feat).alias(feat)).mapInArrow(fold, schema)
    x = states.select(*by, F.posexplode(F.arrays_zip("n", "c", "mean", "m2")).alias("dim", "s"))
    x = x.groupBy(*by, "dim").agg(F.sum("s.n").alias("n"), F.collect_list(F.struct("s.c", "s.mean", "s.m2")).alias("_s"))
    zero = F.struct(F.lit(0).cast("long").alias("c"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def add(a: Column, b: Column) -> Column:
        c, d = a["c"] + b["c"], b["mean"] - a["mean"]
        joint = F.struct(c.alias("c"), (a["mean"] + d * b["c"] / c).alias("mean"), (a["m2"] + b["m2"] + d * d * a["c"] * b["c"] / c).alias("m2"))
        return F.when(b["c"] == 0, a).otherwise(joint)

    return x.withColumn("_s", F.aggregate("_s", zero, add)).select(*by, "dim", "n", "_s.c", "_s.mean", "_s.m2")


def array_moments(x: np.ndarray, have: np.ndarray | None) -> tuple:
    """(frames, values, mean, sum of squared deviations) per column of a matrix."""
    n = np.full(x.shape[1], len(x))
    if have is None:
        mean = x.mean(axis=0)
        return n, n, mean, ((x - mean) ** 2).sum(axis=0)
    c = have.sum(axis=0)
    mean = np.where(have, x, 0.0).sum(axis=0) / np.maximum(c, 1)
    return n, c, mean, (np.where(have, x - mean, 0.0) ** 2).sum(axis=0)


def merged_moments(a: tuple, b: tuple) -> tuple:
    size = max(len(a[0]), len(b[0]))
    (na, ca, ma, sa), (nb, cb, mb, sb) = ([np.pad(v, (0, size - len(v))) for v in s] for s in (a, b))
    c = ca + cb
    share = cb / np.maximum(c, 1)
    d = np.where(cb > 0, mb - ma, 0.0)
    return na + nb, c, np.where(ca > 0, ma + d * share, mb), sa + sb + np.where(ca > 0, d * d * ca * share, 0.0)


def masked_mean_std(frames: DataFrame, feat: str = "feat", mask: str | None = None) -> DataFrame:
    """dim, mean, std, n over the unmasked frames; a dimension of nulls has null statistics."""
    x = moments(frames.where(F.col(mask) > 0) if mask else frames, feat)
    known = lambda v: F.when(F.col("c") > 0, v)
    return x.select("dim", known(F.col("mean")).alias("mean"), known(F.sqrt(F.col("m2") / F.col("c"))).alias("std"), "n")


def mean_var_state(frames: DataFrame, feat: str = "feat", by: list[str] | None = None) -> DataFrame:
    """Mergeable state dim, n, mean, m2 (sum of squared deviations), per batch when ``by`` is given."""
    return moments(frames, feat, by).select(*(by or []), "dim", F.col("c").alias("n"), "mean", "m2")


def merge_mean_var(*states: DataFrame) -> DataFrame:
    """One state from many: counts add, means weigh, spreads gain the shift of each mean from the common one."""
    x = states[0].select("dim", "n", "mean", "m2")
    for s in states[1:]:
        x = x.unionByName(s.select("dim", "n", "mean", "m2"))
    total, weighted = F.sum("n"), F.sum(F.col("n") * F.col("mean"))
    mean = weighted / total
    squares = F.sum(F.col("m2") + F.col("n") * F.col("mean") * F.col("mean"))
    return x.groupBy("dim").agg(total.alias("n"), mean.alias("mean"), (squares - total * mean * mean).alias("m2"))


def stats_vector(stats: DataFrame) -> DataFrame:
    """One row of aligned arrays (mean, std) from per-dimension statistics; its size is the number of dimensions."""
    rows = F.sort_array(F.collect_list(F.struct("dim", "mean", "std")))
    return stats.agg(rows.alias("s")).select(F.col("s.mean").alias("_mean"), F.col("s.std").alias("_std"))


def normalize(frames: DataFrame, stats: DataFrame, feat: str = "feat") -> DataFrame:
    """Centered and divided by the deviation; a constant dimension is centered only."""
    z = F.zip_with(F.zip_with(F.col(feat).cast("array<double>"), "_mean", lambda x, m: x - m), "_std", lambda x, s: F.when(s == 0, x).otherwise(x / s))
    return with_row(frames, stats_vector(stats)).withColumn(feat, z).drop("_mean", "_std")


def denormalize(frames: DataFrame, stats: DataFrame, feat: str = "feat") -> DataFrame:
    z = F.zip_with(F.zip_with(feat, "_std", lambda x, s: x * s), "_mean", lambda x, m: x + m)
    return with_row(frames, stats_vector(stats)).withColumn(feat, z).drop("_mean", "_std")


def charset_vocabulary(texts: DataFrame, text: str = "text") -> DataFrame:
    """symbol, id: distinct characters in code order from 1, ``<NULL>`` is 0.

    Characters are made distinct per text before the shuffle; the result is at most the Unicode repertoire.
    """
    chars = texts.select(F.explode(F.array_distinct(F.split(text, ""))).alias("symbol")).where("symbol <> ''").distinct()
    ranked = position(chars, [], ["symbol"], "_r").select("symbol", (F.col("_r") + 1).cast("int").alias("id"))
    null = texts.sparkSession.createDataFrame([("<NULL>", 0)], "symbol string, id int")
    return ranked.unionByName(null)


def peak_rescale(signal: DataFrame, keys: list[str], value: str = "x", top: float = 0.999, block: int = BLOCK) -> DataFrame:
    """Largest magnitude to ``top``; a silent signal stays zero."""
    x = with_totals(signal, keys, {"_peak": F.max(F.abs(value))}, block=block)
    return x.withColumn(value, F.when(F.col("_peak") == 0, F.lit(0.0)).otherwise(F.col(value) / F.col("_peak") * top)).drop("_peak")


def minmax_rescale(signal: DataFrame, keys: list[str], value: str = "x", gain: float = 0.9, block: int = BLOCK) -> DataFrame:
    """To [-1, 1], times the gain, as 16-bit integers (cut towards zero); a constant signal becomes zero."""
    x = with_totals(signal, keys, {"_lo": F.min(value), "_hi": F.max(value)}, block=block)
    unit = F.when(F.col("_hi") == F.col("_lo"), F.lit(0.0)).otherwise(2 * (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) - 1)
    return x.withColumn(value, (unit * gain * 32768.0).cast("short")).drop("_lo", "_hi")


def mean_center(signal: DataFrame, keys: list[str], value: str = "x", block: int = BLOCK) -> DataFrame:
    x = with_totals(signal, keys, {"_mean": F.avg(value)}, block=block)
    return x.withColumn(value, F.col(value) - F.col("_mean")).drop("_mean")


def max_lengths(df: DataFrame, **columns: Column) -> DataFrame:
    """Largest size per named array column."""
    return df.agg(*[F.max(F.size(v)).alias(n) for n, v in columns.items()])


def vocabulary_size(spark, cleaners: list[str]) -> DataFrame:
    """cleaner, size of the vocabulary it implies."""
    kinds = spark.createDataFrame([(n, S.vocabulary_kind(n)) for n in cleaners], "cleaner string, kind string")
    sizes = S.vocabulary(spark).groupBy("kind").agg(F.count("*").alias("size"))
    return kinds.join(F.broadcast(sizes), "kind").select("cleaner", "size")


def group_rows(df: DataFrame, key: str, row_id: str, piece: int = 10_000) -> DataFrame:
    """key, piece, ids (ordered): the rows of each key in arrays of at most ``piece`` ids."""
    ranked = position(df.select(key, row_id), [key], [row_id], "_r")
    return ranked.groupBy(key, F.expr(f"_r div {piece}").alias("piece")).agg(
        F.sort_array(F.collect_list(row_id)).alias("ids")
    )


def line_count(lines: DataFrame) -> DataFrame:
    return lines.agg(F.count("*").alias("n_lines"))
