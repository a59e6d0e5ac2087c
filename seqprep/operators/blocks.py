"""Ordered-sequence building blocks that stay balanced when one key holds most rows.

A window over ``partitionBy(key)`` puts a whole key in one task. Here a sequence is a table with a dense 0-based
position per key, and every ordered computation works on blocks of positions:

* ``position``      dense positions from a range sort (balanced whatever the keys look like), one exchange
* ``local_window``  lag / lead / bounded frames: rows near a block edge are copied into the neighbouring block
* ``running``       cumulative aggregates: totals per block, carried over the short list of blocks, then added
* ``with_totals``   per-key totals joined back on (key, block), so a heavy key is spread over many join keys
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Iterator, Tuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqprep.scratch import written

BLOCK = 1 << 17


def _cols(names: Sequence[str]) -> list[Column]:
    return [F.col(n) for n in names]


def position(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], out: str = "pos") -> DataFrame:
    """Number the rows of each key 0, 1, 2, … in ``order``. ``keys=[]`` gives an exact global rank.

    ``keys + order`` must identify a row. One full exchange: the rows are range-partitioned and sorted on ``keys +
    order``, numbered inside the partition and written once. A key that goes on from an earlier partition gets a carry
    from a table of one row per partition, which is broadcast.
    """
    keys = list(keys)
    sort = [*_cols(keys), *[F.col(o) if isinstance(o, str) else o for o in order]]
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = df.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("_part", F.spark_partition_id())
    rows = rows.withColumn("_in", _place_in_key(df, keys) if keys else place)
    # only the first key of a partition can go on from an earlier one
    rows = written(rows.withColumn("_head", F.col("_in") == place), "sorted")
    # sorted, so the smallest and the largest key of a partition are its first and last one
    key = F.struct(*_cols(keys)) if keys else F.struct(F.lit(0).alias("all"))
    ends = rows.groupBy("_part").agg(F.min(key).alias("first"), F.max(F.struct(key.alias("key"), F.col("_in"))).alias("last")).collect()
    carried, before, total = [], None, 0
    for part, first, last in sorted(ends, key=lambda r: r[0]):
        carry = total if before is not None and _same(first, before) else 0
        carried.append((part, carry))
        total = last["_in"] + 1 + (carry if _same(first, last["key"]) else 0)
        before = last["key"]
    table = df.sparkSession.createDataFrame(carried, "_part int, _carry long")
    more = F.when(F.col("_head"), F.col("_carry")).otherwise(F.lit(0))
    return rows.join(F.broadcast(table), "_part").select(*df.columns, (F.col("_in") + more).cast("long").alias(out))


def _same(a: object, b: object) -> bool:
    """Equal values, where null equals null and nan equals nan, as in a sort."""
    if isinstance(a, (tuple, list)) and isinstance(b, (tuple, list)):
        return len(a) == len(b) and all(map(_same, a, b))
    return a == b or (a != a and b != b)


def _place_in_key(df: DataFrame, keys: list[str]) -> Column:
    """0, 1, 2, … along the rows of a task as long as the keys stay the same; only the keys leave the JVM."""
    # texts of nested keys differ if the keys do
    columns = [F.to_json(F.struct(k)) if isinstance(df.schema[k].dataType, (T.ArrayType, T.StructType, T.MapType)) else F.col(k) for k in keys]

    @F.arrow_udf("long")
    def place(batches: Iterator[Tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        last, run = None, 0
        for batch in batches:
            batch = (batch,) if isinstance(batch, pa.Array) else batch
            n = len(batch[0])
            if not n:
                yield pa.array([], pa.int64())
                continue
            new = np.zeros(n, bool)
            for c in batch:
                # null equals null; nan equals nan, as in the sort
                codes = c.dictionary_encode(null_encoding="encode").indices.to_numpy()
                new[1:] |= codes[1:] != codes[:-1]
            first = [c[0].as_py() for c in batch]
            new[0] = last is None or not all(a == b or (a != a and b != b) for a, b in zip(first, last))
            at = np.arange(n)
            start = np.maximum.accumulate(np.where(new, at, -1))
            out = np.where(start < 0, at + run, at - start)
            last, run = [c[-1].as_py() for c in batch], int(out[-1]) + 1
            yield pa.array(out)

    return place.asNondeterministic()(*columns)


def block_of(block: int, pos: str = "pos") -> Column:
    return F.expr(f"{pos} div {block}")


def local_window(
    df: DataFrame,
    keys: Sequence[str],
    before: int,
    after: int,
    columns: dict[str, Callable[[Window], Column]],
    pos: str = "pos",
    block: int = BLOCK,
) -> DataFrame:
    """Add window columns that look at most ``before`` rows back and ``after`` rows ahead.

    ``pos`` must be dense per key. ``columns`` maps a new name to a function of the ordered window.
    """
    size = max(block, before + after + 1)
    home = F.expr(f"{pos} div {size}")
    first = F.greatest(F.expr(f"({pos} - {after}) div {size}"), F.lit(0).cast("long"))
    last = F.expr(f"({pos} + {before}) div {size}")
    near = F.when(first == last, F.array(home)).otherwise(F.sequence(first, last))
    x = df.withColumn("_home", home).withColumn("_blk", F.explode(near))
    w = Window.partitionBy(*keys, "_blk").orderBy(pos)
    x = x.select("*", *[f(w).alias(n) for n, f in columns.items()])
    return x.where("_blk = _home").drop("_blk", "_home")


def running(
    df: DataFrame,
    keys: Sequence[str],
    columns: dict[str, tuple[str, Column]],
    order: Sequence[str] = ("pos",),
    inclusive: bool = True,
    blk: Column | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """Add cumulative ``sum`` / ``max`` / ``min`` / ``last`` columns in ``order``.

    ``columns`` maps a new name to ``(kind, value)``; ``last`` carries the latest non-null value forward. ``blk`` is a
    column that never decreases along ``order`` and bounds the rows of a block (default: blocks of the position).
    """
    blk = block_of(block, order[0]) if blk is None else blk
    x = df.withColumn("_blk", blk)
    x = x.select("*", *[v.alias(f"_v_{n}") for n, (_, v) in columns.items()])
    by = F.struct(*order)

    def total(kind: str, name: str) -> Column:
        v = F.col(f"_v_{name}")
        if kind == "last":
            return F.max_by(v, F.when(v.isNotNull(), by))
        return {"sum": F.sum, "max": F.max, "min": F.min}[kind](v)

    def scan(kind: str, v: Column, w: Window) -> Column:
        if kind == "last":
            return F.last(v, ignorenulls=True).over(w)
        return {"sum": F.sum, "max": F.max, "min": F.min}[kind](v).over(w)

    totals = x.groupBy(*keys, "_blk").agg(*[total(k, n).alias(f"_t_{n}") for n, (k, _) in columns.items()])
    wb = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *keys, "_blk", *[scan(k, F.col(f"_t_{n}"), wb).alias(f"_c_{n}") for n, (k, _) in columns.items()]
    )
    end = Window.currentRow if inclusive else -1
    w = Window.partitionBy(*keys, "_blk").orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    y = x.join(carry, [*keys, "_blk"])

    def merged(kind: str, name: str) -> Column:
        here, before = scan(kind, F.col(f"_v_{name}"), w), F.col(f"_c_{name}")
        if kind == "sum":
            return F.when(here.isNotNull() | before.isNotNull(), F.coalesce(here, F.lit(0)) + F.coalesce(before, F.lit(0)))
        if kind == "last":
            return F.coalesce(here, before)
        return (F.greatest if kind == "max" else F.least)(here, before)

    y = y.select("*", *[merged(k, n).alias(n) for n, (k, _) in columns.items()])
    return y.drop("_blk", *[f"_v_{n}" for n in columns], *[f"_c_{n}" for n in columns])


def with_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Add the columns of a one-row table to every row, as a scalar subquery that runs once before the main plan."""
    value = row.select(F.struct("*")).scalar()
    return df.withColumn("_row", value).select("*", "_row.*").drop("_row")


def spread(df: DataFrame, last: str, out: str = "_blk", stride: int = 8192) -> DataFrame:
    """One row per number 0 … ``last``, in two steps so that no array holds more than ``stride`` numbers per step."""
    step = F.explode(F.expr(f"sequence(0L, {last} div {stride})"))
    x = df.withColumn("_high", step)
    inner = F.expr(f"sequence(_high * {stride}, least(_high * {stride} + {stride - 1}, {last}))")
    return x.withColumn(out, F.explode(inner)).drop("_high")


def with_totals(
    df: DataFrame, keys: Sequence[str], aggregates: dict[str, Column], pos: str = "pos", block: int = BLOCK
) -> DataFrame:
    """Join per-key aggregates back to the rows on (key, block of the dense position)."""
    totals = df.groupBy(*keys).agg(*[a.alias(n) for n, a in aggregates.items()], F.max(pos).alias("_last"))
    blocks = spread(totals.withColumn("_last", F.expr(f"_last div {block}")), "_last").drop("_last")
    return df.withColumn("_blk", block_of(block, pos)).join(blocks, [*keys, "_blk"]).drop("_blk")


def salted_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", salts: int = 16, spread: Column | None = None
) -> DataFrame:
    """Join on keys that may be very frequent on the left: each right row is copied to ``salts`` salts."""
    by = spread if spread is not None else F.xxhash64(*left.columns)
    l = left.withColumn("_salt", F.pmod(by, F.lit(salts)).cast("int"))
    r = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return l.join(r, [*keys, "_salt"], how).drop("_salt")


def byte_size(value: Column, kind: T.DataType) -> Column:
    """Bytes that a value takes in a row, its slot included."""
    slot = F.lit(8).cast("long")
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return slot + F.coalesce(F.octet_length(value), F.lit(0))
    if isinstance(kind, T.StructType):
        return sum((byte_size(value[f.name], f.dataType) for f in kind.fields), slot)
    if isinstance(kind, T.ArrayType):
        if not isinstance(kind.elementType, (T.StringType, T.BinaryType, T.StructType, T.ArrayType, T.MapType)):
            return slot + 8 * F.coalesce(F.size(value), F.lit(0))
        total = F.aggregate(value, F.lit(0).cast("long"), lambda n, v: n + byte_size(v, kind.elementType))
        return slot + F.coalesce(total, F.lit(0))
    if isinstance(kind, T.MapType):
        return byte_size(F.map_keys(value), T.ArrayType(kind.keyType)) + byte_size(F.map_values(value), T.ArrayType(kind.valueType))
    return slot


def lookup_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left", max_rows: int = 500_000, salts: int = 16, max_bytes: int = 256 << 20
) -> DataFrame:
    """Broadcast the right side when it is measured to hold at most ``max_rows`` rows and ``max_bytes`` bytes, else salt the join."""
    width = sum((byte_size(F.col(f"`{f.name}`"), f.dataType) for f in right.schema.fields), F.lit(16))
    rows, size = right.limit(max_rows + 1).agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    if rows <= max_rows and size <= max_bytes:
        return left.join(F.broadcast(right), list(keys), how)
    return salted_join(left, right, keys, how, salts)
