"""Reproducible splits, shuffles and samples: order by md5(seed:id), ranked exactly by a range sort."""

from __future__ import annotations

import math
from collections.abc import Callable
from hashlib import md5

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqprep.operators.blocks import position, with_row
from seqprep.scratch import written


def hash_order(seed: object, *parts: str | Column) -> Column:
    """md5 hex of ``seed:part:part…``: the same order in every engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]).cast("binary"))


def shuffle_rank(df: DataFrame, ids: list[str], seed: object) -> DataFrame:
    """rank: place in the seeded permutation of the rows."""
    return position(df.withColumn("_h", hash_order(seed, *ids)), [], ["_h", *ids], "rank").drop("_h")


def _cut(total: Column, size: float | int) -> Column:
    return F.floor(total * size).cast("long") if isinstance(size, float) else F.lit(size).cast("long")


def shuffle_split(df: DataFrame, ids: list[str], start: float | int, stop: float | int | None, seed: object) -> DataFrame:
    """Rows ``start`` … ``stop`` of the seeded permutation (fractions or counts; None = to the end).

    Two calls with one seed and touching bounds are disjoint and exhaustive.
    """
    ranked = shuffle_rank(df, ids, seed)
    total = ranked.agg(F.count("*").alias("_total"))
    x = with_row(ranked, total).where(F.col("rank") >= _cut(F.col("_total"), start))
    if stop is not None:
        x = x.where(F.col("rank") < _cut(F.col("_total"), stop))
    return x.drop("_total")


def approximate_split(df: DataFrame, ids: list[str], start: float, stop: float, seed: object) -> DataFrame:
    """As ``shuffle_split`` by comparing the hash with a threshold: no shuffle, sizes within sampling error."""
    h = F.conv(F.substring(hash_order(seed, *ids), 1, 8), 16, 10).cast("long")
    return df.where((h >= int(start * 2**32)) & (h < int(stop * 2**32)))


def train_test_split(df: DataFrame, ids: list[str], test_size: float | int, seed: object) -> DataFrame:
    """split: ``test`` for the first fraction or count of the permutation, else ``train``."""
    ranked = shuffle_rank(df, ids, seed)
    total = ranked.agg(F.count("*").alias("_total"))
    return with_row(ranked, total).withColumn(
        "split", F.when(F.col("rank") < _cut(F.col("_total"), test_size), "test").otherwise("train")
    ).drop("_total")


def index_range_split(df: DataFrame, order: list[str], bounds: dict[str, tuple[float | int, float | int | None]]) -> DataFrame:
    """split: name of the index range that holds the row's rank; other rows are left out.

    Bounds are ranks, or shares of the number of rows if they are floats; None is the end.
    """
    ranked = position(df, [], order, "rank")
    x = with_row(ranked, ranked.agg(F.count("*").alias("_total")))
    inside = lambda a, b: (F.col("rank") >= _cut(F.col("_total"), a)) & (F.lit(True) if b is None else F.col("rank") < _cut(F.col("_total"), b))
    name = F.coalesce(*[F.when(inside(a, b), F.lit(n)) for n, (a, b) in bounds.items()])
    return x.withColumn("split", name).where("split is not null").drop("_total")


def sample_batch(df: DataFrame, ids: list[str], n: int, seed: object, batch: int) -> DataFrame:
    """n distinct rows: the first by hash (a top-k, partial per task)."""
    return df.withColumn("_h", hash_order(seed, F.lit(batch), *ids)).orderBy("_h").limit(n).drop("_h")


def sample_batches(df: DataFrame, ids: list[str], n: int, seed: object, batches: int) -> DataFrame:
    """(batch, …): several ``sample_batch`` results from one scan; each task keeps its first n of a batch before the shuffle.

    Every row is hashed for every batch; ``skip_batches`` draws any number of batches.
    """
    x = df.withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(batches - 1)))).withColumn("_h", hash_order(seed, "batch", *ids))
    place = F.row_number().over(Window.partitionBy("batch").orderBy("_h"))
    return x.withColumn("_n", place).where(F.col("_n") <= n).drop("_h", "_n")


def skip_share(n: int, total: int) -> float:
    """Share of the rows that a batch of n is drawn from: n and some eight standard deviations more."""
    return min(1.0, (n + 8 * math.sqrt(n) + 16) / max(total, 1))


def skip_batches(df: DataFrame, ids: list[str], n: int, seed: object, batches: int) -> DataFrame:
    """(batch, …): n distinct rows, or all if there are fewer, for each of any number of batches.

    A row draws the gaps between the batches that it is offered to, so that every batch is offered to the same random
    share of the rows and a row costs as many draws as offers: the work grows with the result, not with rows times
    batches. A batch takes its first n offers by hash. A batch with too few offers (about one in 10^12) is drawn from all rows. The
    choice is made on ids; the other columns join last. ``ids`` identify a row and are not null.
    """
    keyed = df.select(*ids)
    total = keyed.count()
    offered = keyed.withColumn("batch", F.explode(_offers(seed, skip_share(n, total), batches)(F.concat_ws(":", *ids))))

    def first(x: DataFrame) -> DataFrame:
        x = x.withColumn("_h", hash_order(seed, "batch", *ids))
        place = F.row_number().over(Window.partitionBy("batch").orderBy("_h", *ids))
        return x.withColumn("_n", place).where(F.col("_n") <= n).drop("_h", "_n")

    chosen = written(first(offered), "batches")
    full = chosen.groupBy("batch").count().where(F.col("count") >= min(n, total)).select("batch")
    short = [r[0] for r in df.sparkSession.range(batches).select(F.col("id").cast("int").alias("batch")).join(full, "batch", "left_anti").collect()] if total else []
    if short:
        again = first(keyed.withColumn("batch", F.explode(F.array(*map(F.lit, short)))))
        chosen = chosen.join(again.select("batch").distinct(), "batch", "left_anti").unionByName(again)
    return df.join(chosen, ids)


def _offers(seed: object, share: float, batches: int) -> Callable[[Column], Column]:
    """Numbers of the batches that a row, given by its id, is offered to."""
    log_rest = math.log(1 - share) if share < 1 else None

    def draw(row: str) -> list[int]:
        if log_rest is None:
            return list(range(batches))
        out, at, j = [], -1, 0
        while True:
            u = (int(md5(f"{seed}:gap:{j}:{row}".encode()).hexdigest()[:13], 16) + 1) / 2.0**52
            at, j = at + 1 + int(math.log(u) / log_rest), j + 1
            if at >= batches:
                return out
            out.append(at)

    @F.arrow_udf("array<int>")
    def kernel(rows: pa.Array) -> pa.Array:
        return pa.array([draw(r) for r in rows.to_pylist()], pa.list_(pa.int32()))

    return kernel


def similar_length_order(
    df: DataFrame, ids: list[str], length: Column, batch: int, seed: object, group: int | None = None, permute: bool = True
) -> DataFrame:
    """place: an order of similar lengths with the batches shuffled.

    Rows are ranked by length, shuffled inside groups of ``group`` (default 32 batches, or what fits), whole batches of
    the full groups are permuted, and the tail is shuffled at the end. Groups are bounded, batches are ranked globally.
    """
    ranked = position(df.withColumn("_length", length), [], ["_length", *ids], "_rank")
    total = ranked.agg(F.count("*").alias("_total"))
    size = F.lit(group) if group else (F.least(F.lit(batch * 32), F.col("_total")) - F.least(F.lit(batch * 32), F.col("_total")) % batch)
    # fewer rows than one batch: everything is tail
    total = total.withColumn("_size", F.greatest(size, F.lit(1)).cast("long")).withColumn(
        "_full", F.expr(f"if(_total < {batch}, 0, _total div _size * _size)")
    )
    x = with_row(ranked, total).withColumn("_tail", F.col("_rank") >= F.col("_full"))
    x = x.withColumn("_group", F.expr("_rank div _size")).withColumn("_h", hash_order(seed, *ids))
    w = Window.partitionBy("_group", "_tail").orderBy("_h", *ids)
    x = x.withColumn("_in", F.expr("_group * _size") + F.row_number().over(w) - 1)
    x = x.withColumn("_batch", F.expr(f"_in div {batch}"))
    if not permute:
        return x.withColumn("place", F.col("_in").cast("long")).drop(*_ORDER_HELPERS)
    batches = x.where("not _tail").select("_batch").distinct().withColumn("_bh", hash_order(f"{seed}:batch", "_batch"))
    order = position(batches, [], ["_bh", "_batch"], "_new").drop("_bh")
    x = x.join(order, "_batch", "left")
    place = F.when(F.col("_tail"), F.col("_in")).otherwise(F.col("_new") * batch + F.col("_in") % batch)
    return x.withColumn("place", place.cast("long")).drop(*_ORDER_HELPERS)


_ORDER_HELPERS = ["_length", "_rank", "_total", "_size", "_full", "_tail", "_group", "_h", "_in", "_batch", "_new"]


def grouped_shuffle(df: DataFrame, key: str, ids: list[str], batch: int, seed: object) -> DataFrame:
    """place: groups permuted, members together in id order, cut to whole batches."""
    ranked = position(df.withColumn("_h", hash_order(seed, key)), [], ["_h", key, *ids], "place").drop("_h")
    total = ranked.agg(F.count("*").alias("_total"))
    return with_row(ranked, total).where(F.expr(f"place < _total - _total % {batch}")).drop("_total")


def random_crop(length: Column, max_steps: int, hop: int, seed: object, *ids: str) -> Column:
    """struct(start, stop): hop-aligned crop of at most ``max_steps`` rounded down to a multiple of the hop."""
    frames = max_steps // hop
    room = F.floor(length / hop).cast("long") - frames
    draw = F.conv(F.substring(hash_order(seed, *ids), 1, 8), 16, 10).cast("long")
    start = F.when(length > frames * hop, F.pmod(draw, F.greatest(room, F.lit(1))) * hop).otherwise(F.lit(0))
    stop = F.when(length > frames * hop, start + frames * hop).otherwise(length - length % hop)
    return F.struct(start.cast("long").alias("start"), stop.cast("long").alias("stop"))


def per_key_cap(df: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """At most n rows per key. Ranks inside random sub-groups first, so a heavy key never meets in one task."""
    salted = Window.partitionBy(key, "_salt").orderBy(*order)
    x = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(64))).withColumn("_r", F.row_number().over(salted))
    x = x.where(F.col("_r") <= n).drop("_r")
    w = Window.partitionBy(key).orderBy(*order)
    return x.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r", "_salt")
