"""Chunks, lanes, padding and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqprep.functions import arrays as A
from seqprep.functions import symbols as S
from seqprep.operators.blocks import BLOCK, position, running, spread, with_row, with_totals
from seqprep.operators.sampling import grouped_shuffle, sample_batches, skip_batches


def chunk_overlap1(seq: DataFrame, keys: list[str], length: int, block: int = BLOCK) -> DataFrame:
    """chunk, step: chunks of ``length + 1`` rows with stride ``length``; an incomplete tail is dropped."""
    x = with_totals(seq, keys, {"_n": F.count("*")}, block=block)
    own = F.expr(f"pos div {length}")
    both = F.when((F.col("pos") % length == 0) & (F.col("pos") > 0), F.array(own - 1, own)).otherwise(F.array(own))
    x = x.withColumn("chunk", F.explode(both)).where(F.expr(f"(chunk + 1) * {length} + 1 <= _n"))
    return x.withColumn("step", (F.col("pos") - F.col("chunk") * length).cast("int")).drop("_n")


def chunk_padded(seq: DataFrame, keys: list[str], length: int, value: str = "x") -> DataFrame:
    """(keys, chunk, step, value, mask): chunks without overlap, the last padded with zeros of mask 0."""
    ends = seq.groupBy(*keys).agg((F.max("pos") + 1).alias("_n"))
    pads = ends.where(f"_n % {length} <> 0").select(
        *keys, F.explode(F.expr(f"sequence(_n, (_n div {length} + 1) * {length} - 1)")).alias("pos"),
        F.lit(0).cast(seq.schema[value].dataType).alias(value), F.lit(0).alias("mask"),
    )
    x = seq.select(*keys, "pos", value, F.lit(1).alias("mask")).unionByName(pads)
    return x.select(*keys, F.expr(f"pos div {length}").alias("chunk"), (F.col("pos") % length).cast("int").alias("step"), value, "mask")


def assign_lanes(sequences: DataFrame, order: list[str], lanes: int, chunks: str = "n_chunks", block: int = BLOCK) -> DataFrame:
    """(…, chunk, lane, batch, reset): one deterministic epoch over sequences(…, n_chunks).

    The k-th sequence goes to lane k mod ``lanes``; its chunks follow those of the lane's earlier sequences. reset is 0
    on the first chunk of a sequence that follows another one in the lane, else 1.
    """
    x = position(sequences, [], order, "_rank").withColumn("lane", (F.col("_rank") % lanes).cast("int"))
    x = x.withColumn("_seq", F.expr(f"_rank div {lanes}"))
    x = running(x, ["lane"], {"_first": ("sum", F.col(chunks))}, order=("_seq",), inclusive=False, block=block)
    x = spread(x.withColumn("_top", F.col(chunks) - 1).where("_top >= 0"), "_top", "chunk").drop("_top").withColumn(
        "batch", (F.coalesce("_first", F.lit(0)) + F.col("chunk")).cast("long")
    )
    fresh = (F.col("chunk") == 0) & (F.col("_seq") > 0)
    return x.withColumn("reset", F.when(fresh, 0).otherwise(1)).drop("_rank", "_seq", "_first")


def pad_batch(rows: DataFrame, batch: str, **columns: str) -> DataFrame:
    """Arrays padded with zeros to the longest of their batch, with a ``<name>_mask`` each.

    ``columns`` maps a new name to an array column. A batch is a bounded number of rows; its longest size is joined back.
    """
    longest = rows.groupBy(batch).agg(*[F.max(F.size(c)).alias(f"_max_{n}") for n, c in columns.items()])
    out = rows.join(longest, batch)
    for n, c in columns.items():
        top = F.col(f"_max_{n}")
        zeros = F.array_repeat(F.lit(0).cast(rows.schema[c].dataType.elementType), top - F.size(c))
        out = out.withColumn(f"{n}_mask", A.sequence_mask(F.size(c), top)).withColumn(n, F.concat(c, zeros))
    return out.drop(*[f"_max_{n}" for n in columns])


def char_lanes(lines: DataFrame, order: list[str], lanes: int, steps: int, text: str = "value") -> DataFrame:
    """(batch, step, lane, char_id): lines in ``lanes`` contiguous equal blocks, the remainder dropped, ``steps``
    characters per batch; each line is closed by a newline. An incomplete last batch of a lane is kept.
    """
    x = position(lines, [], order, "_line")
    total = x.agg(F.count("*").alias("_total"))
    x = with_row(x, total).withColumn("_gap", F.expr(f"_total div {lanes}")).where(f"_line < _gap * {lanes}")
    x = x.withColumn("lane", F.expr("_line div _gap").cast("int"))
    chars = F.filter(F.split(F.concat(F.col(text), F.lit("\n")), ""), lambda c: c != "")
    x = x.withColumn("_chars", chars)
    x = running(x.drop("_gap", "_total"), ["lane"], {"_first": ("sum", F.size("_chars"))}, order=("_line",), inclusive=False,
                blk=F.expr(f"_line div {BLOCK}"))
    x = x.select("lane", F.coalesce("_first", F.lit(0)).alias("_first"), F.posexplode("_chars").alias("_i", "c"))
    at = F.col("_first") + F.col("_i")
    return x.select(
        F.expr(f"(_first + _i) div {steps}").alias("batch"), (at % steps).cast("int").alias("step"), "lane", S.char_code(F.col("c")).alias("char_id")
    )


def _fits(sizes: dict[str, int]) -> Column:
    fits = F.lit(True)
    for column, n in sizes.items():
        fits = fits & F.coalesce(F.size(column) == n, F.lit(False))
    return fits


def ragged_rows(rows: DataFrame, **sizes: int) -> DataFrame:
    """Rows with a named array that is null or not of the wanted size."""
    return rows.where(~_fits(sizes))


def fixed_batches(rows: DataFrame, ids: list[str], batch: int, seed: object, batches: int, ragged: str = "raise", skip: bool = False, **sizes: int) -> DataFrame:
    """Seeded batches of distinct rows; ``sizes`` names array columns and the size every row must have.

    ``skip`` draws them by ``skip_batches``, whose work does not grow with rows times batches: for whole epochs.
    Rows of another size fail the job, or are left out with ``ragged="leave"`` (``ragged_rows`` returns them).
    """
    if ragged not in ("raise", "leave"):
        raise ValueError(f"unknown treatment of ragged rows: {ragged}")
    fits = _fits(sizes)
    rows = rows.where(fits if ragged == "leave" else F.when(fits, True).otherwise(F.raise_error("a row has another size").cast("boolean")))
    return (skip_batches if skip else sample_batches)(rows, ids, batch, seed, batches)


def grouped_batches(rows: DataFrame, key: str, ids: list[str], batch: int, seed: object) -> DataFrame:
    """batch: whole batches along the grouped shuffle."""
    return grouped_shuffle(rows, key, ids, batch, seed).withColumn("batch", F.expr(f"place div {batch}"))


def restored(chunks: DataFrame, keys: list[str], length: int) -> DataFrame:
    """The rows of ``chunk_overlap1`` output, each once."""
    return chunks.where((F.col("step") < length)).select(*keys, (F.col("chunk") * length + F.col("step")).alias("pos"), "x")
