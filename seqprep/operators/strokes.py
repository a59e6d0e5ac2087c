"""Pen traces: point(keys, idx, x, y, eos) with dense idx per stroke or line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqprep.operators.blocks import BLOCK, local_window, position, running, with_row, with_totals


def _gap(a: str, b: str) -> Column:
    return F.hypot(F.col(f"{a}.x") - F.col(f"{b}.x"), F.col(f"{a}.y") - F.col(f"{b}.y"))


def clear_middle(points: DataFrame, keys: list[str], bound: float = 1500.0, block: int = BLOCK) -> DataFrame:
    """Drop an inner point when the distance over it exceeds the bound, judged on the original neighbours."""
    here = F.struct("x", "y")
    x = local_window(
        points.withColumn("_p", here), keys, 1, 1,
        {"_a": lambda w: F.lag("_p").over(w), "_b": lambda w: F.lead("_p").over(w)}, pos="idx", block=block,
    )
    far = _gap("_a", "_p") + _gap("_p", "_b") > bound
    return x.where(~F.coalesce(far, F.lit(False))).drop("_p", "_a", "_b")


def separate(points: DataFrame, keys: list[str], bound: float = 600.0, block: int = BLOCK) -> DataFrame:
    """segment: a new one starts where the step distance exceeds the bound; its last point ends the stroke."""
    here = F.struct("x", "y")
    x = local_window(
        points.withColumn("_p", here), keys, 1, 1,
        {"_a": lambda w: F.lag("_p").over(w), "_b": lambda w: F.lead("_p").over(w)}, pos="idx", block=block,
    )
    cut = F.coalesce((_gap("_a", "_p") > bound).cast("int"), F.lit(0))
    ends = F.coalesce(_gap("_p", "_b") > bound, F.lit(True)) | (F.col("eos") == 1)
    x = running(x.withColumn("_cut", cut).withColumn("eos", ends.cast("int")), keys, {"segment": ("sum", F.col("_cut"))},
                order=("idx",), block=block)
    return x.drop("_p", "_a", "_b", "_cut")


def largest_gaps(strokes: DataFrame, keys: list[str], k: Column | int, block: int = BLOCK) -> DataFrame:
    """line: strokes(keys, idx, x_min, x_max, y_min, y_max) cut at the k widest gaps between neighbouring middles.

    Gaps are ranked by a range sort on (keys, gap), so a document with very many strokes is not one task.
    """
    mid = strokes.withColumn("_m", F.struct(
        ((F.col("x_min") + F.col("x_max")) / 2).alias("x"), ((F.col("y_min") + F.col("y_max")) / 2).alias("y")
    ))
    x = local_window(mid, keys, 1, 0, {"_a": lambda w: F.lag("_m").over(w)}, pos="idx", block=block)
    gap = F.abs(F.col("_m.x") - F.col("_a.x")) + F.abs(F.col("_m.y") - F.col("_a.y"))
    x = x.withColumn("_gap", gap)
    ranked = position(x.where("_gap is not null").select(*keys, "idx", (-F.col("_gap")).alias("_g")), keys, ["_g", "idx"], "_rank")
    cuts = x.join(ranked.select(*keys, "idx", "_rank"), [*keys, "idx"], "left")
    cut = F.when(F.col("_rank") < k, 1).otherwise(0)
    return running(cuts, keys, {"line": ("sum", cut)}, order=("idx",), block=block).drop("_m", "_a", "_gap", "_rank")


def line_normalize(points: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """Per line x minus its least x and y minus its mean, then both over the deviation of all y (as they are if that is zero)."""
    x = with_totals(points, keys, {"_x": F.min("x"), "_y": F.avg("y")}, "idx", block)
    x = x.withColumn("x", F.col("x") - F.col("_x")).withColumn("y", F.col("y") - F.col("_y")).drop("_x", "_y")
    std = x.agg(F.stddev_pop("y").alias("_std")).select(F.when(F.col("_std") == 0, F.lit(1.0)).otherwise(F.col("_std")).alias("_std"))
    return with_row(x, std).withColumn("x", F.col("x") / F.col("_std")).withColumn("y", F.col("y") / F.col("_std")).drop("_std")


def offsets(points: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """dx, dy, eos: differences to the previous point; the first row is (0, 0, 1)."""
    x = local_window(
        points, keys, 1, 0, {"_x": lambda w: F.lag("x").over(w), "_y": lambda w: F.lag("y").over(w)}, pos="idx", block=block
    )
    first = F.col("_x").isNull()
    return x.select(
        *keys, "idx", F.coalesce(F.col("x") - F.col("_x"), F.lit(0.0)).alias("dx"),
        F.coalesce(F.col("y") - F.col("_y"), F.lit(0.0)).alias("dy"), F.when(first, 1).otherwise(F.col("eos")).cast("int").alias("eos"),
    )
