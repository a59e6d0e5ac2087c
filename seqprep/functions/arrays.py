"""Array helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def one_hot(index: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (i == index).cast("double"))


def sequence_mask(length: Column, longest: Column) -> Column:
    ones, zeros = F.array_repeat(F.lit(1), length), F.array_repeat(F.lit(0), F.greatest(longest - length, F.lit(0)))
    return F.slice(F.concat(ones, zeros), F.lit(1), F.greatest(longest, F.lit(0)))


def trailing_zero_mask(values: Column) -> Column:
    """1 up to the last non-zero value, 0 in the all-zero tail."""
    from_end = F.array_position(F.transform(F.reverse(values), lambda v: v != 0), F.lit(True))
    kept = F.when(from_end > 0, F.size(values) - from_end + 1).otherwise(F.lit(0)).cast("int")
    return sequence_mask(kept, F.size(values))


def zero_frame_mask(frame: Column) -> Column:
    """0 when the frame sums to zero."""
    total = F.aggregate(frame, F.lit(0.0), lambda a, v: a + v)
    return F.when(total == 0, F.lit(0)).otherwise(F.lit(1))


def path_stem(path: Column) -> Column:
    """File name before its first dot."""
    return F.substring_index(F.substring_index(path, "/", -1), ".", 1)


def speaker_from_name(path: Column, sep: str = "_") -> Column:
    return F.substring_index(path_stem(path), sep, 1)
