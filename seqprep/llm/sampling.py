"""A bounded sample of labelled texts for training a classifier on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, per_class: int, usable: Column | None = None) -> list[tuple[str, int]]:
    """At most ``per_class`` (text, label) pairs of each of the labels 0 and 1, those with the smallest md5 of their key.

    ``usable`` says which keys may be learned from. Null keys, labels and texts are not used; a key labelled more than
    once takes its largest label. Whole texts are taken; the bound is the number of rows.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1))
    if usable is not None:
        known = known.where(usable)
    known = known.groupBy(F.col(key).alias("_key")).agg(F.max(label).cast("int").alias("_label"))
    by = F.md5(F.col("_key").cast("string"))
    chosen = None
    for value in (0, 1):
        part = known.where(F.col("_label") == value).orderBy(by, "_key").limit(per_class)
        chosen = part if chosen is None else chosen.unionAll(part)
    texts = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    # at most 2 * per_class rows of a key and a number
    rows = texts.join(F.broadcast(chosen), "_key").dropDuplicates(["_key"]).orderBy(F.md5(F.col("_key").cast("string"))).select("_text", "_label")
    return [(r[0], r[1]) for r in rows.collect()]


def calibration_split(sample: list[tuple[str, int]]) -> tuple[list[tuple[str, int]], list[tuple[str, int]]]:
    """The sample without every fourth text of each label, and those."""
    fit, rest, seen = [], [], {}
    for row in sample:
        seen[row[1]] = seen.get(row[1], -1) + 1
        (fit if seen[row[1]] % 4 else rest).append(row)
    return fit, rest
