"""Connected components of a table of links by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqprep.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that has a link, ``links`` being (a, b) longs; root is the smallest node reachable.

    Each step is a grouped minimum and a join back, written to the shared folder; hubs are pre-aggregated and their
    joins are ordinary ones that split hot keys. Steps go on until the links no longer change, when they form stars.
    """
    links = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.where("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # a node that is its own lowest keeps its links; all others hand theirs to their lowest
        large = written(large.where("a <> b").distinct(), "links")
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = written(small.unionAll(lowest.select("a", F.col("m").alias("b"))).distinct(), "links")
        now = links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.shiftrightunsigned(F.xxhash64("b", "a"), 24))).first()
        if now == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
                links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        before = now
