"""Batches by skips: distinct rows, any number of batches, an even choice, and the exact way for short ones."""

import collections

from pyspark.sql import functions as F

from seqprep.operators import sampling as K


def test_a_hundred_thousand_batches(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    n = rows.count()
    got = K.skip_batches(rows, ["vec_id"], 2, "epoch", 100_000).select("vec_id", "batch", "embedding")
    batches = got.groupBy("batch").agg(F.count("*").alias("n"), F.count_distinct("vec_id").alias("d"))
    r = batches.agg(F.count("*"), F.min("n"), F.max("n"), F.min("d"), F.min("batch"), F.max("batch")).first()
    assert tuple(r) == (100_000, 2, 2, 2, 0, 99_999)
    uses = [x["count"] for x in got.groupBy("vec_id").count().collect()]
    mean = 200_000 / n
    assert len(uses) == n and max(abs(u - mean) for u in uses) < 6 * mean**0.5


def test_short_batches_are_drawn_from_all_rows(spark, monkeypatch):
    rows = spark.range(300).select(F.col("id").alias("k"), F.lit("x").alias("batch_text"))
    monkeypatch.setattr(K, "skip_share", lambda n, total: 0.03)
    got = K.skip_batches(rows, ["k"], 8, 1, 60).collect()
    count = collections.Counter(r.batch for r in got)
    assert count == {b: 8 for b in range(60)} and len({(r.batch, r.k) for r in got}) == 480
    # a batch drawn from all rows is the plain sample
    plain = {b: {r.k for r in K.sample_batch(rows, ["k"], 8, 1, b).collect()} for b in range(4)}
    assert any({r.k for r in got if r.batch == b} == plain[b] for b in range(4))


def test_fewer_rows_than_a_batch(spark):
    rows = spark.range(3).withColumnRenamed("id", "k")
    assert collections.Counter(r.batch for r in K.skip_batches(rows, ["k"], 5, 1, 4).collect()) == {b: 3 for b in range(4)}
    assert K.skip_batches(rows.limit(0), ["k"], 5, 1, 4).count() == 0


def test_ranges_by_share_and_rank(spark):
    rows = spark.range(10).withColumnRenamed("id", "k")
    got = {r.k: r.split for r in K.index_range_split(rows, ["k"], {"a": (0, 0.3), "b": (5, None)}).collect()}
    assert got == {0: "a", 1: "a", 2: "a", 5: "b", 6: "b", 7: "b", 8: "b", 9: "b"}
