"""A stream must give what the batch gives."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from seqprep.functions import text as T
from seqprep.operators import aggregates as AG
from seqprep.operators import batching as B
from seqprep.streaming import jobs as J


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="seqprep-stream-")


def run(query):
    query.awaitTermination(240)
    assert query.exception() is None


def start(df, folder, name, mode="append"):
    return df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{folder}/{name}").trigger(availableNow=True).start()


def test_stream_clean(spark, folder):
    spark.createDataFrame([("Mr. X 12",), ("The USA",)], "value string").write.text(f"{folder}/in")
    q = start(J.stream_clean(spark.readStream.text(f"{folder}/in")), folder, "cleaned")
    run(q)
    got = {tuple(r) for r in spark.table("cleaned").collect()}
    want = spark.read.text(f"{folder}/in").withColumn("clean", T.english_cleaners(F.col("value"))).collect()
    assert got == {tuple(r) for r in want}


def test_stream_mean_var(spark, folder):
    frames = spark.createDataFrame([(float(i), [float(i), float(i * i)]) for i in range(10)], "id double, feat array<double>")
    frames.repartition(3).write.parquet(f"{folder}/in")
    src = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    run(start(J.stream_mean_var(src), folder, "stats", "complete"))
    got = {r.dim: (r.mean, r.std, r.n) for r in spark.table("stats").collect()}
    for r in AG.masked_mean_std(frames).collect():
        assert got[r.dim] == pytest.approx((r.mean, r.std, r.n))


def test_stream_feature_cache(spark, folder):
    spark.range(5).write.parquet(f"{folder}/in")
    src = lambda: spark.readStream.schema("id long").parquet(f"{folder}/in")
    double = lambda d: d.withColumn("v", F.col("id") * 2)
    run(J.stream_feature_cache(src(), double, f"{folder}/out", f"{folder}/cp"))
    spark.range(5, 8).write.mode("append").parquet(f"{folder}/in")
    run(J.stream_feature_cache(src(), double, f"{folder}/out", f"{folder}/cp"))
    assert sorted((r.id, r.v) for r in spark.read.parquet(f"{folder}/out").collect()) == [(i, 2 * i) for i in range(8)]


def test_stream_chunks(spark, folder):
    rows = [(u, p, float(u * 100 + p)) for u in (1, 2) for p in range(23)]
    df = spark.createDataFrame(rows, "utt long, pos long, x double")
    os.makedirs(f"{folder}/in")
    for n, (a, b) in enumerate(((0, 7), (7, 8), (8, 23))):
        df.where(f"pos >= {a} and pos < {b}").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{folder}/in")
    run(start(J.stream_chunks(src, 5), folder, "chunks"))
    got = {(r.utt, r.chunk, r.step): r.x for r in spark.table("chunks").collect()}
    want = {(r.utt, r.chunk, r.step): r.x for r in B.chunk_overlap1(df, ["utt"], 5).collect()}
    assert got == want
    assert {r.reset for r in spark.table("chunks").where("chunk = 0").collect()} == {0}


def test_stream_chunks_of_one_heavy_key(spark, folder):
    """One key holds most rows of one micro-batch over many files in mixed order, in frames of 100 rows."""
    rows = [(1, p, float(p % 977)) for p in range(6000)] + [(u, p, 1.0) for u in (2, 3) for p in range(12)]
    df = spark.createDataFrame(rows, "utt long, pos long, x double")
    df.where("pos < 5000").orderBy(F.rand(3)).repartition(12).write.parquet(f"{folder}/in")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        src = lambda: spark.readStream.schema(df.schema).parquet(f"{folder}/in")
        q = lambda: J.stream_chunks(src(), 64).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
        run(q())
        df.where("pos >= 5000").coalesce(1).write.mode("append").parquet(f"{folder}/in")
        run(q())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = {(r.utt, r.chunk, r.step): r.x for r in spark.read.parquet(f"{folder}/out").collect()}
    assert got == {(r.utt, r.chunk, r.step): r.x for r in B.chunk_overlap1(df, ["utt"], 64).collect()}
