"""Streaming queries: the given tables read as streams, run to their end, results in written tables."""

from __future__ import annotations
from pyspark.sql import functions as F

from seqprep.plans import sql as Q
from seqprep.plans import views as V
from seqprep.plans.registry import query
from seqprep.scratch import scratch_path
from seqprep.streaming import jobs as J


def source(spark, folder, name):
    schema = V.table(spark, folder, name).schema
    # the last letter in brackets makes the file a pattern, as stream sources read folders or patterns
    return spark.readStream.schema(schema).parquet(f"{folder}/{name[:-1]}[{name[-1]}].parquet")


def place(spark, label):
    return scratch_path(spark, label)


def run(query):
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def to_parquet(spark, stream, label):
    out = place(spark, label)
    run(stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", place(spark, f"{label}-cp")).trigger(availableNow=True).start())
    return spark.read.parquet(out)


@query("stream_clean", Q.chain("SELECT doc_id, text AS t FROM documents", Q.ENGLISH, "SELECT doc_id, t AS clean FROM done"))
def stream_clean(spark, folder):
    docs = source(spark, folder, "documents").select("doc_id", "text")
    return to_parquet(spark, J.stream_clean(docs, "text").select("doc_id", "clean"), "clean")


@query("stream_chunks", f"""
WITH {Q.SIGNAL}, n AS (SELECT utt, count(*) AS n FROM signal GROUP BY utt), c AS (SELECT utt, unnest(range(0, (n - 1) // 10)) AS chunk FROM n)
SELECT c.utt, c.chunk, (s.pos - c.chunk * 10)::INT AS step, s.x, CASE WHEN c.chunk = 0 THEN 0 ELSE 1 END AS reset FROM c JOIN signal s ON s.utt = c.utt AND s.pos BETWEEN c.chunk * 10 AND c.chunk * 10 + 10""")
def stream_chunks(spark, folder):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    ev = source(spark, folder, "events").select(F.col("user_id").alias("utt"), F.unix_micros(F.col("ts").cast("timestamp")).alias("pos"), F.col("value").alias("x"))
    return to_parquet(spark, J.stream_chunks(ev, 10), "chunks")


@query("stream_mean_var", f"""
WITH e AS (SELECT i - 1 AS dim, embedding[i]::DOUBLE AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS i))
SELECT dim::INT AS dim, {Q.r('avg(v)')} AS mean, {Q.r('stddev_pop(v)')} AS std, count(*)::BIGINT AS n FROM e GROUP BY dim""")
def stream_mean_var(spark, folder):
    out = place(spark, "stats")
    stats = J.stream_mean_var(source(spark, folder, "embeddings").select(F.col("embedding").alias("feat")))
    keep = lambda batch, epoch: batch.write.mode("overwrite").parquet(out)
    run(stats.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", place(spark, "stats-cp")).trigger(availableNow=True).start())
    return spark.read.parquet(out).select("dim", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n")


@query("stream_feature_cache", "SELECT doc_id, len(text)::INT AS chars FROM documents")
def stream_feature_cache(spark, folder):
    out = place(spark, "features")
    docs = source(spark, folder, "documents").select("doc_id", "text")
    run(J.stream_feature_cache(docs, lambda d: d.select("doc_id", F.length("text").alias("chars")), out, place(spark, "features-cp")))
    return spark.read.parquet(out).drop("epoch")
