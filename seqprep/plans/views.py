"""Tables and derived views of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqprep.operators.blocks import position


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def balanced(df: DataFrame) -> DataFrame:
    """Spread a small input that the scan would put in fewer tasks than there are cores; large inputs pass through."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def documents(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return balanced(table(spark, folder, "documents").select("doc_id", *columns))


def signal(spark: SparkSession, folder: str) -> DataFrame:
    """signal(utt, pos, x, event_id, event_type): events per user in time order."""
    ev = table(spark, folder, "events").select(F.col("user_id").alias("utt"), "ts", "event_id", "event_type", F.col("value").alias("x"))
    return position(ev, ["utt"], ["ts", "event_id"])


def samples(spark: SparkSession, folder: str) -> DataFrame:
    return signal(spark, folder).select("utt", "pos", "x")


def notes(spark: SparkSession, folder: str) -> DataFrame:
    """note(piece, voice, idx, pitch, dur, fermata) from the events of two users."""
    return notes_of(signal(spark, folder), 2)


def notes_of(sig: DataFrame, voices: int) -> DataFrame:
    return sig.select(
        F.expr(f"utt div {voices}").alias("piece"), (F.col("utt") % voices).cast("int").alias("voice"), F.col("pos").alias("idx"),
        F.when(F.col("event_type") == "error", 0).otherwise(48 + F.col("event_id") % 25).cast("int").alias("pitch"),
        F.element_at(F.array(*map(F.lit, (0.25, 0.5, 1.0, 2.0))), (F.col("event_id") % 4 + 1).cast("int")).alias("dur"),
        (F.col("event_type") == "purchase").cast("int").alias("fermata"),
    )


def trace(spark: SparkSession, folder: str) -> DataFrame:
    """point(doc, idx, x, y, eos): one stroke per user."""
    return signal(spark, folder).select(
        F.col("utt").alias("doc"), F.col("pos").alias("idx"), "x", (F.col("event_id") % 100).cast("double").alias("y"),
        (F.col("event_type") == "purchase").cast("int").alias("eos"),
    )


def frames(spark: SparkSession, folder: str) -> DataFrame:
    """frame(vec_id, label, feat)."""
    return table(spark, folder, "embeddings").select("vec_id", "label", F.col("embedding").alias("feat"))
