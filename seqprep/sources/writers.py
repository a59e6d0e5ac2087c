"""Sinks, the feature cache and the reject table."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def manifest_lines(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]).alias("value"))


def write_manifest(df: DataFrame, columns: list[str], path: str) -> None:
    manifest_lines(df, columns).write.text(path)


def manifest_summary(df: DataFrame, steps: str, text: str, rate: float) -> DataFrame:
    """count, total steps, hours, longest text, longest output."""
    return df.agg(
        F.count("*").alias("utterances"), F.sum(F.col(steps).cast("long")).alias("steps"),
        (F.sum(F.col(steps).cast("long")) / float(rate) / 3600.0).alias("hours"),
        F.max(F.length(text)).cast("long").alias("longest_text"), F.max(F.col(steps).cast("long")).alias("longest_output"),
    )


def sampling_lines(pairs: DataFrame, name: str, index: str, before: str, after: str) -> DataFrame:
    """value: ``name_index : before : after``."""
    return pairs.select(F.concat_ws(" : ", F.concat_ws("_", name, F.col(index).cast("string")), before, after).alias("value"))


def write_sampling_summary(pairs: DataFrame, path: str, name: str, index: str, before: str, after: str) -> None:
    sampling_lines(pairs, name, index, before, after).write.text(path)


def params_hash(params: dict) -> str:
    return hashlib.md5(json.dumps(params, sort_keys=True).encode()).hexdigest()[:16]


def cached_features(
    spark: SparkSession, source: DataFrame, key: str, params: dict, compute: Callable[[DataFrame], DataFrame], path: str,
    force_refresh: bool = False,
) -> DataFrame:
    """Compute feature rows once per (key, parameters) and read them back.

    The table is parquet partitioned by a hash of the parameters, so other settings are pruned; a later run computes only
    keys that are not there yet and appends them. ``force_refresh`` recomputes this parameter set and replaces it.
    """
    tag = params_hash(params)

    def stored() -> DataFrame | None:
        try:
            return spark.read.parquet(path).where(F.col("params") == tag)
        except AnalysisException:
            return None

    have = None if force_refresh else stored()
    todo = source if have is None else source.join(have.select(key), key, "left_anti")
    writer = compute(todo).withColumn("params", F.lit(tag)).write.partitionBy("params")
    if force_refresh:
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    else:
        writer.mode("append").parquet(path)
    return stored().drop("params")


def quarantine(df: DataFrame, value: Column, error: str = "failed") -> dict[str, DataFrame]:
    """Rows whose ``value`` is NULL go to ``rejects`` with an error column, the others to ``good``."""
    x = df.withColumn("value", value)
    return {
        "good": x.where("value is not null"),
        "rejects": x.where("value is null").drop("value").withColumn("error", F.lit(error)),
    }


def retry_rejects(result: dict[str, DataFrame], value: Column) -> dict[str, DataFrame]:
    """One retry of the rejects with another expression (for instance a refreshed read)."""
    again = quarantine(result["rejects"].drop("error"), value, "failed twice")
    return {"good": result["good"].unionByName(again["good"]), "rejects": again["rejects"]}
