"""Pairing, pruning and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqprep.functions import arrays as A
from seqprep.functions import symbols as S
from seqprep.operators.blocks import lookup_join, with_row
from seqprep.operators.frames import trim_edges


def stem_table(files: DataFrame, path: str = "path") -> DataFrame:
    """stem, path: the last file in (name, folder) order wins for a repeated stem."""
    name = F.substring_index(path, "/", -1)
    return files.groupBy(A.path_stem(F.col(path)).alias("stem")).agg(F.max_by(path, F.struct(name, F.col(path))).alias("path"))


def pair_by_stem(wav: DataFrame, txt: DataFrame) -> DataFrame:
    """stem, wav_path, txt_path: one row per stem found on both sides."""
    return (
        stem_table(wav).withColumnRenamed("path", "wav_path").join(stem_table(txt).withColumnRenamed("path", "txt_path"), "stem")
    )


def prune(df: DataFrame, flagged: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not flagged; the flagged keys are broadcast when few, else salted against frequent keys."""
    return lookup_join(df, flagged.select(*keys).distinct(), keys, "left_anti")


def symbol_lookup(symbols: Column, kind: str) -> Column:
    return S.lookup_ids(symbols, kind)


def shared_ids(train: DataFrame, valid: DataFrame, ids: list[str]) -> DataFrame:
    """Ids in both splits; must be empty."""
    return train.select(*ids).join(valid.select(*ids), ids, "left_semi")


def assert_disjoint(train: DataFrame, valid: DataFrame, ids: list[str]) -> None:
    both = shared_ids(train, valid, ids).limit(1).collect()
    if both:
        raise ValueError(f"the splits share {both[0]}")


def repeat_to_resolution(samples: DataFrame, frames: DataFrame, key: str, threshold: int | None = None) -> DataFrame:
    """samples(key, pos, n, n_frames, …) with the frame of each sample: frames(key, frame, feat).

    Every frame is held ``n div n_frames`` samples and the tail has zeros, as has all of a signal with fewer samples than frames. ``n`` and ``n_frames`` come with the rows, so
    the join is an equal join on (key, frame) and a long signal is spread over its frames. With a ``threshold`` the
    silent ends (by the column ``code``) are trimmed afterwards.
    """
    x = samples.withColumn("frame", F.expr("CASE WHEN n_frames > 0 AND n >= n_frames THEN pos div (n div n_frames) END"))
    zero = F.transform("_any", lambda v: F.lit(0.0))
    width = frames.agg(F.first("feat").alias("_any"))
    out = with_row(x.join(frames.select(key, "frame", "feat"), [key, "frame"], "left"), width)
    out = out.withColumn("feat", F.coalesce("feat", zero)).drop("_any", "frame")
    return out if threshold is None else trim_edges(out, [key], threshold)


def concat_parts(*parts: DataFrame) -> DataFrame:
    """Append parts in order, with their ordinal."""
    out = None
    for n, p in enumerate(parts):
        p = p.withColumn("part", F.lit(n))
        out = p if out is None else out.unionByName(p)
    return out


def shared_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def exclude_invalids(df: DataFrame, invalid: DataFrame, keys: list[str]) -> DataFrame:
    return prune(df, invalid, keys)


def charset_union(*texts: DataFrame) -> DataFrame:
    """Distinct characters of several one-column text tables."""
    out = None
    for t in texts:
        one = t.select(F.explode(F.array_distinct(F.split(F.col(t.columns[0]), ""))).alias("symbol")).distinct()
        out = one if out is None else out.union(one)
    return out.where("symbol <> ''").distinct()
