"""Row and group filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqprep.functions import symbols as S
from seqprep.operators.blocks import BLOCK, lookup_join, spread, with_totals
from seqprep.scratch import written


def min_length_filter(df: DataFrame, keys: list[str], length: int, pos: str = "pos") -> DataFrame:
    """Keep sequences of at least ``length + 1`` rows; ``pos`` is dense per key."""
    return with_totals(df, keys, {"_len": F.count("*")}, pos).where(F.col("_len") >= length + 1).drop("_len")


def complete_phones_filter(words: DataFrame, key: str, phones: str = "phones") -> DataFrame:
    """Keys all of whose words have phones."""
    return words.groupBy(key).agg(F.bool_and(F.col(phones).isNotNull()).alias("_ok")).where("_ok").select(key)


def alignment_case_filter(records: DataFrame) -> DataFrame:
    """Words of alignment records paired with the words of their cleaned transcript.

    records(id, words array<struct<word, case, alignedWord, phones>>, clean string). A word not found in the transcript
    is dropped and moves later words one place back; a word not found in the audio is dropped but keeps its place.
    A place is the word's index among those found in the transcript, so a record is paired inside its row; only records
    whose id comes more than once share their places and go through a window. A null id pairs with nothing.
    """
    records = records.where("id is not null")
    repeated = records.groupBy("id").agg(F.count("*").alias("_n")).where("_n > 1").select("id")
    shared = not repeated.isEmpty()
    found = F.filter("words", lambda w: F.coalesce(w["case"] != "not-found-in-transcript", F.lit(True)))
    pairs = (lookup_join(records, repeated, ["id"], "left_anti") if shared else records).select(
        "id", F.posexplode(F.arrays_zip(found.alias("w"), F.split("clean", " ").alias("t"))).alias("place", "p")
    ).select("id", "place", F.col("p.w").alias("w"), F.col("p.t").alias("transcript_word"))
    pairs = pairs.where("w.case <> 'not-found-in-audio' and transcript_word is not null")
    if shared:
        pairs = pairs.unionByName(_shared_places(lookup_join(records, repeated, ["id"], "left_semi")))
    return pairs.select(
        "id", "place", F.col("w.word").alias("word"), "transcript_word",
        F.transform("w.phones", lambda p: F.substring_index(p["phone"], "_", 1)).alias("phones"),
    )


def _shared_places(records: DataFrame) -> DataFrame:
    """(id, place, w, transcript_word) where all records of an id count their places together."""
    w = Window.partitionBy("id").orderBy("idx")
    words = records.select("id", F.posexplode("words").alias("idx", "w"))
    counted = F.when(F.col("w.case") == "not-found-in-transcript", 0).otherwise(1)
    placed = words.withColumn("place", (F.sum(counted).over(w) - 1).cast("int")).where(
        ~F.col("w.case").isin("not-found-in-transcript", "not-found-in-audio")
    )
    transcript = records.select("id", F.posexplode(F.split("clean", " ")).alias("place", "transcript_word"))
    return placed.join(transcript, ["id", "place"]).select("id", "place", "w", "transcript_word")


def speaker_filter(manifest: DataFrame, speaker: object, column: str = "speaker_id") -> DataFrame:
    return manifest.where(F.col(column) == speaker).drop(column)


def score_filters(pieces: DataFrame, signatures: DataFrame) -> DataFrame:
    """Major or minor pieces whose time signatures share one denominator; ``4/4`` when a piece has none."""
    sig = signatures.groupBy("piece").agg(
        F.min("time_sig").alias("time_sig"),
        F.min(F.substring_index("time_sig", "/", -1)).alias("_low"),
        F.max(F.substring_index("time_sig", "/", -1)).alias("_high"),
    )
    x = pieces.where(F.col("mode").isin("major", "minor")).join(sig, "piece", "left")
    return x.where(F.col("_low").isNull() | (F.col("_low") == F.col("_high"))).select(
        *pieces.columns, F.coalesce("time_sig", F.lit("4/4")).alias("time_sig")
    )


def equal_voice_filter(notes: DataFrame, voices: int, pos: str = "idx", block: int = BLOCK) -> DataFrame:
    """Pieces with exactly ``voices`` voices; the join back goes by (piece, voice, block), not by piece alone."""
    per_voice = notes.groupBy("piece", "voice").agg(F.max(pos).alias("_last"))
    kept = per_voice.groupBy("piece").agg(F.count("*").alias("_n")).where(F.col("_n") == voices).select("piece")
    kept_voices = per_voice.join(kept, "piece", "left_semi").withColumn("_last", F.expr(f"_last div {block}"))
    blocks = spread(kept_voices, "_last").drop("_last")
    return notes.withColumn("_blk", F.expr(f"{pos} div {block}")).join(blocks, ["piece", "voice", "_blk"], "left_semi").drop("_blk")


def chord_only_part_filter(elements: DataFrame) -> DataFrame:
    """Drop parts in which every element is a chord: element(piece, part, idx, is_chord)."""
    kept = {"_any": F.bool_or(~F.col("is_chord"))}
    return with_totals(elements, ["piece", "part"], kept, "idx").where("_any").drop("_any")


def keep_symbol(symbols: Column, kind: str = "char") -> Column:
    return S.keep_symbols(symbols, kind)


def lone_point_filter(points: DataFrame, keys: list[str]) -> DataFrame:
    """Where a stroke splits into several segments, drop one-point segments: points(keys, segment, …)."""
    # read for the count of segments, for the lone ones and by the join: written once
    size = written(points.groupBy(*keys, "segment").agg(F.count("*").alias("_n")), "segments")
    several = size.groupBy(*keys).agg((F.count("*") > 1).alias("_several"))
    lone = size.where("_n = 1").join(several.where("_several"), keys, "left_semi").select(*keys, "segment")
    return lookup_join(points, lone, [*keys, "segment"], "left_anti")
