"""Readers with declared schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqprep.functions import arrays as A
from seqprep.operators.blocks import position

MANIFEST = "audio string, mel string, steps int, text string, speaker_id int"
METADATA = "id string, raw string, text string"
ALIGNMENT = (
    "transcript string, words array<struct<word string, case string, alignedWord string, phones array<struct<phone string>>>>"
)

# Phone symbols of the pronunciation dictionary; vowels also come with a stress digit 0, 1 or 2.
VOWEL_PHONES = ["AA", "AE", "AH", "AO", "AW", "AY", "EH", "ER", "EY", "IH", "IY", "OW", "OY", "UH", "UW"]
CONSONANT_PHONES = [
    "B", "CH", "D", "DH", "F", "G", "HH", "JH", "K", "L", "M", "N", "NG", "P", "R", "S", "SH", "T", "TH", "V", "W", "Y",
    "Z", "ZH",
]
VALID_PHONES = [v + s for v in VOWEL_PHONES for s in ("", "0", "1", "2")] + CONSONANT_PHONES


def text_lines(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line, value): the stripped lines of a text column."""
    return texts.select(key, F.posexplode(F.split(text, "\n")).alias("line", "value")).withColumn("value", _strip(F.col("value")))


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, "^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$", "")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumn("value", _strip(F.col("value")))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value): lines of one file in file order; ids grow along the file but have gaps between splits."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), "value")


def read_manifest(spark: SparkSession, path: str, schema: str = MANIFEST) -> DataFrame:
    """Pipe-separated columns without quoting; a missing fifth column gives a NULL speaker."""
    return spark.read.schema(schema).option("sep", "|").option("quote", "").option("escape", "\u0000").option("mode", "PERMISSIVE").csv(path)


def list_media(spark: SparkSession, folder: str, extensions: list[str]) -> DataFrame:
    """(index from 1, path, length): files of the allowed extensions in path order; contents are not read."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.{" + ",".join(e.lstrip(".") for e in extensions) + "}").load(folder).select("path", "length")
    )
    return position(files, [], ["path"], "_r").select((F.col("_r") + 1).alias("index"), "path", "length")


def read_alignment(spark: SparkSession, path: str) -> DataFrame:
    """(id, transcript, words): one nested document per file, id is the file stem."""
    docs = spark.read.schema(ALIGNMENT).option("multiLine", True).json(path)
    return docs.select(A.path_stem(F.input_file_name()).alias("id"), "transcript", "words")


def aligned_words(records: DataFrame) -> DataFrame:
    return records.select("id", F.posexplode("words").alias("idx", "w")).select("id", "idx", "w.*")


def parse_lexicon(lines: DataFrame, keep_ambiguous: bool = True) -> DataFrame:
    """lines(line_no, value) to lexicon(word, prons array<array<string>>), pronunciations in line order.

    ``WORD(2)  P1 P2`` is another pronunciation of WORD; entries with an unknown symbol are dropped.
    """
    parts = F.split("value", "  ")
    x = lines.where(F.col("value").rlike("^[A-Z']")).select(
        "line_no", F.regexp_replace(parts[0], "\\([0-9]+\\)", "").alias("word"), F.split(F.trim(F.get(parts, F.lit(1))), " ").alias("pron")
    )
    valid = F.array(*map(F.lit, VALID_PHONES))
    x = x.where(F.forall("pron", lambda p: F.array_contains(valid, p)))
    out = x.groupBy("word").agg(F.sort_array(F.collect_list(F.struct("line_no", "pron"))).alias("_p")).select(
        "word", F.col("_p.pron").alias("prons")
    )
    return out if keep_ambiguous else out.where(F.size("prons") == 1)


def read_lexicon(spark: SparkSession, path: str, keep_ambiguous: bool = True) -> DataFrame:
    return parse_lexicon(numbered_lines(spark, path), keep_ambiguous)


def read_lexicon_json(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object per line, ``{"word": …, "prons": [[…]]}``."""
    return spark.read.schema("word string, prons array<array<string>>").json(path)


STROKES = (
    "Transcription struct<TextLine: array<struct<_text: string>>>, "
    "StrokeSet struct<Stroke: array<struct<Point: array<struct<_x: int, _y: int>>>>>"
)


def read_strokes_xml(spark: SparkSession, path: str, row_tag: str = "WhiteboardCaptureSession") -> dict[str, DataFrame]:
    """``lines(doc, line, text)`` and ``points(doc, stroke, idx, x, y, eos)``; untranscribed documents are skipped."""
    docs = spark.read.format("xml").option("rowTag", row_tag).schema(STROKES).load(path)
    docs = docs.select(A.path_stem(F.input_file_name()).alias("doc"), "*").where(F.col("Transcription").isNotNull())
    lines = docs.select("doc", F.posexplode("Transcription.TextLine").alias("line", "t")).select(
        "doc", "line", unescape(F.col("t._text")).alias("text")
    )
    points = docs.select("doc", F.posexplode("StrokeSet.Stroke").alias("stroke", "s")).select(
        "doc", "stroke", (F.size("s.Point") - 1).alias("_last"), F.posexplode("s.Point").alias("idx", "p")
    ).select(
        "doc", "stroke", F.col("idx").cast("long").alias("idx"), F.col("p._x").alias("x"), F.col("p._y").alias("y"),
        (F.col("idx") == F.col("_last")).cast("int").alias("eos"),
    )
    return {"lines": lines, "points": points}


def unescape(text: Column) -> Column:
    for entity, char in (("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def read_word_counts(spark: SparkSession, path: str) -> DataFrame:
    """word: tab-separated list, words in descending order."""
    counts = spark.read.schema("word string, n bigint").option("sep", "\t").option("quote", "").csv(path)
    return counts.select("word").orderBy(F.desc("word"))


def file_fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """(path, md5) of file contents."""
    return spark.read.format("binaryFile").load(path).select("path", F.md5("content").alias("md5"))


def read_pause_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(id, phones, text, seconds): one file each with the phones, ``# `` and the text, and the pauses after a lead of three characters.

    A missing line gives null; a pause that is no number is a null in ``seconds``.
    """
    lines = F.split("value", "\\r?\\n")
    line = lambda i: F.get(lines, F.lit(i))
    seconds = F.transform(F.split(_strip(F.substring(line(2), F.lit(4), F.length(line(2)))), " +"), lambda s: s.try_cast("double"))
    return spark.read.text(path, wholetext=True).select(
        A.path_stem(F.input_file_name()).alias("id"), _strip(line(0)).alias("phones"),
        _strip(F.substring(line(1), F.lit(3), F.length(line(1)))).alias("text"), seconds.alias("seconds"),
    )


def make_sinewaves(
    spark: SparkSession, n_timesteps: int, n_waves: int, base_freq: float = 3.0, offset: bool = True, use_cos: bool = False,
    harmonic: bool = False, multipliers: tuple = (1.7, 0.62), square: bool = False, thresh: float = 0.0,
) -> DataFrame:
    """wave(wave, pos, x): waves offset in phase, with harmonics or squared."""
    two_pi = 2 * 3.141592653589793
    t = base_freq * F.col("pos") / two_pi
    phase = base_freq * F.col("wave") / two_pi if offset else F.lit(0.0)
    wave = F.cos if use_cos else F.sin
    x = wave(t + phase)
    for m in multipliers if harmonic else ():
        x = x + wave(m * t + phase)
    if square:
        x = F.when(x > thresh, 1.0).otherwise(0.0)
    grid = spark.range(n_timesteps).withColumnRenamed("id", "pos").withColumn("wave", F.explode(F.sequence(F.lit(0), F.lit(n_waves - 1))))
    return grid.select("wave", "pos", x.alias("x"))
