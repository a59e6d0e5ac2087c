"""Queries that write files derived from a given table and read them with the readers."""

from __future__ import annotations
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqprep.operators.score import nearest_timing_symbol
from seqprep.plans import views as V
from seqprep.plans.registry import query
from seqprep.scratch import scratch_path
from seqprep.sources import accessors as AC
from seqprep.sources import readers as R


SESSIONS_PER_FILE = 50_000


def place(spark, label: str) -> str:
    return scratch_path(spark, label)


def file_per_key(rows: DataFrame, key: str):
    """A writer of one file per key: the keys are dealt to all cores, and every task moves its own files into place."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(4 * cores, key).write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy(key)


def file_per_row(spark, folder: str, label: str, value) -> str:
    """One text file per supplier."""
    path = place(spark, label)
    file_per_key(V.table(spark, folder, "supplier").select("s_suppkey", value.alias("value")), "s_suppkey").text(path)
    return path


@query("source_media", "SELECT source, sum(length(doc_id::VARCHAR) + 1)::BIGINT AS bytes, true AS numbered FROM documents GROUP BY source")
def media(spark, folder):
    """Files of two formats; only those with the wanted extension count, numbered without gaps in path order."""
    path = place(spark, "media")
    lines = V.table(spark, folder, "documents").select("source", F.col("doc_id").cast("string").alias("value"))
    lines.write.partitionBy("source").text(path)
    lines.write.mode("append").partitionBy("source").json(path)
    x = R.list_media(spark, path, [".txt"]).withColumn("source", F.regexp_extract("path", "source=([^/]*)/", 1))
    numbered = F.max("index") - F.min("index") + 1 == F.count("*")
    return x.groupBy("source").agg(F.sum("length").alias("bytes"), numbered.alias("numbered"))


@query("source_read_alignment", """
SELECT s_suppkey::VARCHAR || ' ' || s_name AS transcript, (i - 1)::INT AS idx, w[i] AS word, CASE WHEN i % 2 = 1 THEN 'success' ELSE 'not-found-in-audio' END AS "case",
       left(w[i], 1) || '_B' AS phone
FROM (SELECT *, unnest(generate_series(1, len(w))) AS i FROM (SELECT s_suppkey, s_name, [s_suppkey::VARCHAR, s_name] AS w FROM supplier))""")
def alignment(spark, folder):
    path = place(spark, "alignment")
    words = F.array(F.col("s_suppkey").cast("string"), F.col("s_name"))
    entry = lambda w, i: F.struct(
        w.alias("word"), F.when(i % 2 == 0, "success").otherwise("not-found-in-audio").alias("case"), w.alias("alignedWord"),
        F.array(F.struct(F.concat(F.substring(w, 1, 1), F.lit("_B")).alias("phone"))).alias("phones"))
    docs = V.table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("file"), F.array_join(words, " ").alias("transcript"), F.transform(words, entry).alias("words"))
    file_per_key(docs, "file").json(path)
    x = R.read_alignment(spark, path).select("transcript", F.posexplode("words").alias("idx", "w"))
    return x.select("transcript", "idx", "w.word", "w.case", F.col("w.phones")[0]["phone"].alias("phone"))


def sessions(spark, folder: str) -> dict[str, DataFrame]:
    """Orders as pen sessions: line items with odd and even numbers are the points of two strokes."""
    path = place(spark, "strokes")
    items = V.table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_linenumber")).alias("n"))

    def stroke(odd: int):
        own = F.filter("n", lambda n: n % 2 == odd)
        point = lambda n: F.struct(F.col("l_orderkey").cast("int").alias("_x"), n.cast("int").alias("_y"))
        return F.struct(F.transform(own, point).alias("Point"))

    strokes = F.filter(F.array(stroke(1), stroke(0)), lambda s: F.size(s["Point"]) > 0)
    # the files hold escaped texts, so "&" comes as an entity of its own
    text = F.array(*[F.struct(t.alias("_text")) for t in (F.concat(F.lit("<order> &amp; "), F.col("l_orderkey").cast("string")), F.lit("end"))])
    # a file is read by one task, so it holds a bounded number of sessions
    items.select(F.struct(text.alias("TextLine")).alias("Transcription"), F.struct(strokes.alias("Stroke")).alias("StrokeSet")).write.format("xml").option(
        "rowTag", "WhiteboardCaptureSession").option("rootTag", "Sessions").option("maxRecordsPerFile", SESSIONS_PER_FILE).save(path)
    return R.read_strokes_xml(spark, path)


@query("source_strokes_xml", """
SELECT l_orderkey::INT AS x, l_linenumber::INT AS y, (s - min(s) OVER (PARTITION BY l_orderkey))::INT AS stroke, (r - 1)::BIGINT AS idx, (r = n)::INT AS eos FROM (
  SELECT l_orderkey, l_linenumber, 1 - l_linenumber % 2 AS s, row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 2 ORDER BY l_linenumber) AS r,
         count(*) OVER (PARTITION BY l_orderkey, l_linenumber % 2) AS n FROM lineitem)""")
def strokes_xml(spark, folder):
    return sessions(spark, folder)["points"].select("x", "y", "stroke", "idx", "eos")


@query("source_strokes_text", """
SELECT line::INT AS line, CASE WHEN line = 0 THEN '<order> & ' || l_orderkey ELSE 'end' END AS text FROM (SELECT DISTINCT l_orderkey FROM lineitem), (SELECT unnest([0, 1]) AS line)""")
def strokes_text(spark, folder):
    return sessions(spark, folder)["lines"].select("line", "text")


@query("source_read_word_counts", """
SELECT DISTINCT w AS word FROM (SELECT unnest(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS w FROM documents)""")
def read_word_counts(spark, folder):
    path = place(spark, "word-counts")
    words = V.documents(spark, folder, "text").select(F.explode(F.regexp_extract_all("text", F.lit("[^\\x20\\x09-\\x0D]+"), 0)).alias("word"))
    words.groupBy("word").count().select(F.concat_ws("\t", "word", F.col("count").cast("string"))).write.text(path)
    return R.read_word_counts(spark, path)


@query("source_file_fingerprint", "SELECT s_suppkey::BIGINT AS file, md5(s_name || ' ' || s_acctbal::VARCHAR || chr(10)) AS md5 FROM supplier")
def file_fingerprint(spark, folder):
    path = file_per_row(spark, folder, "fingerprint", F.concat_ws(" ", "s_name", F.col("s_acctbal").cast("string")))
    x = R.file_fingerprint(spark, path)
    return x.select(F.regexp_extract("path", "s_suppkey=([0-9]+)", 1).cast("long").alias("file"), "md5")


@query("source_accessor", """
SELECT line, count(*)::BIGINT AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY line""")
def accessor(spark, folder):
    """A user function from a text to the sequence of its lines."""
    read = lambda text: ({"line": line} for line in text.split("\n"))
    docs = V.documents(spark, folder, "text").where("text is not null")
    return AC.sequence_accessor(docs, read, "line string", "text").groupBy("line").agg(F.count("*").alias("n"))


@query("source_pause_transcript", """
SELECT 'HH AY ' || s_suppkey AS phones, s_name AS text, list_transform(s, lambda t: CASE list_position([abs(t), abs(t - 0.01), abs(t - 0.02), abs(t - 0.08), abs(t - 0.25)],
         list_min([abs(t), abs(t - 0.01), abs(t - 0.02), abs(t - 0.08), abs(t - 0.25)])) WHEN 1 THEN ' ' WHEN 2 THEN '1' WHEN 3 THEN '2' WHEN 4 THEN '3' ELSE '4' END).list_aggregate('string_agg', '|') AS symbols
FROM (SELECT *, [('0.' || lpad((s_suppkey % 100)::VARCHAR, 2, '0'))::DOUBLE, ('0.0' || s_suppkey % 10)::DOUBLE, 0.5::DOUBLE] AS s FROM supplier)""")
def pause_transcript(spark, folder):
    key = F.col("s_suppkey").cast("string")
    seconds = F.concat(F.lit("0."), F.lpad((F.col("s_suppkey") % 100).cast("string"), 2, "0"), F.lit(" 0.0"), (F.col("s_suppkey") % 10).cast("string"), F.lit(" 0.5"))
    lines = F.concat(F.lit("HH AY "), key, F.lit("\n# "), F.col("s_name"), F.lit("\n## "), seconds)
    x = R.read_pause_transcripts(spark, file_per_row(spark, folder, "pauses", lines))
    return x.select("phones", "text", F.array_join(F.transform("seconds", nearest_timing_symbol), "|").alias("symbols"))
