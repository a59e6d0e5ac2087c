"""Queries on texts: cleaners, numbers, symbol ids and vocabulary."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqprep.functions import arrays as AR
from seqprep.functions import symbols as S
from seqprep.functions import text as T
from seqprep.operators import aggregates as AG
from seqprep.operators import filters as FL
from seqprep.plans import sql as Q
from seqprep.plans import views as V
from seqprep.plans.registry import query
from seqprep.sources import readers as R
from seqprep.sources import writers as W

DOC = "SELECT doc_id, text AS t FROM documents"
OUT = "SELECT doc_id, t AS clean FROM done"
# Prices as text, so that every money and ordinal form occurs.
PRICE = (
    "SELECT l_orderkey, l_linenumber, 'paid $' || (CASE WHEN l_linenumber % 2 = 0 THEN floor(l_extendedprice)::BIGINT::VARCHAR || '.' || "
    "lpad((l_orderkey % 100)::VARCHAR, 2, '0') ELSE '0.0' || (l_orderkey % 3)::VARCHAR END) || ' and £' || l_quantity::BIGINT::VARCHAR || ',000 on the ' || "
    "l_linenumber::VARCHAR || 'th' AS t FROM lineitem"
)


def prices(spark, folder):
    li = V.table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    money = F.when(
        F.col("l_linenumber") % 2 == 0,
        F.concat(F.floor("l_extendedprice").cast("string"), F.lit("."), F.lpad((F.col("l_orderkey") % 100).cast("string"), 2, "0")),
    ).otherwise(F.concat(F.lit("0.0"), (F.col("l_orderkey") % 3).cast("string")))
    t = F.concat(F.lit("paid $"), money, F.lit(" and £"), F.col("l_quantity").cast("long").cast("string"), F.lit(",000 on the "),
                 F.col("l_linenumber").cast("string"), F.lit("th"))
    return V.balanced(li).select("l_orderkey", "l_linenumber", t.alias("t"))


def cleaner(name, change, steps):
    @query(name, Q.chain(DOC, steps, OUT))
    def run(spark, folder):
        return V.documents(spark, folder, "text").select("doc_id", change(F.col("text")).alias("clean"))


def priced(name, change, steps):
    @query(name, Q.chain(PRICE, steps, "SELECT l_orderkey, l_linenumber, t AS clean, count(*)::BIGINT AS n FROM done GROUP BY ALL"))
    def run(spark, folder):
        x = prices(spark, folder).select("l_orderkey", "l_linenumber", change(F.col("t")).alias("clean"))
        return x.groupBy("l_orderkey", "l_linenumber", "clean").agg(F.count("*").alias("n"))


cleaner("text_convert_to_ascii", T.convert_to_ascii, Q.ASCII)
cleaner("text_lowercase", T.lowercase, Q.LOWER)
cleaner("text_collapse_whitespace", T.collapse_whitespace, Q.SPACE)
cleaner("text_expand_abbreviations", T.expand_abbreviations, Q.ABBREVIATIONS)
cleaner("text_collapse_spurious", T.collapse_spurious, Q.SPURIOUS)
cleaner("text_remove_number_commas", T.remove_number_commas, Q.COMMAS)
cleaner("text_expand_decimal_point", T.expand_decimal_point, Q.POINT)
cleaner("text_normalize_numbers", T.normalize_numbers, Q.NUMBERS)
cleaner("text_basic_cleaners", T.basic_cleaners, Q.LOWER + Q.SPACE)
cleaner("text_transliteration_cleaners", T.transliteration_cleaners, Q.ASCII + Q.LOWER + Q.SPACE)
cleaner("text_english_cleaners", T.english_cleaners, Q.ENGLISH)
cleaner("text_english_minimal_cleaners", T.english_minimal_cleaners, Q.MINIMAL)
cleaner("text_phone_cleaners", lambda c: T.clean(c, ["english_phone_cleaners", "english_phone_pause_cleaners"]), [])
cleaner("text_clean_by_name", lambda c: T.clean(c, ["convert_to_ascii", "expand_numbers", "collapse_whitespace"]),
        Q.ASCII + Q.NUMBERS + Q.SPACE)
cleaner("text_strip_punctuation_for_lookup", T.strip_punctuation_for_lookup, ["translate(t, ',;\"[].!?', '')"])
cleaner("text_interior_period_to_comma", T.interior_period_to_comma,
        ["replace(left(t, greatest(len(t) - 1, 0)), '.', ',') || right(t, 1)"])
cleaner("text_quote_and_dash_fix", T.quote_and_dash_fix,
        ["regexp_replace(translate(t, '‘’-', ''''' '), '[^\\x00-\\x7F]', '?', 'g')"])
priced("text_expand_pounds", T.expand_pounds, Q.POUNDS)
priced("text_expand_dollars", T.expand_dollars, Q.DOLLARS)
priced("text_normalize_prices", T.normalize_numbers, Q.NUMBERS)


@query("text_number_to_words", f"""
SELECT n, words, count(*)::BIGINT AS uses FROM (
  SELECT n, {Q.number_words('n')} AS words
  FROM (SELECT CASE WHEN l_linenumber % 2 = 0 THEN l_orderkey * 977 + l_partkey ELSE l_suppkey * l_linenumber END AS n FROM lineitem))
GROUP BY ALL""")
def number_to_words(spark, folder):
    li = V.table(spark, folder, "lineitem")
    n = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_orderkey") * 977 + F.col("l_partkey")).otherwise(F.col("l_suppkey") * F.col("l_linenumber"))
    # repeated numbers are spelled once
    return li.select(n.alias("n")).groupBy("n").agg(F.count("*").alias("uses")).select("n", T.number_to_words(F.col("n")).alias("words"), "uses")


@query("text_register_cleaner", Q.chain(DOC, ["replace(replace(t, '\n', ' / '), 'a', 'A')"], OUT))
def register_cleaner(spark, folder):
    marked = {"marked_lines": lambda c: F.replace(F.replace(c, F.lit("\n"), F.lit(" / ")), F.lit("a"), F.lit("A"))}
    return V.documents(spark, folder, "text").select("doc_id", T.clean(F.col("text"), ["marked_lines"], marked).alias("clean"))


@query("text_char_ids", Q.chain(DOC, Q.ENGLISH, f"SELECT doc_id, {Q.csv(Q.char_ids('t') + ' || [1]')} AS ids, len({Q.char_ids('t')}) + 1 AS n FROM done"))
def char_ids(spark, folder):
    ids = V.documents(spark, folder, "text").select("doc_id", S.text_to_ids(T.english_cleaners(F.col("text"))).alias("_ids"))
    return ids.select("doc_id", F.array_join(F.col("_ids").cast("array<string>"), ",").alias("ids"), F.size("_ids").cast("long").alias("n"))


@query("text_ids_roundtrip", Q.chain(DOC, Q.LOWER, "SELECT doc_id, regexp_replace(t, '[^a-z!'',\\-.:? ]', '', 'g') || '~' AS back FROM done"))
def ids_roundtrip(spark, folder):
    ids = S.text_to_ids(T.lowercase(F.col("text")))
    return V.documents(spark, folder, "text").select("doc_id", S.ids_to_text(ids).alias("back"))


# words as phone words: every letter stands for the phone of the same name or for "aa"
PHONE_WORD = "regexp_replace(regexp_replace(lower(t), '[^a-z .,!?:;1-4]', '', 'g'), '([a-z])', '@\\1', 'g')"


def phone_words(c):
    kept = F.regexp_replace(F.lower(c), "[^a-z .,!?:;1-4]", "")
    return F.regexp_replace(kept, "([a-z])", "@$1")


@query("text_phones_to_ids", Q.chain(DOC, [PHONE_WORD], f"SELECT doc_id, {Q.csv(Q.ids_of(Q.phone_symbols('t'), 'phone') + ' || [1]')} AS ids FROM done"))
def phones_to_ids(spark, folder):
    ids = S.phones_to_ids(phone_words(F.col("text")))
    return V.documents(spark, folder, "text").select("doc_id", F.array_join(ids.cast("array<string>"), ",").alias("ids"))


PAUSE_SYMBOLS = (
    "flatten(list_transform(string_split(t, ' '), lambda w: flatten(list_transform(string_split(trim(w), '@')[2:], lambda p: "
    "[regexp_replace(p, '[1-4]', '', 'g')] || (CASE WHEN instr(p, '1') > 0 THEN ['1'] WHEN instr(p, '2') > 0 THEN ['2'] "
    "WHEN instr(p, '3') > 0 THEN ['3'] WHEN instr(p, '4') > 0 THEN ['4'] ELSE [] END))) || "
    "(CASE WHEN regexp_matches(w, '[1-4]') THEN [] ELSE [' '] END)))"
)


@query("text_pause_phones_to_ids", Q.chain(DOC, [PHONE_WORD], f"SELECT doc_id, {Q.csv(Q.ids_of(PAUSE_SYMBOLS, 'pause') + ' || [1]')} AS ids FROM done"))
def pause_phones_to_ids(spark, folder):
    ids = S.pause_phones_to_ids(phone_words(F.col("text")))
    return V.documents(spark, folder, "text").select("doc_id", F.array_join(ids.cast("array<string>"), ",").alias("ids"))


@query("text_braced_phones", Q.chain(
    "SELECT doc_id, lower(replace(replace(text, '{', ''), '}', '')) AS t, source FROM documents", [],
    f"""SELECT doc_id, {Q.csv(Q.char_ids('a') + ' || [17, 6, 30] || ' + Q.char_ids('b') + ' || [30] || [1]')} AS ids, (len({Q.char_ids('t')}) + 5)::BIGINT AS n
    FROM (SELECT *, substr(t, 1, instr(t, ' ')) AS a, substr(t, instr(t, ' ') + 1) AS b FROM done)"""))
def braced_phones(spark, folder):
    t = F.lower(F.translate("text", "{}", ""))
    first = F.instr(t, " ")
    pairs = S.braced_phones(F.concat(F.substring(t, F.lit(1), first), F.lit("{HH AW1 S}"), F.substring(t, first + 1, F.length(t)), F.lit("{S}")))
    x = V.documents(spark, folder, "text").select("doc_id", pairs.alias("p"))
    return x.select("doc_id", F.array_join(F.col("p.id").cast("array<string>"), ",").alias("ids"), F.size("p").cast("long").alias("n"))


@query("text_strip_stress", """
SELECT token, lower('@' || CASE WHEN regexp_matches(token, '[012]') THEN left(token, len(token) - 1) ELSE token END) AS phone, count(*)::BIGINT AS n
FROM (SELECT unnest(string_split(regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g'), ' ')) AS token FROM documents) WHERE token <> '' GROUP BY ALL""")
def strip_stress(spark, folder):
    tokens = F.split(F.regexp_replace("text", "[^A-Za-z0-9]+", " "), " ")
    x = V.documents(spark, folder, "text").select(F.explode(tokens).alias("token")).where("token <> ''")
    return x.groupBy("token").agg(F.count("*").alias("n")).select("token", S.strip_stress(F.col("token")).alias("phone"), "n")


def _marked_sql():
    out = "z[1]"
    for m in "!,:?":
        out = f"CASE WHEN left(z[2], 1) = '{m}' THEN '{m}' || {out} WHEN right(z[2], 1) = '{m}' THEN {out} || '{m}' ELSE {out} END"
    return out


@query("text_reinsert_punctuation", f"""
SELECT doc_id, array_to_string(list_transform(list_zip(string_split(regexp_replace(text, '[!,:?]', '', 'g'), ' '), string_split(text, ' ')), lambda z: {_marked_sql()}), ' ') AS marked FROM documents""")
def reinsert_punctuation(spark, folder):
    x = V.documents(spark, folder, "text")
    return x.select("doc_id", T.reinsert_punctuation(F.regexp_replace("text", "[!,:?]", ""), F.col("text")).alias("marked"))


@query("text_char_code", f"""
SELECT c AS symbol, (instr({Q.lit(S.PRINTABLE)}, c) - 1)::INT AS code, count(*)::BIGINT AS n
FROM (SELECT unnest(string_split(text, '')) AS c FROM documents) WHERE c <> '' GROUP BY ALL""")
def char_code(spark, folder):
    chars = V.documents(spark, folder, "text").select(F.explode(F.split("text", "")).alias("symbol")).where("symbol <> ''")
    return chars.groupBy("symbol").agg(F.count("*").alias("n")).select("symbol", S.char_code(F.col("symbol")).alias("code"), "n")


@query("filter_keep_symbol", f"""
SELECT doc_id, array_to_string(list_filter(string_split(lower(text), ''), lambda c: c <> '' AND instr({Q.lit(S.CHARS)}, c) > 0), '') AS kept FROM documents""")
def keep_symbol(spark, folder):
    kept = FL.keep_symbol(F.split(F.lower("text"), ""), "char")
    return V.documents(spark, folder, "text").select("doc_id", F.array_join(kept, "").alias("kept"))


@query("agg_charset_vocabulary", """
SELECT c AS symbol, row_number() OVER (ORDER BY encode(c))::INT AS id FROM (SELECT DISTINCT unnest(string_split(text, '')) AS c FROM documents) WHERE c <> ''
UNION ALL SELECT '<NULL>', 0""")
def charset_vocabulary(spark, folder):
    return AG.charset_vocabulary(V.documents(spark, folder, "text"))


@query("agg_max_lengths", """
SELECT max(len(string_split(text, ' ')))::INT AS words, max(len(string_split(text, '\n')))::INT AS lines FROM documents""")
def max_lengths(spark, folder):
    return AG.max_lengths(V.documents(spark, folder, "text"), words=F.split("text", " "), lines=F.split("text", "\n"))


@query("agg_line_count", "SELECT count(*)::BIGINT AS n_lines FROM (SELECT unnest(string_split(text, '\n')) AS v FROM documents)")
def line_count(spark, folder):
    return AG.line_count(R.text_lines(V.documents(spark, folder, "text"), "doc_id"))


@query("agg_vocabulary_size", """
SELECT source, cleaner, size, count(*)::BIGINT AS n FROM (SELECT source, CASE WHEN lang = 'en' THEN 'english_cleaners' WHEN lang = 'de' THEN 'english_phone_cleaners'
 ELSE 'english_phone_pause_cleaners' END AS cleaner, CASE WHEN lang = 'en' THEN 36 WHEN lang = 'de' THEN 49 ELSE 46 END::BIGINT AS size FROM documents) GROUP BY ALL""")
def vocabulary_size(spark, folder):
    names = ["english_cleaners", "english_phone_cleaners", "english_phone_pause_cleaners"]
    sizes = AG.vocabulary_size(spark, names)
    chosen = F.when(F.col("lang") == "en", names[0]).when(F.col("lang") == "de", names[1]).otherwise(names[2])
    x = V.documents(spark, folder, "source", "lang").groupBy("source", chosen.alias("cleaner")).agg(F.count("*").alias("n"))
    return x.join(F.broadcast(sizes), "cleaner")


@query("source_text_lines", """
SELECT doc_id, (i - 1)::INT AS line, regexp_replace(l[i], '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g') AS value
FROM (SELECT doc_id, l, unnest(generate_series(1, len(l))) AS i FROM (SELECT doc_id, string_split(text, '\n') AS l FROM documents))""")
def text_lines(spark, folder):
    return R.text_lines(V.documents(spark, folder, "text"), "doc_id")


@query("source_fingerprint", "SELECT doc_id, md5(text) AS md5 FROM documents")
def fingerprint(spark, folder):
    return V.documents(spark, folder, "text").select("doc_id", F.md5(F.col("text").cast("binary")).alias("md5"))


@query("source_word_counts", """
SELECT word, n, row_number() OVER (ORDER BY encode(word) DESC)::BIGINT AS place FROM (
  SELECT word, count(*)::BIGINT AS n FROM (SELECT unnest(string_split(lower(text), ' ')) AS word FROM documents) GROUP BY word)""")
def word_counts(spark, folder):
    from seqprep.operators.blocks import position

    words = V.documents(spark, folder, "text").select(F.explode(F.split(F.lower("text"), " ")).alias("word"))
    counts = words.groupBy("word").agg(F.count("*").alias("n"))
    return position(counts, [], [F.desc("word")], "_r").select("word", "n", (F.col("_r") + 1).alias("place"))


@query("sink_manifest_lines", "SELECT 'audio-' || doc_id || '|' || n_chars || '|' || replace(replace(text, '\n', ' '), '|', ' ') || '|' || source AS value FROM documents")
def manifest_lines(spark, folder):
    d = V.documents(spark, folder, "text", "n_chars", "source").select(
        F.concat(F.lit("audio-"), F.col("doc_id").cast("string")).alias("audio"), "n_chars",
        F.replace(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("|"), F.lit(" ")).alias("text"), "source")
    return W.manifest_lines(d, ["audio", "n_chars", "text", "source"])


@query("sink_manifest_summary", f"""
SELECT count(*)::BIGINT AS utterances, sum(n_chars * 256)::BIGINT AS steps, {Q.r("sum(n_chars * 256)::BIGINT / 22050.0 / 3600.0")} AS hours,
  max(len(text))::BIGINT AS longest_text, max(n_chars * 256)::BIGINT AS longest_output FROM documents""")
def manifest_summary(spark, folder):
    d = V.documents(spark, folder, "text", "n_chars").withColumn("steps", F.col("n_chars") * 256)
    return W.manifest_summary(d, "steps", "text", 22050).withColumn("hours", F.round("hours", 6))


@query("sink_sampling_summary", "SELECT source || '_' || doc_id || ' : ' || text || ' : ' || lower(text) AS value FROM documents")
def sampling_summary(spark, folder):
    d = V.documents(spark, folder, "text", "source").withColumn("after", F.lower("text"))
    return W.sampling_lines(d, "source", "doc_id", "text", "after")


UNREADABLE = (
    "(regexp_matches(t, '[0-9](?:st|nd|rd|th)') OR len(list_filter(regexp_extract_all(t, '[0-9]+'), "
    "lambda r: len(ltrim(r, '0')) > 9)) > 0)"
)


@query("sink_quarantine", Q.chain(DOC, Q.ASCII + Q.LOWER + Q.COMMAS + Q.POUNDS + Q.DOLLARS + Q.POINT,
       f"SELECT doc_id, CASE WHEN {UNREADABLE} THEN 'unreadable number' END AS error FROM done"))
def quarantine(spark, folder):
    d = V.documents(spark, folder, "text")
    parts = W.quarantine(d, T.english_cleaners(F.col("text"), unreadable="null"), "unreadable number")
    return parts["good"].select("doc_id", F.lit(None).cast("string").alias("error")).unionByName(parts["rejects"].select("doc_id", "error"))


@query("sink_cached_features", "SELECT doc_id, len(text)::INT AS chars, len(string_split(text, ' '))::INT AS words FROM documents")
def cached_features(spark, folder):
    from seqprep.scratch import scratch_path

    path = scratch_path(spark, "features")
    compute = lambda d: d.select("doc_id", F.length("text").alias("chars"), F.size(F.split("text", " ")).alias("words"))
    d = V.documents(spark, folder, "text", "lang")
    params = {"kind": "lengths", "version": 1}
    W.cached_features(spark, d.where("lang = 'en'"), "doc_id", params, compute, path)
    return W.cached_features(spark, d, "doc_id", params, compute, path)


@query("text_path_stem", """
SELECT doc_id, string_split(source, '.')[1] AS speaker, string_split(source || '_' || doc_id, '_')[1] AS first_part FROM documents""")
def path_stem(spark, folder):
    d = V.documents(spark, folder, "source")
    name = F.concat(F.lit("/data/"), F.col("source"), F.lit(".wav"))
    first = AR.speaker_from_name(F.concat(F.lit("/data/"), F.col("source"), F.lit("_"), F.col("doc_id").cast("string"), F.lit(".wav")))
    return d.select("doc_id", AR.path_stem(name).alias("speaker"), first.alias("first_part"))


@query("array_sequence_mask", """
SELECT doc_id, repeat('1', n) || repeat('0', max(n) OVER (PARTITION BY doc_id // 64) - n) AS mask
FROM (SELECT doc_id, len(string_split(text, ' ')) AS n FROM documents)""")
def sequence_mask(spark, folder):
    """Masks as long as the longest text of a batch of 64 ids."""
    d = V.documents(spark, folder, "text").select("doc_id", F.expr("doc_id div 64").alias("batch"), F.size(F.split("text", " ")).alias("n"))
    d = d.join(d.groupBy("batch").agg(F.max("n").alias("longest")), "batch")
    return d.select("doc_id", F.array_join(AR.sequence_mask(F.col("n"), F.col("longest")).cast("array<string>"), "").alias("mask"))


@query("corpus_encode_english", Q.chain(
    "SELECT doc_id, source, text AS t FROM documents WHERE lang = 'en'", Q.ENGLISH,
    f"SELECT source, count(*)::BIGINT AS documents, sum(len({Q.char_ids('t')}) + 1)::BIGINT AS total_ids, max(len({Q.char_ids('t')}) + 1)::BIGINT AS longest FROM done GROUP BY source"))
def corpus_encode_english(spark, folder):
    """English documents cleaned and encoded: counts per source."""
    d = V.documents(spark, folder, "text", "source", "lang").where("lang = 'en'")
    n = F.size(S.text_to_ids(T.english_cleaners(F.col("text")))).cast("long")
    return d.select("source", n.alias("n")).groupBy("source").agg(
        F.count("*").alias("documents"), F.sum("n").alias("total_ids"), F.max("n").alias("longest"))
