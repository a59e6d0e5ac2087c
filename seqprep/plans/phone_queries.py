"""Queries on pronunciation by letter rules, lexicons and word alignments."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from seqprep.functions import phones as PH
from seqprep.functions import text as T
from seqprep.operators import filters as FL
from seqprep.operators import mix as MX
from seqprep.plans import sql as Q
from seqprep.plans import views as V
from seqprep.plans.corpus_queries import LEX, RULES, letter_rules, lexicon
from seqprep.plans.registry import query
from seqprep.sources import readers as R


def rules_sql() -> str:
    """ft0(word, i, rank, center, phones): every rule that fits at place i, one branch with fixed patterns per rule."""
    branches = []
    for rank, line in enumerate(RULES):
        before, center, after, phones = re.match(r"(.*?)\[(.*?)\](.*?)=/(.*)/", line).groups()
        before, after = before.lstrip(), after.rstrip()
        n, m = len(before), len(center)
        tests = [f"substr(word, i + 1, {m}) = {Q.lit(center)}"]
        if any(c in PH.CONTEXT for c in before + center + after):
            pattern = lambda t: Q.lit("^" + "".join(PH.CONTEXT.get(c, re.escape(c)) for c in t))
            if before:
                tests.append(f"regexp_matches(substr(word, greatest(i - {n}, 0) + 1, least({n}, i)), {pattern(before)})")
            if after:
                tests.append(f"regexp_matches(substr(word, i + {m} + 1), {pattern(after)})")
        else:
            if before:
                tests.append(f"i >= {n} AND substr(word, i - {n} + 1, {n}) = {Q.lit(before)}")
            if after:
                tests.append(f"substr(word, i + {m} + 1) = {Q.lit(after)}")
        branches.append(f"SELECT word, i, {rank} AS rank, {m} AS size, {Q.lit(phones)} AS phones FROM places WHERE {' AND '.join(tests)}")
    return "ft0 AS (" + " UNION ALL ".join(branches) + ")"


# walked(word, phones list or NULL) for the upper-case words of the table wd(word)
WALK = f"""places AS MATERIALIZED (SELECT word, unnest(range(0, len(word))) AS i FROM wd), {rules_sql()},
ft AS MATERIALIZED (SELECT word, i, arg_min(size, rank) AS size, arg_min(phones, rank) AS phones FROM ft0 GROUP BY word, i),
wk AS (SELECT word, 0::BIGINT AS i, []::VARCHAR[] AS phones FROM wd UNION ALL SELECT wk.word, wk.i + ft.size, list_append(wk.phones, ft.phones) FROM wk JOIN ft ON ft.word = wk.word AND ft.i = wk.i),
walked AS (SELECT wd.word, wk.phones FROM wd LEFT JOIN wk ON wk.word = wd.word AND wk.i = len(wd.word))"""
RULE_PHONES = (
    "array_to_string(list_transform(list_filter(string_split(array_to_string(list_filter({p}, lambda p: NOT contains(p, '<')), ' '), ' '), lambda p: p <> ''), "
    "lambda p: '@' || lower(CASE WHEN regexp_matches(p, '[012]') THEN left(p, len(p) - 1) ELSE p END)), '')"
)


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@query("phones_rule_g2p", recursive(Q.chain("SELECT doc_id, text AS t FROM documents", Q.ENGLISH, "")) + f""",
ws AS (SELECT DISTINCT unnest(string_split(t, ' ')) AS w FROM done), wd AS MATERIALIZED (SELECT DISTINCT upper(w) AS word FROM ws WHERE w <> ''), {WALK}
SELECT w AS word, array_to_string(phones, ' ') AS phones FROM ws JOIN walked ON walked.word = upper(w) WHERE w <> ''""")
def rule_g2p(spark, folder):
    w = V.documents(spark, folder, "text").select(F.explode(F.split(T.english_cleaners(F.col("text")), " ")).alias("word")).where("word <> ''")
    return PH.rule_g2p(w, letter_rules(spark)).select("word", F.array_join("phones", " ").alias("phones"))


LINE = "translate(t, '\"[]', '')"
for _m, _p in ((".", " . "), ("!", " ! "), ("?", " ? "), (",", " , "), (";", " , "), (":", " , ")):
    LINE = f"replace({LINE}, '{_m}', '{_p}')"


@query("phones_rulebased_text", recursive(Q.chain("SELECT doc_id, text AS t FROM documents", Q.ASCII + [LINE, "regexp_replace(regexp_replace(t, '^''', ''), '''$', '')"], "")) + f""",
tk AS (SELECT doc_id, i, regexp_replace(regexp_replace(l[i], '^''?-?', ''), '-?''?$', '') AS w FROM (SELECT doc_id, l, unnest(generate_series(1, len(l))) AS i FROM (SELECT doc_id, string_split(upper(t), ' ') AS l FROM done))),
wd AS MATERIALIZED (SELECT DISTINCT w AS word FROM tk WHERE w <> ''), {WALK}
SELECT d.doc_id, coalesce(x.phones, '') AS phones FROM done d LEFT JOIN (
  SELECT doc_id, lower(string_agg(array_to_string(phones, '&'), '^' ORDER BY i)) AS phones FROM tk JOIN walked ON walked.word = tk.w WHERE phones IS NOT NULL GROUP BY doc_id) x USING (doc_id)""")
def rulebased_text(spark, folder):
    rules = {"rulebased_g2p_cleaners": PH.rulebased_cleaner(letter_rules(spark))}
    phones = T.clean(F.col("text"), ["convert_to_ascii", "rulebased_g2p_cleaners"], rules)
    return V.documents(spark, folder, "text").select("doc_id", phones.alias("phones"))


@query("phones_pronounce", recursive(Q.chain("SELECT doc_id, text, text AS t FROM documents", Q.ENGLISH, "")) + f""", {LEX},
tk AS (SELECT doc_id, i, l[i] AS word, translate(l[i], ',;"[].!?', '') AS bare FROM (SELECT doc_id, l, unnest(generate_series(1, len(l))) AS i FROM (SELECT doc_id, string_split(trim(t, ' '), ' ') AS l FROM done))),
kn AS (SELECT tk.doc_id, tk.i, tk.word, tk.bare, lex.phones FROM tk LEFT JOIN lex ON lex.word = tk.bare WHERE bare <> ''),
wd AS MATERIALIZED (SELECT DISTINCT upper(bare) AS word FROM kn WHERE phones IS NULL), {WALK},
al AS (SELECT kn.doc_id, kn.i, kn.word, coalesce(kn.phones, CASE WHEN walked.phones IS NOT NULL THEN {RULE_PHONES.replace('{p}', 'walked.phones')} END) AS phones FROM kn LEFT JOIN walked ON kn.phones IS NULL AND walked.word = upper(kn.bare)),
en AS (SELECT doc_id, regexp_matches(t, '[!,:?.]') AS has_mark, CASE WHEN f IS NOT NULL AND f = right(text, 1) THEN f ELSE ' ' END AS closing FROM (
  SELECT *, CASE WHEN contains(text, '.') THEN '.' WHEN contains(text, '?') THEN '?' WHEN contains(text, ':') THEN ':' WHEN contains(text, ',') THEN ',' WHEN contains(text, '!') THEN '!' END AS f FROM done)),
mk AS (SELECT doc_id, i, phones, row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) AS back,
  CASE WHEN contains(word, '!') THEN '!' WHEN contains(word, ',') THEN ',' WHEN contains(word, ':') THEN ':' WHEN contains(word, '?') THEN '?' WHEN contains(word, '.') THEN '.' ELSE ' ' END AS mark FROM al WHERE phones IS NOT NULL)
SELECT doc_id, CASE WHEN any_value(has_mark) THEN string_agg(phones || CASE WHEN back > 1 THEN mark ELSE '' END, '' ORDER BY i) || any_value(closing) || '~' ELSE string_agg(phones, ' ' ORDER BY i) END AS phones
FROM mk JOIN en USING (doc_id) GROUP BY doc_id""")
def pronounce(spark, folder):
    return MX.pronounce(V.documents(spark, folder, "text"), "doc_id", "text", lexicon(spark), letter_rules(spark), pause_marks=False)


# Dictionary lines made from the words of the texts: vowels become stressed phones, "C", "H", "J", "Q", "X", "Y" stay and are unknown or known symbols.
VOWEL = {"a": "AE1", "e": "EH0", "i": "IH2", "o": "OW", "u": "UH1"}


def _spelled_sql(w: str) -> str:
    out = f"array_to_string(string_split({w}, ''), ' ')"
    for v, p in VOWEL.items():
        out = f"replace({out}, '{v}', '{p}')"
    return f"upper({out})"


WORD_LIST = "wl AS (SELECT w, count(*) AS n FROM (SELECT unnest(string_split(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'), ' ')) AS w FROM documents) WHERE w <> '' GROUP BY w)"


@query("source_lexicon", f"""
WITH {WORD_LIST}, e AS (SELECT upper(w) AS word, {_spelled_sql('w')} AS p, n FROM wl), k AS (SELECT * FROM e WHERE NOT regexp_matches(p, '(^| )[CHJQX]( |$)'))
SELECT word, CASE WHEN n >= 5 THEN p || ' / ' || array_to_string(list_reverse(string_split(p, ' ')), ' ') ELSE p END AS prons, CASE WHEN n >= 5 THEN 2 ELSE 1 END AS n FROM k""")
def lexicon_lines(spark, folder):
    words = F.split(F.regexp_replace(F.lower("text"), "[^a-z]+", " "), " ")
    w = V.documents(spark, folder, "text").select(F.explode(words).alias("w")).where("w <> ''").groupBy("w").agg(F.count("*").alias("n"))
    spelled = F.array_join(F.split("w", ""), " ")
    for v, p in VOWEL.items():
        spelled = F.replace(spelled, F.lit(v), F.lit(p))
    spelled = F.upper(spelled)
    first = F.struct(F.lit(1).cast("long").alias("line_no"), F.concat(F.upper("w"), F.lit("  "), spelled).alias("value"))
    other = F.struct(F.lit(2).cast("long").alias("line_no"), F.concat(F.upper("w"), F.lit("(1)  "), F.array_join(F.reverse(F.split(spelled, " ")), " ")).alias("value"))
    lines = w.select(F.explode(F.when(F.col("n") >= 5, F.array(first, other)).otherwise(F.array(first))).alias("l")).select("l.*")
    lex = R.parse_lexicon(lines)
    return lex.select("word", F.array_join(F.transform("prons", lambda p: F.array_join(p, " ")), " / ").alias("prons"), F.size("prons").alias("n"))


@query("filter_alignment_case", """
WITH w AS MATERIALIZED (SELECT doc_id AS id, u[2] AS i, u[1] AS word, CASE (u[2] * 7 + doc_id) % 5 WHEN 0 THEN 'not-found-in-transcript' WHEN 1 THEN 'not-found-in-audio' ELSE 'success' END AS c
  FROM (SELECT doc_id, unnest(list_zip(string_split(text, ' '), range(1, len(string_split(text, ' ')) + 1))) AS u FROM documents)),
p AS (SELECT *, sum(CASE WHEN c = 'not-found-in-transcript' THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY i)::BIGINT - 1 AS place FROM w)
SELECT p.id, count(*) AS words, sum(p.place)::BIGINT AS places, sum(('0x' || left(md5(p.place || ':' || p.word || '=' || t.word), 8))::BIGINT)::BIGINT AS digest
FROM p JOIN w t ON t.id = p.id AND t.i = p.place + 1 WHERE p.c = 'success' GROUP BY p.id""")
def alignment_case(spark, folder):
    words = F.split("text", " ")
    case = lambda i: F.when(((i + 1) * 7 + F.col("doc_id")) % 5 == 0, "not-found-in-transcript").when(((i + 1) * 7 + F.col("doc_id")) % 5 == 1, "not-found-in-audio").otherwise("success")
    no_phones = F.lit(None).cast("array<struct<phone string>>")
    records = V.documents(spark, folder, "text").select(
        F.col("doc_id").alias("id"), F.col("text").alias("clean"),
        F.transform(words, lambda w, i: F.struct(w.alias("word"), case(i).alias("case"), w.alias("alignedWord"), no_phones.alias("phones"))).alias("words"))
    x = FL.alignment_case_filter(records)
    # a digest that adds up: every word at its place counts, in one row per record
    pair = F.concat(F.col("place").cast("string"), F.lit(":"), "word", F.lit("="), "transcript_word")
    digest = F.conv(F.substring(F.md5(pair), 1, 8), 16, 10).cast("long")
    return x.groupBy("id").agg(F.count("*").alias("words"), F.sum(F.col("place").cast("long")).alias("places"), F.sum(digest).alias("digest"))


@query("source_manifest", """
SELECT 'a-' || doc_id AS audio, 'm-' || doc_id AS mel, n_chars::INT AS steps, nullif(regexp_replace(text, '[|\\n\\r]', ' ', 'g'), '') AS text, (doc_id % 20)::INT AS speaker_id FROM documents""")
def manifest(spark, folder):
    from seqprep.scratch import scratch_path
    from seqprep.sources import writers as W

    path = scratch_path(spark, "manifest")
    d = V.documents(spark, folder, "text", "n_chars").select(
        F.concat(F.lit("a-"), F.col("doc_id").cast("string")).alias("audio"), F.concat(F.lit("m-"), F.col("doc_id").cast("string")).alias("mel"),
        F.col("n_chars").cast("int").alias("steps"), F.regexp_replace("text", "[|\\n\\r]", " ").alias("text"), (F.col("doc_id") % 20).cast("int").alias("speaker_id"))
    W.write_manifest(d, d.columns, path)
    return R.read_manifest(spark, path)
