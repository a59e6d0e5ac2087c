"""The registered queries of this package: thin digests of the operators over whole tables."""

from __future__ import annotations

import zlib

from pyspark.sql import functions as F

from seqprep.llm.common import remainder, table


def tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _judged(scores, modulus: int, held: int):
    return scores.select(
        "doc_id", (remainder(F.col("doc_id"), modulus) == held).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op1_line_crf(spark, sf):
    from seqprep.llm import line_crf

    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = line_crf.fit(docs, labels, usable=remainder(F.col("doc_id"), 5) != 0)
    return _judged(line_crf.score(docs, "doc_id", "text", model), 5, 0)


def op2_line_frequency(spark, sf):
    from seqprep.llm.line_rules import line_rules

    return line_rules(table(spark, sf, "documents")).drop("removed_lines")


def op3_compact_windows(spark, sf):
    from seqprep.llm.compact_windows import duplicate_passages

    return duplicate_passages(table(spark, sf, "documents")).withColumnRenamed("source", "source_doc_id")


def op4_simhash_bk(spark, sf):
    from seqprep.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, sf, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op5_best_fit(spark, sf):
    from seqprep.llm.packing import pack_documents

    return pack_documents(table(spark, sf, "documents"), "doc_id", "text", tokenizer())


def op6_permutation_index(spark, sf):
    from seqprep.llm.permutation_index import nearest

    return nearest(table(spark, sf, "embeddings"), "vec_id", "embedding", F.col("id") % 20 == 0)


def op7_bpe(spark, sf):
    from seqprep.llm.bpe import round_trip

    return round_trip(table(spark, sf, "documents"), "doc_id", "text", tokenizer())


def op8_subword_toxicity(spark, sf):
    from seqprep.llm import toxicity

    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = toxicity.fit(docs, labels, usable=remainder(F.col("doc_id"), 4) != 2)
    return _judged(toxicity.score(docs, "doc_id", "text", model), 4, 2)


def op9_style_tree(spark, sf):
    from seqprep.llm.style_tree import main_text

    return main_text(table(spark, sf, "pages"))


def op10_hmm(spark, sf):
    from seqprep.llm.hmm_lm import score_documents

    held = remainder(F.col("doc_id"), 7) == 2
    scored = score_documents(table(spark, sf, "documents"), "doc_id", "text", ~held)
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def _slip(doc_id, run: str) -> str:
    """The run without one character, in one case of 31."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    at = h % len(run)
    return run if h % 31 else run[:at] + run[at + 1 :]


def op11_trie_pairs(spark, sf):
    from seqprep.llm.spelling import count_words, variants

    return variants(count_words(table(spark, sf, "documents"), least=7, change=_slip).where("n >= 2"))


def _planted(doc_id, text):
    """The text of one document in ten, its words from a drawn place on repeated with a drawn period."""
    from seqprep.functions.text import let

    h = F.crc32(doc_id.cast("string"))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def repeat(w):
        # one struct, so that the words are split once and the numbers worked out once
        n, g = F.size(w).cast("long"), F.floor(h / 10)
        return let(F.struct((g % n).alias("a"), (1 + F.floor((n - g % n) / (3 + g % 8))).alias("p"), n.alias("n")), lambda s: F.array_join(
            F.transform(F.sequence(F.lit(0).cast("long"), s["n"] - 1), lambda i: F.get(w, F.when(i < s["a"], i).otherwise(s["a"] + (i - s["a"]) % s["p"]).cast("int"))), " "
        ))

    return F.when((h % 10 == 0) & text.rlike(r"[^\x20\x09-\x0D]"), let(words, repeat)).otherwise(text)


def op12_lcp_kruskal(spark, sf):
    from seqprep.llm.periodic_runs import periodic_runs

    docs = table(spark, sf, "documents").select("doc_id", _planted(F.col("doc_id"), F.col("text")).alias("text"))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")])), "\n")
    x = periodic_runs(docs).withColumn("_b", best)
    return x.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("_b.start").alias("start"), (-F.col("_b.l")).alias("length"), F.col("_b.period").alias("period"),
        F.expr("-1000 * _b.l div _b.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_event_fold(spark, sf):
    from seqprep.llm.chat import format_chats, read_turns, turn_log, under_loss

    control = F.lit("</s>[INST] ok [/INST]")
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), control.alias("text"))
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    x = format_chats(turn_log(turns)).select("conv_id", "formatted", read_turns(F.col("formatted")).alias("_t"), under_loss(F.col("turns"), F.col("loss")).alias("_l"))
    said = F.array_join(F.transform("_t", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return x.select(
        "conv_id", F.size("_t").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.char_length("_l").cast("long").alias("loss_chars"),
        F.sha2("_l", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


OP13_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(regexp_replace(text, '([\[<])(\\*(INST\]|/INST\]|s>|/s>|SYS\]|/SYS\]|ROLE\]|TEXT\]|/ROLE\]))', '\1\\\2', 'g')) AS chars,
    CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 WHEN 'system' THEN 11
      ELSE 19 + length(regexp_replace(role, '([\[<])(\\*(INST\]|/INST\]|s>|/s>|SYS\]|/SYS\]|ROLE\]|TEXT\]|/ROLE\]))', '\1\\\2', 'g')) END AS marks FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, sum(chars + marks)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""

QUERIES = {f.__name__: f for f in (op1_line_crf, op2_line_frequency, op3_compact_windows, op4_simhash_bk, op5_best_fit, op6_permutation_index, op7_bpe, op8_subword_toxicity, op9_style_tree, op10_hmm, op11_trie_pairs, op12_lcp_kruskal, op13_event_fold)}
ORACLES: dict[str, str] = {"op13_event_fold": OP13_SQL}
