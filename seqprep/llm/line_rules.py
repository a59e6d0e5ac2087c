"""Quality rules by cross-document line frequency.

Every line is normalised (A-Z lower-cased, words joined by one space) and hashed. Per host, a line's distinct documents
are counted, where copies of one document count once: a document is known by a 128-bit hash of its normalised lines in order and of the words that each has in all.
A line is boilerplate in its host when at least ``min_documents`` distinct documents, and at least the share
``min_share`` of the host's distinct documents, have it. Such lines are
removed, and a document of which less than ``min_left`` of the words remain is depleted and rejected, as is one that fails the base rules. Hosts, lines
and copies of any size are counted by partial aggregation; the join back is an ordinary one that splits hot keys.

Null text: no words. Null host: a host of its own. Repeated rows: documents of their own. An empty text fails the base.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqprep.llm.bpe import _field
from seqprep.llm.common import LOWER, Powers, Texts, free_names, mix64, ngram_hash, slices, span_hash, written

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values, kind))


def line_table(df: DataFrame, key: str, text: str, host: str) -> DataFrame:
    """(key, host, counts of the base rules, line hashes and word counts of each distinct normalised line in order)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in slices(batches, "_text"):
            t = Texts(batch.column(2), powers)
            n_words = np.diff(t.word_off)
            doc = t.word_doc()
            salt = np.arange(t.n, dtype=np.uint64)
            hashes = t.word_hash()
            inside = ~t.space & ((t.data & 0xC0) != 0x80)
            # words in 3-word windows that the text has twice or more
            grams, place = ngram_hash(hashes, t.word_off, 3)
            key3 = mix64(grams ^ mix64(salt[doc[place]])) if len(place) else grams
            by = np.argsort(key3, kind="stable")
            same = key3[by][1:] == key3[by][:-1]
            again = np.zeros(len(by), bool)
            again[by[1:][same]] = True
            again[by[:-1][same]] = True
            covered = np.zeros(len(hashes) + 2, bool)
            for k in range(3):
                covered[place[again] + k] = True
            repeated = np.bincount(doc[covered[: len(doc)]], minlength=t.n)
            # lines with a word: equal ones, then normalised ones
            start, end, owner = t.lines()
            first, last = np.searchsorted(t.word_start, start), np.searchsorted(t.word_start, end)
            full = last > first
            start, end, owner, first, last = start[full], end[full], owner[full], first[full], last[full]
            exact = span_hash(t.data.astype(np.uint64), start, end, powers)
            distinct = np.unique(mix64(exact ^ mix64(salt[owner])), return_index=True)[1]
            duplicates = np.bincount(owner, minlength=t.n) - np.bincount(owner[distinct], minlength=t.n)
            lower = t.word_hash(LOWER[t.data])
            normal = span_hash(lower, first, last, powers)
            _, index, inverse = np.unique(mix64(normal ^ mix64(salt[owner])), return_index=True, return_inverse=True)
            words = np.bincount(inverse, weights=last - first).astype(np.int64)
            order = np.argsort(index, kind="stable")
            per = np.bincount(owner[index], minlength=t.n)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array(t.per_text(inside), pa.int64()),
                    pa.array(t.per_text(SYMBOLS[t.data]), pa.int64()), pa.array(duplicates, pa.int64()), pa.array(repeated, pa.int64()),
                    _lists(normal[index][order].view(np.int64), per, pa.int64()), _lists(words[order], per, pa.int64()),
                ],
                names=[key, "_host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "_lines", "_line_words"],
            )

    narrow = df.select(F.col(key), F.coalesce(F.col(host).cast("string"), F.lit("\x00")).alias("_host"), F.col(text).alias("_text"))
    return narrow.mapInArrow(
        run,
        f"{_field(df, key)}, _host string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
        "_lines array<bigint>, _line_words array<bigint>",
    )


def frequent_lines(lines: DataFrame, min_documents: int, min_share: float) -> DataFrame:
    """(_host, _line): boilerplate lines, from rows (_row, _host, _line, _whole0, _whole1)."""
    per_host = lines.select("_host", "_whole0", "_whole1").distinct().groupBy("_host").agg(F.count("*").alias("_host_docs"))
    seen = lines.select("_host", "_line", "_whole0", "_whole1").distinct()
    enough = seen.groupBy("_host", "_line").agg(F.count("*").alias("_distinct")).where(F.col("_distinct") >= min_documents)
    return enough.join(per_host, "_host").where(F.col("_distinct") >= min_share * F.col("_host_docs")).select("_host", "_line")


def line_rules(df: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", min_documents: int = 10,
               min_share: float = 0.001, min_left: float = 0.3, min_words: int = 50, max_repeat: int = 50) -> DataFrame:
    """One row per input row: key, base counts, base_failed, removed_words, removed_lines (hashes), kept."""
    docs = written(line_table(df, key, text, host).withColumn("_row", F.monotonically_increasing_id()), "lines")
    whole = [F.xxhash64(F.lit(i), "_lines", "_line_words").alias(f"_whole{i}") for i in range(2)]
    lines = docs.select("_row", "_host", *whole, F.explode(F.arrays_zip("_lines", "_line_words")).alias("_x")).select(
        "_row", "_host", F.col("_x._lines").alias("_line"), F.col("_x._line_words").alias("_n_words"), "_whole0", "_whole1"
    )
    hit = lines.join(frequent_lines(lines, min_documents, min_share), ["_host", "_line"])
    removed = hit.groupBy("_row").agg(F.sum("_n_words").alias("removed_words"), F.sort_array(F.collect_list("_line")).alias("removed_lines"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    gone = F.coalesce("removed_words", F.lit(0))
    return docs.drop("_lines", "_line_words").join(removed, "_row", "left").select(
        key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), gone.alias("removed_words"),
        F.coalesce("removed_lines", F.array().cast("array<bigint>")).alias("removed_lines"),
        (~failed & (F.col("n_words") - gone >= min_left * F.col("n_words"))).alias("kept"),
    )


def clean_documents(df: DataFrame, text: str = "text", host: str = "source", **limits) -> DataFrame:
    """The rows of ``df`` that the rules keep, without their boilerplate lines; all columns stay.

    A verdict depends on host and text only, so it is joined back by two hashes of both, and equal rows fare alike.
    """
    one, two, out = free_names(df, "_mark0", "_mark1", "_gone")
    marks = [F.xxhash64(F.coalesce(F.col(host).cast("string"), F.lit("\x00")), F.col(text), F.lit(i)).alias(name) for i, name in enumerate((one, two))]
    marked = df.select("*", *marks)
    keyed = marked.select(F.struct(F.col(one).alias("a"), F.col(two).alias("b")).alias("_key"), F.col(host).alias("_from"), F.col(text).alias("_body"))
    verdict = line_rules(keyed, "_key", "_body", "_from", **limits).where("kept")
    gone = verdict.groupBy(F.col("_key.a").alias(one), F.col("_key.b").alias(two)).agg(F.max("removed_lines").alias(out))
    columns, at = df.columns, df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in slices(batches, text):
            gone = batch.column(len(columns)).to_pylist()
            t = Texts(batch.column(at), powers)
            start, end, owner = t.lines()
            first, last = np.searchsorted(t.word_start, start), np.searchsorted(t.word_start, end)
            normal = span_hash(t.word_hash(LOWER[t.data]), first, last, powers).view(np.int64)
            begin = np.searchsorted(owner, np.arange(t.n + 1))
            texts = batch.column(at).to_pylist()
            for i, lines in enumerate(gone):
                if lines:
                    out = set(lines)
                    rows = range(begin[i], begin[i + 1])
                    keep = [t.data[start[r] : end[r]].tobytes() for r in rows if last[r] == first[r] or int(normal[r]) not in out]
                    texts[i] = b"\n".join(keep).decode()
            arrays = [pa.array(texts, batch.schema.field(i).type) if i == at else batch.column(i) for i in range(len(columns))]
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    joined = marked.join(gone, [one, two]).select(*[F.col(f"`{c}`") for c in columns], out)
    return joined.mapInArrow(run, df.schema)
