"""Mixed character and phone representations of texts.

words(key, idx, word, raw_word) is one row per word; pronunciations come by a checked broadcast of the lexicon (salted
join beyond its size bound) and the text is put together again by one shuffle on its key. Which words are read as phones
is decided per text from md5-ordered slots, so the choice is the same in every engine and on every rerun.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from seqprep.functions import phones as P
from seqprep.functions import symbols as S
from seqprep.functions import text as T
from seqprep.scratch import written

MARKS = "!?.,;:"
# marks that a spelled text keeps, by rank, and what a lookup leaves out of a word
PAUSES = ["!", ",", ":", "?", "."]
UNSPOKEN = dict.fromkeys(map(ord, ',;"[].!?'))
MIXED_AT_ONCE = 1 << 21
MODES = ("chars_only", "phones_only", "blended_pref", "blended", "both")


def text_words(df: DataFrame, key: str, clean: str, raw: str | None = None) -> DataFrame:
    """(key, idx, word, bare, raw_word): words split at spaces, ``bare`` without marks."""
    words = F.split(clean, " ")
    pairs = F.zip_with(words, F.split(raw, " ") if raw else words, lambda w, r: F.struct(w.alias("word"), r.alias("raw_word")))
    x = df.select(key, F.posexplode(pairs).alias("idx", "_p")).where("_p.word is not null")
    return x.select(key, "idx", "_p.word", F.translate("_p.word", MARKS, "").alias("bare"), "_p.raw_word")


def phone_ids_of(phones: Column) -> Column:
    """Phone ids of ``@p@q``."""
    return S.symbol_ids(S.after_first(F.split(phones, "@")), "phone")


def word_chunks(words: DataFrame, lexicon: DataFrame, key: str, rules: DataFrame | None = None) -> DataFrame:
    """(key, idx, word, chars, phones): character ids and phone ids of each word, end symbols stripped.

    Words the lexicon lacks get letter-rule phones when ``rules`` is given, else an empty list. Phones are encoded once
    per lexicon entry and per distinct unknown word; only a closing mark is added per word.
    """
    lex = P.first_pronunciation(lexicon).withColumn("_ids", phone_ids_of(F.col("phones"))).drop("phones")
    by_raw = lex.select(F.col("word").alias("raw_word"), F.col("_ids").alias("_raw"))
    by_bare = lex.select(F.col("word").alias("bare"), F.col("_ids").alias("_bare"))
    x = P.lookup_join(P.lookup_join(words, by_raw, ["raw_word"]), by_bare, ["bare"])
    x = x.withColumn("_ids", F.coalesce("_raw", "_bare")).drop("_raw", "_bare")
    if rules is not None:
        # cleaned, split and looked up once: the unknown words come from the written rows
        x = written(x, "words")
        missing = x.where("_ids is null").select(F.col("bare").alias("word"))
        spelled = P.rule_g2p(missing, rules).select(F.col("word").alias("bare"), phone_ids_of(rule_phones(F.col("phones"))).alias("_rule"))
        spelled = written(spelled, "spelled")
        x = P.lookup_join(x, spelled, ["bare"]).withColumn("_ids", F.coalesce("_ids", "_rule")).drop("_rule")
    last = F.substring("word", -1, 1)
    mark = F.when(last.isin(*"!,:?"), F.array(F.instr(F.lit("".join(S.PHONE_MARKS)), last) + (S.VOCABULARY["phone"].index("!") - 1)))
    none = F.array().cast("array<int>")
    phones = F.when(F.col("_ids").isNull(), none).when(mark.isNull(), F.col("_ids")).otherwise(F.concat("_ids", mark))
    return x.select(key, "idx", "word", S.char_ids(F.col("word")).alias("chars"), phones.alias("phones"))


def rule_phones(lists: Column) -> Column:
    """Letter-rule output to ``@p@q``: marks in angle brackets left out, lower case."""
    kept = F.filter(lists, lambda p: ~p.contains("<"))
    parts = F.filter(F.split(F.array_join(kept, " "), " +"), lambda p: p != "")
    return F.array_join(F.transform(parts, S.strip_stress), "")


def blend_flags(n: Column, seed: object, key: Column) -> Column:
    """First n of a shuffled list of n zeros and n ones; the shuffle orders slots by md5(seed:key:slot)."""
    slot = lambda i: F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"), i.cast("string")).cast("binary")), i.alias("i"))
    order = F.sort_array(F.transform(F.sequence(F.lit(0), 2 * n - 1), slot))
    return F.transform(F.slice(order, F.lit(1), n), lambda s: (s["i"] >= n).cast("int"))


def mix_representations(chunks: DataFrame, key: str, mode: str = "blended", seed: object = 0, char_space: bool = True) -> DataFrame:
    """(key, ids, mask) from word_chunks; mask 0 is a character id, 1 a phone id. ``both`` gives (key, ids, phone_ids)."""
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    space, phone_space = S.VOCABULARY["char"].index(" "), S.VOCABULARY["phone"].index(" ")
    parts = chunks.select(F.struct(key).alias("_key"), "idx", "chars", "phones").mapInArrow(_packed, _packed_schema(chunks, key))
    piece = F.struct(*[F.col(c).alias(c) for c in PACKED])
    rows = parts.groupBy(F.col(f"_key.{key}").alias(key)).agg(F.collect_list(piece).alias("_w"), F.sum(F.octet_length("idx") / 4).cast("int").alias("_n"))
    forced = char_space or mode != "phones_only"
    if mode == "blended":
        rows = rows.withColumn("_flags", blend_flags(F.col("_n"), seed, F.col(key)))
    rows = rows.drop("_n")
    names = ("ids", "phone_ids") if mode == "both" else ("ids", "mask")
    return rows.mapInArrow(
        _mixer(key, mode, names, space, phone_space, forced), ST.StructType([rows.schema[key], *[ST.StructField(n, ST.ArrayType(ST.IntegerType())) for n in names]]))


PACKED = ("idx", "n_chars", "n_phones", "chars", "phones")


def _packed_schema(chunks: DataFrame, key: str) -> ST.StructType:
    return ST.StructType([ST.StructField("_key", ST.StructType([chunks.schema[key]])), *[ST.StructField(c, ST.BinaryType()) for c in PACKED]])


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and flat values of an array of lists without nulls."""
    if column.null_count:
        raise ValueError("a word has no list of ids")
    return column.value_lengths().to_numpy().astype(np.int32), column.flatten().to_numpy().astype(np.uint8)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Consecutive words of a text as one row: their numbers, sizes and ids as bytes, as ids of all vocabularies are below 256."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column("_key")
        codes = pc.fill_null(keys.field(0).dictionary_encode(null_encoding="encode").indices, -1).to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(codes[1:] != codes[:-1]) + 1, [len(codes)]])
        idx = batch.column("idx").to_numpy().astype(np.int32)
        (n_chars, chars), (n_phones, phones) = _lists(batch.column("chars")), _lists(batch.column("phones"))
        in_chars, in_phones = np.append(0, np.cumsum(n_chars)), np.append(0, np.cumsum(n_phones))
        cut = lambda values, at: pa.array([values[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())
        yield pa.RecordBatch.from_arrays(
            [keys.take(pa.array(cuts[:-1])), cut(idx, cuts), cut(n_chars, cuts), cut(n_phones, cuts), cut(chars, in_chars[cuts]), cut(phones, in_phones[cuts])],
            names=["_key", *PACKED])


def _picked(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches values[start : start + size] one behind the other."""
    ends = np.cumsum(sizes)
    return values[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


def _spaced(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, space: int) -> np.ndarray:
    """As ``_picked``, with ``space`` between two stretches."""
    with_space = sizes + 1
    out = np.full(int(with_space.sum()), space, np.int32)
    ahead = np.cumsum(with_space) - with_space
    out[np.repeat(ahead - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))] = _picked(values, starts, sizes)
    return out[:-1]


def _mixer(key: str, mode: str, names: tuple[str, str], space: int, phone_space: int, forced: bool):
    def one(pieces: list[dict], flags: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        join = lambda c, kind: np.frombuffer(b"".join(p[c] for p in pieces), kind)
        idx, n_chars, n_phones = (join(c, np.int32).astype(np.int64) for c in PACKED[:3])
        chars, phones = join("chars", np.uint8), join("phones", np.uint8)
        at_chars, at_phones = np.cumsum(n_chars) - n_chars, np.cumsum(n_phones) - n_phones
        order = np.argsort(idx, kind="stable")
        if len(idx) > 1 and (np.diff(idx[order]) == 0).any():
            # rows of one key share word numbers: by their ids then
            ids = lambda i: (chars[at_chars[i] : at_chars[i] + n_chars[i]].tobytes(), phones[at_phones[i] : at_phones[i] + n_phones[i]].tobytes())
            order = np.array(sorted(range(len(idx)), key=lambda i: (idx[i], *ids(i))))
        n_chars, n_phones, at_chars, at_phones = n_chars[order], n_phones[order], at_chars[order], at_phones[order]
        if mode == "both":
            return _spaced(chars, at_chars, n_chars, space), _spaced(phones, at_phones, n_phones, phone_space)
        n = len(idx)
        if mode == "blended_pref":
            flags = n_phones > 0
        elif mode != "blended":
            flags = np.full(n, mode == "phones_only")
        flags = flags.astype(np.int64)
        # a word without phones stays characters; its mask still tells the draw
        spelled = (n_phones == 0) | (flags == 0)
        both = np.concatenate([chars, phones])
        sizes, starts = np.where(spelled, n_chars, n_phones), np.where(spelled, at_chars, at_phones + len(chars))
        sep, sep_mask = (space, 0) if forced else (phone_space, 1)
        ids = _spaced(both, starts, sizes, sep)
        mask = _spaced(np.repeat(flags, sizes), np.cumsum(sizes) - sizes, sizes, sep_mask)
        return np.append(ids, S.END_ID), np.append(mask, 1 if mode == "phones_only" else 0)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drawn = batch.column("_flags") if mode == "blended" else None
            first, left, right, size = 0, [], [], 0
            for i in range(batch.num_rows):
                a, b = one(batch.column("_w")[i].as_py(), None if drawn is None else drawn[i].values.to_numpy())
                left.append(a), right.append(b)
                size += len(a) + len(b)
                if size > MIXED_AT_ONCE or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(key).slice(first, i + 1 - first), *map(_arrays, (left, right))], names=[key, *names])
                    first, left, right, size = i + 1, [], [], 0

    return work


def _arrays(lists: list[np.ndarray]) -> pa.Array:
    ends = np.append(0, np.cumsum([len(x) for x in lists])).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists).astype(np.int32)))


def pronounce(
    df: DataFrame, key: str, text: str, lexicon: DataFrame, rules: DataFrame | None = None, pause_marks: bool = True, max_bytes: int = P.TABLE_BYTES
) -> DataFrame:
    """(key, phones): ``@hh@ay @dh@er ~``. Lexicon or letter rules per word, one mark kept per word, then the final mark.

    With ``pause_marks`` every mark is written as a space, else as itself; ``~`` closes a text that has any mark. Words
    are looked up inside their text; only rows whose key comes more than once, which make one text together, are taken
    apart, and all rows where the lexicon or the rules have more than ``max_bytes`` or a word of the lexicon comes twice.
    """
    x = df.select(key, F.col(text).alias("_raw"), T.english_cleaners(F.col(text)).alias("_clean"))
    last = F.substring("_raw", -1, 1)
    final = F.coalesce(*[F.when(F.col("_raw").contains(m), F.lit(m)) for m in reversed(PAUSES)])
    x = x.withColumn("_end", F.when(final == last, last).otherwise(" "))
    spoken = P.first_pronunciation(lexicon)
    tables = [spoken] if rules is None else [spoken, rules]
    if any(P.table_bytes(t) > max_bytes for t in tables) or not spoken.groupBy("word").count().where("word is not null and count > 1").isEmpty():
        return _joined_pronounce(x, key, spoken, rules, pause_marks)
    name = F.to_json(F.struct(key))
    repeated = written(df.groupBy(name.alias("_name")).agg(F.count("*").alias("_n")).where("_n > 1").select("_name"), "repeated")
    if repeated.isEmpty():
        return _texts_pronounce(x, key, spoken, rules, pause_marks)
    x = x.withColumn("_name", name)
    alone, shared = (P.lookup_join(x, repeated, ["_name"], how).drop("_name") for how in ("left_anti", "left_semi"))
    return _texts_pronounce(alone, key, spoken, rules, pause_marks).unionByName(_joined_pronounce(shared, key, spoken, rules, pause_marks))


def _texts_pronounce(x: DataFrame, key: str, spoken: DataFrame, rules: DataFrame | None, pause_marks: bool) -> DataFrame:
    """``pronounce`` with a broadcast lexicon and rules; the words of a text never leave its row."""
    any_mark = F.col("_clean").rlike("[!,:?.]")
    x = x.select(key, "_end", any_mark.alias("_any"), F.split(F.trim("_clean"), " ").alias("_words"))
    x = x.mapInArrow(_spoken_kernel(spoken, rules, pause_marks), ST.StructType([*x.schema.fields[:3], ST.StructField("_joined", ST.StringType())]))
    return x.select(key, F.when(F.col("_any"), F.concat("_joined", _closing(pause_marks), F.lit("~"))).otherwise(F.col("_joined")).alias("phones"))


def _spoken_kernel(spoken: DataFrame, rules: DataFrame | None, pause_marks: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (key, _end, _any, _words) with the phones of their words as one text instead of them: every word but the last
    with its mark, or with a space in a text without marks. Rows without phones go. A task looks each distinct word up once."""
    lexicon = spoken.sparkSession.sparkContext.broadcast(dict(tuple(r) for r in spoken.where("word is not null and phones is not null").collect()))
    # a rule's phones are spelled here, as a word's are its rules' one after another
    table = None if rules is None else P.shared_rules(rules.withColumn("phones", rule_phones(F.array("phones"))))

    def words_of(lists: pa.Array, marked: pa.Array, say: Callable) -> pa.Array:
        words = lists.flatten().dictionary_encode()
        said = [say(w) for w in words.dictionary.to_pylist()]
        forms = pa.array([p for p, _ in said] + [None if p is None else p + m for p, m in said] + [None if p is None else p + " " for p, _ in said], pa.string())
        number = words.indices.to_numpy()
        has = np.array([p is not None for p, _ in said], bool)[number] if len(said) else np.zeros(0, bool)
        ends = np.append(0, np.cumsum(pc.fill_null(lists.value_lengths(), 0).to_numpy()))
        kept = np.append(0, np.cumsum(has))[ends]
        form = np.repeat(np.where(pc.fill_null(marked, False).to_numpy(zero_copy_only=False), 1, 2), np.diff(kept))
        form[kept[1:][np.diff(kept) > 0] - 1] = 0
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(kept.astype(np.int32)), forms.take(pa.array(number[has] + form * len(said)))), "")
        return pc.if_else(pa.array(np.diff(kept) > 0), joined, pa.scalar(None, pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers = None if table is None else P.Centers(table.value)
        known: dict = {}

        def say(word: str) -> tuple[str | None, str]:
            if word not in known:
                if len(known) > 100_000:
                    known.clear()
                bare = word.translate(UNSPOKEN)
                phones = lexicon.value.get(bare) if bare else None
                if phones is None and bare and centers is not None:
                    parts = P.walk(bare.upper(), centers)
                    phones = None if parts is None else "".join(parts)
                known[word] = phones, next((" " if pause_marks else m for m in PAUSES if m in word), " ")
            return known[word]

        for batch in batches:
            for at in range(0, batch.num_rows, P.LINES):
                part = batch.slice(at, P.LINES)
                joined = words_of(part.column(3), part.column(2), say)
                columns = [*part.columns[:3], joined]
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names[:3], "_joined"]).filter(joined.is_valid())

    return run


def _closing(pause_marks: bool) -> Column:
    return F.when(F.col("_end") == " ", " ").otherwise(F.lit(" ") if pause_marks else F.col("_end"))


def _joined_pronounce(x: DataFrame, key: str, spoken: DataFrame, rules: DataFrame | None, pause_marks: bool) -> DataFrame:
    """``pronounce`` by joins of the words, which come together again by their key."""
    any_mark = F.col("_clean").rlike("[!,:?.]")
    words = x.select(key, "_end", any_mark.alias("_any"), F.posexplode(F.split(F.trim("_clean"), " ")).alias("idx", "word"))
    words = words.withColumn("bare", T.strip_punctuation_for_lookup(F.col("word"))).where("bare <> ''")
    found = P.lookup_join(words, spoken.withColumnRenamed("word", "bare"), ["bare"])
    if rules is not None:
        # cleaned, split and looked up once: the unknown words come from the written rows
        found = written(found, "words")
        missing = found.where("phones is null").select(F.col("bare").alias("word"))
        spelled = P.rule_g2p(missing, rules).select(F.col("word").alias("bare"), rule_phones(F.col("phones")).alias("_rule"))
        spelled = written(spelled, "spelled")
        found = P.lookup_join(found, spelled, ["bare"]).withColumn("phones", F.coalesce("phones", "_rule"))
    found = found.where("phones is not null")
    mark = F.coalesce(*[F.when(F.col("word").contains(m), F.lit(" " if pause_marks else m)) for m in PAUSES], F.lit(" "))
    rows = found.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("idx", "phones", mark.alias("mark")))).alias("_w"),
        F.first("_end").alias("_end"), F.first("_any").alias("_any"),
    )
    n = F.size("_w")
    marked = F.array_join(
        F.transform("_w", lambda w, i: F.concat(w["phones"], F.when(i < n - 1, w["mark"]).otherwise(""))), ""
    )
    plain = F.array_join(F.transform("_w", lambda w: w["phones"]), " ")
    return rows.select(key, F.when(F.col("_any"), F.concat(marked, _closing(pause_marks), F.lit("~"))).otherwise(plain).alias("phones"))
