"""Symbol vocabularies and id encodings as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqprep.functions.text import let

# The symbol lists; the position in a list is the id.
PAD = "_"
END = "~"
CHARS = "abcdefghijklmnopqrstuvwxyz!',-.:? "
PHONES = [
    "aa", "ae", "ah", "ao", "aw", "ay", "b", "ch", "d", "dh", "eh", "er", "ey", "f", "g", "hh", "ih", "iy", "jh", "k",
    "l", "m", "n", "ng", "ow", "oy", "p", "r", "s", "sh", "t", "th", "uh", "uw", "v", "w", "y", "z", "zh", " ",
]
PHONE_MARKS = list("!',-.:?")
PAUSES = list("1234")
PRINTABLE = (
    "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~ \t\n\r\x0b\x0c"
)

VOCABULARY = {
    "char": [PAD, END, *CHARS],
    "phone": [PAD, END, *PHONES, *PHONE_MARKS],
    "pause": [PAD, END, *PHONES, *PAUSES],
}
END_ID = 1
WORDS_KEPT = 100_000


def vocabulary_kind(cleaner: str) -> str:
    return "pause" if "pause" in cleaner else "phone" if "phone" in cleaner else "char"


def vocabulary(spark: SparkSession) -> DataFrame:
    """vocab(kind, symbol, id), 131 rows."""
    rows = [(k, s, i) for k, symbols in VOCABULARY.items() for i, s in enumerate(symbols)]
    return spark.createDataFrame(rows, "kind string, symbol string, id int")


def _symbols(kind: str) -> Column:
    return F.array(*[F.lit(s) for s in VOCABULARY[kind]])


def keep_symbols(symbols: Column, kind: str) -> Column:
    """Drop symbols outside the vocabulary and the pad and end symbols."""
    return F.filter(symbols, lambda s: F.array_contains(F.array(*[F.lit(x) for x in VOCABULARY[kind][2:]]), s))


def symbol_ids(symbols: Column, kind: str) -> Column:
    """Ids of the known symbols of an array, others dropped."""
    known = _symbols(kind)
    ids = F.transform(symbols, lambda s: (F.array_position(known, s) - 1).cast("int"))
    return F.filter(ids, lambda i: i > 1)


def char_ids(text: Column) -> Column:
    """Character ids without the end id, unknown characters dropped; a position in a string instead of a map probe."""

    def encode(t: Column) -> Column:
        ids = F.filter(F.transform(F.split(t, ""), lambda c: F.instr(F.lit(CHARS), c) + 1), lambda i: i > 1)
        return F.when(t == "", F.array().cast("array<int>")).otherwise(ids)

    return let(text, encode)


def text_to_ids(text: Column) -> Column:
    return F.concat(char_ids(text), F.array(F.lit(END_ID)))


def _bare_phone(phone: Column) -> Column:
    return F.regexp_replace(phone, "([a-z])[!,:?.;]+", "$1")


def after_first(parts: Column) -> Column:
    return F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))


def phone_symbols(text: Column) -> Column:
    """Symbols of words like ``@hh@ay!``: a leading or else a trailing mark is kept, a space closes each word."""

    def word(w: Column) -> Column:
        head, tail = F.substring(w, 1, 1), F.substring(w, -1, 1)
        lead, trail = head.isin(*"!,:?"), tail.isin(*"!,:?") & (F.length(w) > 1)
        phones = F.transform(after_first(F.split(F.trim(w), "@")), _bare_phone)
        return F.concat(
            F.when(lead, F.array(head)).otherwise(F.array().cast("array<string>")),
            phones,
            F.when(trail & ~lead, F.array(tail)).otherwise(F.array().cast("array<string>")),
            F.array(F.lit(" ")),
        )

    return F.flatten(F.transform(F.split(text, " "), word))


def _word_ids(kind: str, symbols: Callable[[str], list[str]]) -> Callable[[Column], Column]:
    """Ids of a text's words and the end id; a task spells each distinct word about once."""
    number = {s: i for i, s in reversed([*enumerate(VOCABULARY[kind])]) if i > 1}

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[str, bytes] = {}

        def ids(word: str) -> bytes:
            found = known.get(word)
            if found is None:
                if len(known) >= WORDS_KEPT:
                    known.clear()
                found = known[word] = bytes(number[s] for s in symbols(word) if s in number)
            return found

        for batch in batches:
            lines = [b"" if t is None else b"".join([*map(ids, t.split(" ")), b"\x01"]) for t in (v.as_py() for v in batch)]
            ends = np.append(0, np.cumsum([len(x) for x in lines])).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(lines), np.uint8).astype(np.int32))
            null = batch.is_null() if batch.null_count else None
            yield pa.ListArray.from_arrays(pa.array(ends), values, mask=null)

    return encode


def _phones_of(word: str) -> list[str]:
    lead, trail = word[:1], word[-1:] if len(word) > 1 else ""
    phones = [re.sub("([a-z])[!,:?.;]+", r"\1", p) for p in word.split("@")[1:]]
    head = [lead] if lead and lead in "!,:?" else []
    return [*head, *phones, *([trail] if trail and trail in "!,:?" and not head else []), " "]


def _pauses_of(word: str) -> list[str]:
    out = []
    for p in word.split("@")[1:]:
        out.append(re.sub("[1-4]", "", p))
        out += next(([m] for m in PAUSES if m in p), [])
    return out if re.search("[1-4]", word) else [*out, " "]


def phones_to_ids(text: Column) -> Column:
    """Ids of ``phone_symbols`` and the end id."""
    return _word_ids("phone", _phones_of)(text)


def pause_symbols(text: Column) -> Column:
    """As ``phone_symbols``; a pause mark 1-4 follows the phone that carries it and replaces the closing space."""
    none = F.array().cast("array<string>")

    def phone(p: Column) -> Column:
        mark = F.coalesce(*[F.when(p.contains(m), F.lit(m)) for m in PAUSES])
        return F.concat(F.array(F.regexp_replace(p, "[1-4]", "")), F.when(mark.isNotNull(), F.array(mark)).otherwise(none))

    def word(w: Column) -> Column:
        phones = F.flatten(F.transform(after_first(F.split(F.trim(w), "@")), phone))
        return F.concat(phones, F.when(w.rlike("[1-4]"), none).otherwise(F.array(F.lit(" "))))

    return F.flatten(F.transform(F.split(text, " "), word))


def pause_phones_to_ids(text: Column) -> Column:
    """Ids of ``pause_symbols`` and the end id."""
    return _word_ids("pause", _pauses_of)(text)


def lookup_ids(symbols: Column, kind: str) -> Column:
    """``symbol_ids`` of a long array, looked up by hash for a whole batch at once (not inside a lambda)."""
    table = VOCABULARY[kind]

    @F.arrow_udf("array<int>")
    def look(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = pa.array(table)
        for batch in batches:
            at = pc.index_in(batch.flatten(), known)
            kept = pc.fill_null(pc.greater(at, END_ID), False)
            sums = np.append(0, np.cumsum(kept.to_numpy(zero_copy_only=False)))
            ends = np.append(0, np.cumsum(pc.fill_null(batch.value_lengths(), 0).to_numpy()))
            null = batch.is_null() if batch.null_count else None
            yield pa.ListArray.from_arrays(pa.array(sums[ends].astype(np.int32)), at.filter(kept), mask=null)

    return look(symbols)


def _shown(kind: str) -> Column:
    plain = {"phone": {PAD, END, " ", *"!,:?"}, "pause": {PAD, END, " ", *PAUSES}}
    if kind == "char":
        return _symbols(kind)
    return F.array(*[F.lit(s if s in plain[kind] else "@" + s) for s in VOCABULARY[kind]])


def ids_to_text(ids: Column, kind: str = "char") -> Column:
    shown = _shown(kind)
    joined = F.array_join(F.transform(ids, lambda i: F.get(shown, i)), "")
    return F.replace(joined, F.lit("}{"), F.lit(" ")) if kind == "char" else joined


def unmix(ids: Column, mask: Column) -> Column:
    """Decode every id by its mask: 0 character, 1 phone."""
    chars, phones = _shown("char"), _shown("phone")
    return F.array_join(F.zip_with(ids, mask, lambda i, m: F.when(m == 1, F.get(phones, i)).otherwise(F.get(chars, i))), "")


def strip_stress(phone: Column) -> Column:
    """``AH0`` → ``@ah``."""
    bare = F.when(phone.rlike("[012]"), F.regexp_replace(phone, ".$", "")).otherwise(phone)
    return F.lower(F.concat(F.lit("@"), bare))


def braced_phones(text: Column) -> Column:
    """Ids of text in which ``{AH0 B}`` spans are phones: array of struct(id, is_phone), end id last."""
    span = "\\{[^{}]+\\}"
    outside, inside = F.split(text, span, -1), F.regexp_extract_all(text, F.lit(span), F.lit(0))

    def tagged(ids: Column, flag: int) -> Column:
        return F.transform(ids, lambda i: F.struct(i.alias("id"), F.lit(flag).alias("is_phone")))

    def phones(hit: Column) -> Column:
        parts = F.split(F.regexp_replace(hit, "[{}]", ""), " ")
        return symbol_ids(F.transform(parts, lambda p: F.substr(strip_stress(p), F.lit(2))), "phone")

    pieces = F.zip_with(
        outside,
        inside,
        lambda o, i: F.concat(tagged(char_ids(o), 0), F.when(i.isNotNull(), tagged(phones(i), 1)).otherwise(tagged(char_ids(F.lit("")), 0))),
    )
    return F.concat(F.flatten(pieces), F.array(F.struct(F.lit(END_ID).alias("id"), F.lit(0).alias("is_phone"))))


def char_code(c: Column) -> Column:
    """Index among the 100 printable characters, -1 when absent."""
    return F.instr(F.lit(PRINTABLE), c).cast("int") - 1
