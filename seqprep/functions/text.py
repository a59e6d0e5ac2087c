"""Text cleaners as column expressions: no Python in the row path."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spelled-out initials (a space comes first), in this order.
INITIALS = ["USSR", "USA", "US", "UK", "FBI", "CIA"]

# Title abbreviations, in this order.
ABBREVIATIONS = [
    ("mrs", "misess"), ("mr", "mister"), ("dr", "doctor"), ("st", "saint"), ("co", "company"), ("jr", "junior"),
    ("maj", "major"), ("gen", "general"), ("drs", "doctors"), ("rev", "reverend"), ("lt", "lieutenant"),
    ("hon", "honorable"), ("sgt", "sergeant"), ("capt", "captain"), ("esq", "esquire"), ("ltd", "limited"),
    ("col", "colonel"), ("ft", "fort"),
]

# Ordered punctuation rewrites (found, written); None marks the step that drops one final dot.
PUNCTUATION = [
    ("'s", "-s"), ('"', ""), ("'", ""), ("(", ""), (")", ""), (";", ","), ("--", ","), (":", ", "), (None, None),
    ("[", ""), ("]", ""), (".", " "), (" , ", ", "), (" , ", ", "),
]

# Number words ("fourty" is the spelling the vocabulary was trained on).
SMALL = [
    "", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen",
    "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen",
]
TENS = ["", "", "twenty", "thirty", "fourty", "fifty", "sixty", "seventy", "eighty", "ninety"]
SCALES = ["", "thousand", "million"]
LARGEST = 999_999_999

# Characters that transliterate to several letters.
LONG_LETTERS = {
    "ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "Th", "£": "PS", "€": "EUR", "…": "...",
    "—": "--", "«": "<<", "»": ">>", "°": "deg", "©": "(c)", "®": "(r)", "™": "(tm)",
}
SHORT_LETTERS = {"ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L", "ı": "i", "–": "-", "‘": "'", "’": "'", "“": '"', "”": '"', " ": " "}


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times (a nested column would be copied at every use)."""
    return F.transform(F.array(value), lambda v: use(v))[0]


def letter_table() -> tuple[str, str]:
    """Accented Latin letters and their base letters, from the Unicode decompositions."""
    pairs = dict(SHORT_LETTERS)
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFKD", chr(code))[0]
        if base.isascii() and base.isalpha():
            pairs.setdefault(chr(code), base)
    return "".join(pairs), "".join(pairs.values())


def convert_to_ascii(text: Column) -> Column:
    """Letters lose their accents, a few symbols are spelled, everything else outside ASCII is dropped."""
    short, base = letter_table()

    def spell(t: Column) -> Column:
        out = F.translate(t, short, base)
        for letter, spelled in LONG_LETTERS.items():
            out = F.replace(out, F.lit(letter), F.lit(spelled))
        return F.when(t.rlike("[^\\x00-\\x7F]"), F.regexp_replace(out, "[^\\x00-\\x7F]", "")).otherwise(t)

    return let(text, spell)


def lowercase(text: Column) -> Column:
    for name in INITIALS:
        text = F.replace(text, F.lit(" " + name), F.lit(" " + " ".join(name)))
    return F.lower(text)


def collapse_whitespace(text: Column) -> Column:
    return F.regexp_replace(text, "[ \\t\\n\\x0B\\f\\r]{2,}|[\\t\\n\\x0B\\f\\r]", " ")


def expand_abbreviations(text: Column) -> Column:
    any_of = "|".join(short for short, _ in ABBREVIATIONS)

    def expand(t: Column) -> Column:
        out = t
        for short, full in ABBREVIATIONS:
            out = F.regexp_replace(out, f"(?i)(?<![a-z0-9_]){short}\\.", full)
        return F.when(t.rlike(f"(?i)(?<![a-z0-9_])(?:{any_of})\\."), out).otherwise(t)

    return let(text, expand)


def collapse_spurious(text: Column) -> Column:
    for found, put in PUNCTUATION:
        text = F.regexp_replace(text, "[.](\\n?)\\z", "$1") if found is None else F.replace(text, F.lit(found), F.lit(put))
    return text


def replace_hits(text: Column, pattern: str, change: Callable[[Column], Column]) -> Column:
    """Replace every hit of ``pattern`` by ``change(hit)``; texts without a hit pass through untouched."""

    def joined(t: Column) -> Column:
        between, hits = F.split(t, pattern, -1), F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
        parts = F.zip_with(between, hits, lambda b, h: F.concat(b, F.coalesce(change(h), F.lit(""))))
        return F.when(t.rlike(pattern), F.array_join(parts, "")).otherwise(t)

    return let(text, joined)


def remove_number_commas(text: Column) -> Column:
    return replace_hits(text, "[0-9][0-9,]+[0-9]", lambda h: F.replace(h, F.lit(","), F.lit("")))


def expand_pounds(text: Column) -> Column:
    return F.regexp_replace(text, "£([0-9,]*[0-9]+)", "$1 pounds")


def expand_dollars(text: Column) -> Column:
    """Commas of the whole part are left out; an amount whose whole part cannot be read stays as it is."""

    def number(part: Column) -> Column:
        return part.try_cast("decimal(38,0)")

    def amounts(parts: Column) -> Column:
        whole = F.when(parts[0] == "", F.lit(0)).otherwise(number(F.replace(parts[0], F.lit(","), F.lit(""))))
        rest = F.get(parts, F.lit(1))
        cents = F.coalesce(F.when(rest != "", number(rest)), F.lit(0))
        return F.struct(F.size(parts).alias("n"), whole.alias("whole"), cents.alias("cents"))

    def spell(hit: Column) -> Column:
        def written(a: Column) -> Column:
            whole, cents = a["whole"], a["cents"]
            d = F.concat(whole.cast("string"), F.when(whole == 1, " dollar").otherwise(" dollars"))
            c = F.concat(cents.cast("string"), F.when(cents == 1, " cent").otherwise(" cents"))
            spelled = (
                F.when(a["n"] > 2, F.concat(F.substr(hit, F.lit(2)), F.lit(" dollars")))
                .when((whole > 0) & (cents > 0), F.concat(d, F.lit(", "), c))
                .when(whole > 0, d)
                .when((whole == 0) & (cents > 0), c)
                .when(whole.isNotNull(), F.lit("zero dollars"))
            )
            return F.coalesce(spelled, hit)

        return let(let(F.split(F.substr(hit, F.lit(2)), "\\.", -1), amounts), written)

    return replace_hits(text, "\\$[0-9.,]*[0-9]+", spell)


def expand_decimal_point(text: Column) -> Column:
    return F.regexp_replace(text, "([0-9]+)\\.([0-9]+)", "$1 point $2")


def number_to_words(n: Column) -> Column:
    """0 … 999999999 in words without "and"; NULL outside the range."""
    small, tens = F.array(*map(F.lit, SMALL)), F.array(*map(F.lit, TENS))

    def group(g: Column, *, scale: str) -> Column:
        h, rest = F.floor(g / 100).cast("int"), (g % 100).cast("int")
        low = F.when(rest < 20, F.when(rest > 0, F.get(small, rest))).otherwise(
            F.concat_ws(" ", F.get(tens, F.floor(rest / 10).cast("int")), F.when(rest % 10 > 0, F.get(small, rest % 10)))
        )
        hundreds = F.when(h > 0, F.concat(F.get(small, h), F.lit(" hundred")))
        return F.when(g > 0, F.concat_ws(" ", hundreds, low, *([F.lit(scale)] if scale else [])))

    def spell(v: Column) -> Column:
        groups = [let(F.floor(v / 1000**i).cast("long") % 1000, partial(group, scale=SCALES[i])) for i in (2, 1, 0)]
        spelled = F.when(v == 0, F.lit("zero")).otherwise(F.concat_ws(" ", *groups))
        return F.when((v >= 0) & (v <= LARGEST), spelled)

    return let(n.cast("long"), spell)


def unreadable_numbers(text: Column) -> Column:
    """True when the text holds an ordinal or a number beyond the largest readable one."""
    runs = F.regexp_extract_all(text, F.lit("[0-9]{10,}"), F.lit(0))
    too_big = F.exists(runs, lambda r: F.length(F.regexp_replace(r, "^0+", "")) > 9)
    return text.rlike("[0-9](?:st|nd|rd|th)") | (text.rlike("[0-9]{10,}") & too_big)


def normalize_numbers(text: Column, unreadable: str = "keep") -> Column:
    """Commas, pounds, dollars, decimal points, ordinals and cardinals, in this order.

    ``unreadable="null"`` gives NULL for texts with an ordinal or a too large number (send them to the rejects);
    ``"keep"`` reads an ordinal as its cardinal and leaves too large numbers as digits.
    """
    for step in (remove_number_commas, expand_pounds, expand_dollars, expand_decimal_point):
        text = step(text)

    def cardinal(hit: Column) -> Column:
        return F.coalesce(number_to_words(F.regexp_replace(hit, "[a-z]", "").try_cast("decimal(38,0)").try_cast("long")), hit)

    def spell(t: Column) -> Column:
        out = replace_hits(replace_hits(t, "[0-9]+(?:st|nd|rd|th)", cardinal), "[0-9]+", cardinal)
        return F.when(~unreadable_numbers(t), out) if unreadable == "null" else out

    return let(text, spell)


def identity(text: Column) -> Column:
    return text


def basic_cleaners(text: Column) -> Column:
    return collapse_whitespace(lowercase(text))


def transliteration_cleaners(text: Column) -> Column:
    return collapse_whitespace(lowercase(convert_to_ascii(text)))


def english_cleaners(text: Column, unreadable: str = "keep") -> Column:
    text = normalize_numbers(lowercase(convert_to_ascii(text)), unreadable)
    return collapse_whitespace(collapse_spurious(expand_abbreviations(text)))


def english_minimal_cleaners(text: Column, unreadable: str = "keep") -> Column:
    return collapse_whitespace(normalize_numbers(lowercase(convert_to_ascii(text)), unreadable))


CLEANERS: dict[str, Callable[[Column], Column]] = {
    "basic_cleaners": basic_cleaners,
    "transliteration_cleaners": transliteration_cleaners,
    "english_cleaners": english_cleaners,
    "english_minimal_cleaners": english_minimal_cleaners,
    "english_phone_cleaners": identity,
    "english_phone_pause_cleaners": identity,
    "convert_to_ascii": convert_to_ascii,
    "lowercase": lowercase,
    "expand_numbers": normalize_numbers,
    "expand_abbreviations": expand_abbreviations,
    "collapse_spurious": collapse_spurious,
    "collapse_whitespace": collapse_whitespace,
}


def register_cleaner(name: str, change: Callable[[Column], Column]) -> None:
    CLEANERS[name] = change


def clean(text: Column, names: list[str], more: dict[str, Callable[[Column], Column]] | None = None) -> Column:
    """The named cleaners in order; ``more`` holds those that need a table or belong to one call only."""
    known = {**CLEANERS, **(more or {})}
    for name in names:
        if name not in known:
            raise ValueError(f"unknown cleaner: {name}")
        text = known[name](text)
    return text


def strip_punctuation_for_lookup(text: Column) -> Column:
    return F.translate(text, ',;"[].!?', "")


def interior_period_to_comma(line: Column) -> Column:

    def change(t: Column) -> Column:
        body = F.substring(t, F.lit(1), F.greatest(F.length(t) - 1, F.lit(0)))
        return F.concat(F.replace(body, F.lit("."), F.lit(",")), F.substring(t, -1, 1))

    return let(line, change)


def quote_and_dash_fix(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, "‘’-", "'' "), "[^\\x00-\\x7F]", "?")


def reinsert_punctuation(phone_words: Column, text_words: Column, marks: str = "!,:?") -> Column:
    """Copy a mark at either end of a text word to its phone word when both have the same number of words."""
    phones, words = F.split(phone_words, " "), F.split(text_words, " ")

    def marked(p: Column, w: Column) -> Column:
        out = p
        for m in marks:
            out = F.when(F.substring(w, 1, 1) == m, F.concat(F.lit(m), out)).when(
                F.substring(w, -1, 1) == m, F.concat(out, F.lit(m))
            ).otherwise(out)
        return out

    joined = F.array_join(F.zip_with(phones, words, marked), " ")
    return F.when(F.size(phones) == F.size(words), joined).otherwise(phone_words)
