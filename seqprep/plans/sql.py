"""Pieces of the checking SQL. They restate the operators in another engine's words and share only fixed values."""

from __future__ import annotations

from seqprep.functions import music as M
from seqprep.functions import symbols as S
from seqprep.functions import text as T


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def words(values: list[str]) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def chain(base: str, steps: list[str], tail: str) -> str:
    """``base`` selects a column t; every step rewrites t; ``tail`` reads the table ``done``."""
    parts = [f"s0 AS ({base})"]
    parts += [f"s{i + 1} AS (SELECT * REPLACE ({e} AS t) FROM s{i})" for i, e in enumerate(steps)]
    return f"WITH {', '.join(parts)}, done AS (SELECT * FROM s{len(steps)}) {tail}"


def every(pattern: str, put: str, t: str = "t") -> str:
    return f"regexp_replace({t}, {lit(pattern)}, {lit(put)}, 'g')"


def hits(pattern: str, change: str) -> str:
    """Replace every hit h of the pattern by the SQL expression ``change``."""
    return (
        f"CASE WHEN regexp_matches(t, {lit(pattern)}) THEN array_to_string(list_transform(list_zip("
        f"string_split_regex(t, {lit(pattern)}), regexp_extract_all(t, {lit(pattern)})), "
        f"lambda z: z[1] || coalesce(list_transform([z[2]], lambda h: {change})[1], '')), '') ELSE t END"
    )


def number_words(n: str) -> str:
    small, tens = words(T.SMALL), words(T.TENS)

    def group(g: str, scale: str) -> str:
        tail = f", {lit(scale)}" if scale else ""
        return (
            f"list_transform([({g})::BIGINT], lambda g: CASE WHEN g > 0 THEN concat_ws(' ', CASE WHEN g >= 100 THEN {small}[g // 100 + 1] || ' hundred' END, "
            f"CASE WHEN g % 100 BETWEEN 1 AND 19 THEN {small}[g % 100 + 1] WHEN g % 100 >= 20 THEN concat_ws(' ', {tens}[(g % 100) // 10 + 1], "
            f"CASE WHEN g % 10 > 0 THEN {small}[g % 10 + 1] END) END{tail}) END)[1]"
        )

    groups = ", ".join(group(f"(n // {1000**i}) % 1000", T.SCALES[i]) for i in (2, 1, 0))
    return (
        f"list_transform([{n}], lambda n: CASE WHEN n = 0 THEN 'zero' WHEN n BETWEEN 1 AND {T.LARGEST} "
        f"THEN concat_ws(' ', {groups}) END)[1]"
    )


def ascii_steps() -> list[str]:
    short, base = T.letter_table()
    out = f"translate(t, {lit(short)}, {lit(base)})"
    for a, b in T.LONG_LETTERS.items():
        out = f"replace({out}, {lit(a)}, {lit(b)})"
    return [f"regexp_replace({out}, '[^\\x00-\\x7F]', '', 'g')"]


def lower_steps() -> list[str]:
    out = "t"
    for name in T.INITIALS:
        out = f"replace({out}, {lit(' ' + name)}, {lit(' ' + ' '.join(name))})"
    return [f"lower({out})"]


SPACE = [every("[ \\t\\n\\x0B\\f\\r]+", " ")]
COMMAS = [hits("[0-9][0-9,]+[0-9]", "replace(h, ',', '')")]
POUNDS = [every("£([0-9,]*[0-9]+)", "\\1 pounds")]
POINT = [every("([0-9]+)\\.([0-9]+)", "\\1 point \\2")]


def _dollars() -> list[str]:
    unit = lambda n, one: f"({n})::VARCHAR || CASE WHEN ({n}) = 1 THEN ' {one}' ELSE ' {one}s' END"
    d = "CASE WHEN p[1] = '' THEN 0 ELSE try_cast(replace(p[1], ',', '') AS HUGEINT) END"
    c = "coalesce(CASE WHEN len(p) > 1 AND p[2] <> '' THEN try_cast(p[2] AS HUGEINT) END, 0)"
    spell = (
        f"CASE WHEN len(p) > 2 THEN array_to_string(p, '.') || ' dollars' WHEN ({d}) > 0 AND ({c}) > 0 THEN {unit(d, 'dollar')} || ', ' || {unit(c, 'cent')} "
        f"WHEN ({d}) > 0 THEN {unit(d, 'dollar')} WHEN ({d}) = 0 AND ({c}) > 0 THEN {unit(c, 'cent')} WHEN ({d}) IS NOT NULL THEN 'zero dollars' END"
    )
    return [hits("\\$[0-9.,]*[0-9]+", f"coalesce(list_transform([string_split(h[2:], '.')], lambda p: {spell})[1], h)")]


DOLLARS = _dollars()
_CARDINAL = "coalesce(" + number_words("try_cast(regexp_replace(h, '[a-z]', '', 'g') AS HUGEINT)") + ", h)"
ORDINALS = [hits("[0-9]+(?:st|nd|rd|th)", _CARDINAL)]
CARDINALS = [hits("[0-9]+", _CARDINAL)]
NUMBERS = COMMAS + POUNDS + DOLLARS + POINT + ORDINALS + CARDINALS
ABBREVIATIONS = [every(f"(?i)\\b{a}\\.", b) for a, b in T.ABBREVIATIONS]
SPURIOUS = [
    "regexp_replace(t, '[.](\\n?)\\z', '\\1')" if a is None else f"replace(t, {lit(a)}, {lit(b)})" for a, b in T.PUNCTUATION
]
ASCII, LOWER = ascii_steps(), lower_steps()
ENGLISH = ASCII + LOWER + NUMBERS + ABBREVIATIONS + SPURIOUS + SPACE
MINIMAL = ASCII + LOWER + NUMBERS + SPACE

CHAR_IDS = (
    "list_transform(list_filter(string_split(regexp_replace({t}, '[^a-z!'',\\-.:? ]', '', 'g'), ''), lambda c: c <> ''), "
    f"lambda c: instr({lit(S.CHARS)}, c) + 1)"
)


def char_ids(t: str) -> str:
    return CHAR_IDS.replace("{t}", t)


def ids_of(symbols: str, kind: str) -> str:
    """Known ids of a list of symbols."""
    return f"list_filter(list_transform({symbols}, lambda s: list_position({words(S.VOCABULARY[kind])}, s) - 1), lambda i: i > 1)"


PHONE_SYMBOLS = (
    "flatten(list_transform(string_split({t}, ' '), lambda w: "
    "(CASE WHEN w <> '' AND instr('!,:?', w[1]) > 0 THEN [w[1]] ELSE [] END) || "
    "list_transform(string_split(trim(w), '@')[2:], lambda p: regexp_replace(p, '([a-z])[!,:?.;]+', '\\1', 'g')) || "
    "(CASE WHEN len(w) > 1 AND instr('!,:?', w[-1]) > 0 AND instr('!,:?', w[1]) = 0 THEN [w[-1]] ELSE [] END) || [' ']))"
)


def phone_symbols(t: str) -> str:
    return PHONE_SYMBOLS.replace("{t}", t)


def csv(values: str) -> str:
    return f"array_to_string({values}, ',')"


SIGNAL = (
    "signal AS (SELECT user_id AS utt, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, value AS x, "
    "event_id, event_type FROM events)"
)


def notes(voices: int = 2) -> str:
    return (
        f"{SIGNAL}, note AS (SELECT utt // {voices} AS piece, (utt % {voices})::INT AS voice, pos AS idx, "
        "CASE WHEN event_type = 'error' THEN 0 ELSE (48 + event_id % 25)::INT END AS pitch, "
        "[0.25, 0.5, 1.0, 2.0][event_id % 4 + 1]::DOUBLE AS dur, (event_type = 'purchase')::INT AS fermata FROM signal)"
    )


TRACE = (
    f"{SIGNAL}, trace AS (SELECT utt AS doc, pos AS idx, x, (event_id % 100)::DOUBLE AS y, (event_type = 'purchase')::INT AS eos FROM signal)"
)


def r(e: str, n: int = 6) -> str:
    return f"(round({e}, {n}) + 0.0)"


INTERVAL_NAMES = words(M.INTERVALS)


def interval(a: str, b: str) -> str:
    d = f"(({a}) - ({b}))"
    return (
        f"CASE WHEN abs({d}) <= 28 THEN (CASE WHEN {d} < 0 THEN '-' ELSE '' END) || {INTERVAL_NAMES}[abs({d}) + 1] "
        f"WHEN ({a}) = 0 OR ({b}) = 0 THEN 'RP1' END"
    )


def consonant(i: str) -> str:
    names = ", ".join(lit(v) for v in [*M.CONSONANT, *["-" + c for c in M.CONSONANT], M.REST_INTERVAL])
    return f"({i} IN ({names}))"


def perfect(i: str) -> str:
    names = ", ".join(lit(v) for v in [*M.PERFECT, *["-" + c for c in M.PERFECT]])
    return f"({i} IN ({names}))"


def note_name(p: str) -> str:
    return f"CASE WHEN {p} = 0 THEN 'R' ELSE {words(M.NOTE_CLASSES)}[({p}) % 12 + 1] || (({p}) // 12 - 1)::VARCHAR END"


def motion(a: str, b: str) -> str:
    return (
        f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN 'START' WHEN {a} = 0 OR {b} = 0 THEN 'OBLIQUE' WHEN {a} = {b} THEN 'DIRECT' "
        f"WHEN sign({a}) <> sign({b}) THEN 'CONTRARY' ELSE 'SIMILAR' END"
    )
