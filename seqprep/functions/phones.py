"""Pronunciation by letter rules and hyphenation by patterns.

Rule and pattern tables are inputs (DataFrames of any size), never part of the package. A table that is measured to fit
is broadcast to a small Arrow-batched kernel that sees each distinct word once: letter rules under their centers, hyphen
patterns as an automaton. A larger table is joined: rules with the places of distinct words by center, patterns with the
substrings of distinct words. Both ways give the same result.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqprep.operators.blocks import byte_size, lookup_join, salted_join, with_row

# Letter classes used by the context symbols of the rules.
VOWELS = "AEIOUY"
CONSONANTS = "BCDFGHJKLMNPQRSTVWXZ"
VOICED = "BDVGJLMNRWZ"
CONTEXT = {
    "#": f"[{VOWELS}]+",
    "*": f"[{CONSONANTS}]+",
    ",": f"[{VOICED}]",
    "$": f"[{CONSONANTS}][EI]",
    "%": "(?:ER|E|ES|ED|ING|ELY)",
    "&": "(?:S|C|G|Z|X|J|CH|SH)",
    "@": "(?:T|S|R|D|L|Z|N|J|TH|CH|SH)",
    "^": f"[{CONSONANTS}]",
    "+": "[EIY]",
    ":": f"[{CONSONANTS}]*",
}
TABLE_BYTES = 64 << 20
LINES = 512


def parse_letter_rules(lines: DataFrame) -> DataFrame:
    """lines(line_no, value) like ``#:[ALLY]=/AX L IY/;`` to rules(rank, before, center, after, phones)."""
    hit = "^(.*?)\\[(.*?)\\](.*?)=/(.*)/;?\\s*$"
    part = lambda i: F.regexp_extract("value", hit, i)
    return lines.where(F.col("value").rlike(hit)).select(
        F.col("line_no").alias("rank"), F.ltrim(part(1)).alias("before"), part(2).alias("center"),
        F.rtrim(part(3)).alias("after"), part(4).alias("phones"),
    )


def table_bytes(table: DataFrame) -> int:
    """Measured size of the rows of a table."""
    width = sum((byte_size(F.col(f"`{f.name}`"), f.dataType) for f in table.schema.fields), F.lit(16))
    return table.agg(F.coalesce(F.sum(width), F.lit(0))).first()[0]


def shared_rules(rules: DataFrame):
    rows = [(r["before"], r["center"], r["after"], r["phones"]) for r in sorted(rules.collect(), key=lambda r: r["rank"])]
    return rules.sparkSession.sparkContext.broadcast(rows)


def _kernel(rules: DataFrame) -> Callable[[Column], Column]:
    """Phones of a word by rules broadcast to the tasks."""
    shared = shared_rules(rules)

    @F.arrow_udf("array<string>")
    def kernel(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        centers = Centers(shared.value)
        for batch in batches:
            known: dict = {None: None}
            spell = lambda w: known[w] if w in known else known.setdefault(w, walk(w, centers))
            yield pa.array([spell(w) for w in batch.to_pylist()], pa.list_(pa.string()))

    return kernel


def _line_kernel(rules: DataFrame) -> Callable[[Column], Column]:
    """Phones of the words of an array as one text, words that no rules spell left out.

    Only distinct words of a slice become Python values, whatever the length of the texts.
    """
    shared = shared_rules(rules)

    def spelled(lists: pa.Array, centers: Centers) -> pa.Array:
        words = lists.flatten().dictionary_encode()
        distinct = [None if p is None else "&".join(p) for w in words.dictionary.to_pylist() for p in [walk(w, centers)]]
        texts = pa.array(distinct, pa.string()).take(words.indices)
        kept = np.append(0, np.cumsum(texts.is_valid().to_numpy(zero_copy_only=False)))
        ends = np.append(0, np.cumsum(pc.fill_null(lists.value_lengths(), 0).to_numpy()))
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(kept[ends].astype(np.int32)), texts.drop_null()), "^")
        return pc.if_else(lists.is_valid(), joined, pa.scalar(None, pa.string()))

    @F.arrow_udf("string")
    def kernel(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        centers = Centers(shared.value)
        for batch in batches:
            parts = [spelled(batch.slice(at, LINES), centers) for at in range(0, len(batch), LINES)]
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return kernel


class Centers:
    """A trie of the rules' centers: at a place of a word, the rules of all centers that stand there, by rank. Built once per task."""

    def __init__(self, table: list):
        self.root, self.longest, self.seen = {}, 0, {}
        pattern = lambda s: re.compile("".join(CONTEXT.get(c, re.escape(c)) for c in s))
        for rank, (before, center, after, phones) in enumerate(table):
            node = self.root
            for c in center:
                node = node.setdefault(c, {})
            loose = any(c in CONTEXT for c in before + center + after)
            tests = (pattern(before).match if before else None, pattern(after).match if after else None) if loose else (None, None)
            node.setdefault("", []).append((rank, len(center), loose, before, after, *tests, phones))
            self.longest = max(self.longest, len(center))

    def at(self, letters: str) -> list:
        """The rules that may apply to a word whose rest begins with ``letters``; an empty center never does."""
        if letters not in self.seen:
            node, found = self.root, []
            for c in letters:
                node = node.get(c)
                if node is None:
                    break
                found += node.get("", [])
            if len(self.seen) > 100_000:
                self.seen.clear()
            self.seen[letters] = sorted(found, key=lambda r: r[0])
        return self.seen[letters]


def walk(word: str, centers: Centers) -> list | None:
    out, at, size = [], 0, len(word)
    while at < size:
        for _, n, loose, before, after, before_at, after_at, phones in centers.at(word[at : at + centers.longest]):
            if before:
                left = word[max(at - len(before), 0) : at]
                if not (before_at(left) if loose else left == before):
                    continue
            if after and not (after_at(word[at + n :]) if loose else word[at + n :] == after):
                continue
            out.append(phones)
            at += n
            break
        else:
            return None
    return out


def rule_g2p(words: DataFrame, rules: DataFrame, word: str = "word", max_bytes: int = TABLE_BYTES) -> DataFrame:
    """phones(array) of each distinct word: one entry per applied rule, NULL if some letter has no rule.

    At each place the first matching rule is applied and the place moves by the rule's center. A rule without context
    symbols wants the exact letters before and the exact rest after; with context symbols the pieces are patterns.
    Rules of more than ``max_bytes`` are joined with the places of the words by center.
    """
    distinct = words.select(word).distinct()
    if table_bytes(rules) <= max_bytes:
        return distinct.withColumn("phones", _kernel(rules)(F.upper(F.col(word))))
    return _joined_g2p(distinct, rules, word)


def _pattern(letters: str) -> Column:
    """The regular expression of a rule's context."""
    table = F.create_map(*[F.lit(v) for pair in CONTEXT.items() for v in pair])
    chars = F.filter(F.split(letters, ""), lambda c: c != "")
    quoted = F.transform(chars, lambda c: F.coalesce(F.element_at(table, c), F.concat(F.lit("\\Q"), c, F.lit("\\E"))))
    return F.concat(F.lit("^(?:"), F.array_join(quoted, ""), F.lit(")"))


def _joined_g2p(distinct: DataFrame, rules: DataFrame, word: str) -> DataFrame:
    loose = F.concat("before", "center", "after").rlike("[" + re.escape("".join(CONTEXT)) + "]")
    table = rules.where("center <> ''").select(
        "rank", "center", "before", "after", "phones", loose.alias("_loose"), _pattern("before").alias("_before"), _pattern("after").alias("_after")
    )
    longest = table.agg(F.max(F.length("center")).alias("_longest"))
    x = with_row(distinct.select(word, F.upper(word).alias("_w")), longest)
    x = x.withColumn("_at", F.explode(F.expr("if(length(_w) > 0, sequence(0, length(_w) - 1), cast(array() as array<int>))")))
    x = x.withColumn("_n", F.explode(F.expr("sequence(1, least(_longest, length(_w) - _at))"))).withColumn("center", F.expr("substring(_w, _at + 1, _n)"))
    x = salted_join(x, table, ["center"])
    left, right = F.expr("substring(_w, greatest(_at - length(before), 0) + 1, least(length(before), _at))"), F.expr("substring(_w, _at + _n + 1)")
    fits = F.when(
        F.col("_loose"), ((F.col("before") == "") | F.rlike(left, F.col("_before"))) & ((F.col("after") == "") | F.rlike(right, F.col("_after")))
    ).otherwise(((F.col("before") == "") | (left == F.col("before"))) & ((F.col("after") == "") | (right == F.col("after"))))
    first = x.where(fits).groupBy(word, "_at").agg(F.min(F.struct("rank", "_n", "phones")).alias("_r"))
    steps = first.groupBy(word).agg(F.map_from_entries(F.collect_list(F.struct("_at", "_r"))).alias("_steps"))
    start = F.struct(F.lit(0).alias("next"), F.array().cast("array<string>").alias("out"))

    def move(state: Column, at: Column) -> Column:
        step = F.element_at("_steps", at)
        moved = F.struct((at + step["_n"]).alias("next"), F.concat(state["out"], F.array(step["phones"])).alias("out"))
        return F.when((state["next"] == at) & step.isNotNull(), moved).otherwise(state)

    size = F.length(F.upper(word))
    walked = F.aggregate(F.sequence(F.lit(0), size - 1), start, move)
    out = distinct.join(steps, word, "left").withColumn("_walk", F.when((size > 0) & F.col("_steps").isNotNull(), walked))
    phones = F.when(size == 0, F.array().cast("array<string>")).when(F.col("_walk.next") == size, F.col("_walk.out"))
    return out.select(word, phones.alias("phones"))


def rule_line_words(text: Column) -> Column:
    """Words of a line for letter rules: marks stand alone, outer quotes and dashes go, upper case."""
    t = F.translate(text, '"[]', "")
    for mark, put in ((".", " . "), ("!", " ! "), ("?", " ? "), (",", " , "), (";", " , "), (":", " , ")):
        t = F.replace(t, F.lit(mark), F.lit(put))
    t = F.regexp_replace(F.regexp_replace(t, "^'", ""), "'$", "")
    words = F.filter(F.split(F.upper(t), " "), lambda w: w != "")
    trimmed = F.transform(words, lambda w: F.regexp_replace(F.regexp_replace(w, "^'?-?", ""), "-?'?$", ""))
    return F.filter(trimmed, lambda w: w != "")


def rulebased_g2p(df: DataFrame, key: str, text: str, rules: DataFrame, out: str = "phones", max_bytes: int = TABLE_BYTES) -> DataFrame:
    """The rows with the letter-rule phones of ``text`` (``rulebased_cleaner``); ``key`` identifies a row.

    Rules of more than ``max_bytes`` are applied to the distinct words of all texts, which join back.
    """
    if table_bytes(rules) <= max_bytes:
        return df.select("*", rulebased_cleaner(rules)(F.col(text)).alias(out))
    words = df.select(key, F.posexplode(rule_line_words(F.col(text))).alias("_i", "word"))
    spelled = rule_g2p(words, rules, "word", max_bytes).where("phones is not null").select("word", F.array_join("phones", "&").alias("_p"))
    lines = lookup_join(words, spelled, ["word"], "inner").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_i", "_p")))["_p"].alias("_p"))
    joined = F.lower(F.array_join(F.coalesce("_p", F.array().cast("array<string>")), "^"))
    return df.join(lines, key, "left").select(*df.columns, F.when(F.col(text).isNotNull(), joined).alias(out))


def rulebased_cleaner(rules: DataFrame) -> Callable[[Column], Column]:
    """A cleaner: letter-rule phones of every word joined by ``&``, words joined by ``^``, lower case.

    The words of a text stay together as an array: no shuffle, and a frequent word is spelled once per slice of an Arrow batch.
    A null text has null phones. Pass it to ``text.clean`` by name: ``more={"rulebased_g2p_cleaners": rulebased_cleaner(rules)}``.
    A cleaner is a column, which cannot be joined, so its rules are broadcast: ``rulebased_g2p`` takes tables beyond that.
    """
    kernel = _line_kernel(rules)
    return lambda text: F.lower(kernel(rule_line_words(text)))


def parse_hyphen_patterns(patterns: DataFrame, pattern: str = "pattern") -> DataFrame:
    """``a1bc3d4`` to letters ``abcd`` and points at offsets: (letters, at, value), one row per non-zero point."""
    p = F.col(pattern)
    slots = F.split(F.regexp_replace(p, "([.a-z])", "|"), "\\|")
    return patterns.select(F.regexp_replace(p, "[0-9]", "").alias("letters"), F.posexplode(slots).alias("at", "v")).where(
        "v <> ''"
    ).select("letters", "at", F.col("v").cast("int").alias("value"))


def hyphenate(
    words: DataFrame, patterns: DataFrame, exceptions: DataFrame | None = None, word: str = "word", max_bytes: int = TABLE_BYTES
) -> DataFrame:
    """pieces(array) of each distinct word.

    ``patterns`` is the parsed table; ``exceptions(word, pieces)`` wins over patterns. Words of up to four letters stay
    whole, no break falls in the first two or last two places, an odd maximum point is a break. Patterns of more than
    ``max_bytes`` are joined with the substrings of the words; others go through each word as an automaton.
    """
    vocabulary = words.select(word).distinct()
    if table_bytes(patterns) <= max_bytes:
        out = vocabulary.withColumn("_breaks", F.when(F.length(word) > 4, _automaton(patterns)(F.lower(word))))
    else:
        out = vocabulary.join(_joined_breaks(vocabulary, patterns, word), word, "left")
    # point p of ".word." stands before letter p of the word; the ends carry no break
    out = out.withColumn(
        "_cuts",
        F.concat(
            F.array(F.lit(0)),
            F.coalesce(
                F.transform(F.filter("_breaks", lambda p: (p > 2) & (p <= F.length(word) - 1)), lambda p: p - 1),
                F.array().cast("array<int>"),
            ),
            F.array(F.length(word)),
        ),
    )
    cut = F.transform(
        F.sequence(F.lit(1), F.size("_cuts") - 1),
        lambda i: F.substring(F.col(word), F.get("_cuts", i - 1) + 1, F.get("_cuts", i) - F.get("_cuts", i - 1)),
    )
    out = out.select(word, cut.alias("pieces"))
    if exceptions is not None:
        listed = exceptions.select(F.lower(F.col("word")).alias("_w"), F.col("pieces").alias("_x"))
        out = lookup_join(out.withColumn("_w", F.lower(word)), listed, ["_w"], "left").select(
            word, F.when(F.length(word) > 4, F.coalesce("_x", "pieces")).otherwise(F.col("pieces")).alias("pieces")
        )
    return out


def pattern_automaton(rows: list[tuple[str, int, int]]) -> tuple[list[dict], list[int], list[list]]:
    """Aho-Corasick over the letters of patterns: moves, fallbacks and, per state, (offset from the end, value) of all patterns that end there."""
    moves, found = [{}], [[]]
    for letters, at, value in rows:
        state = 0
        for c in letters:
            if c not in moves[state]:
                moves[state][c] = len(moves)
                moves.append({}), found.append([])
            state = moves[state][c]
        found[state].append((at - len(letters), value))
    back, queue = [0] * len(moves), list(moves[0].values())
    for state in queue:
        found[state] = found[state] + found[back[state]]
        for c, to in moves[state].items():
            other = back[state]
            while other and c not in moves[other]:
                other = back[other]
            back[to] = moves[other].get(c, 0)
            queue.append(to)
    return moves, back, found


def break_points(word: str, automaton: tuple) -> list[int]:
    """Places of ``.word.`` whose largest point is odd."""
    moves, back, found = automaton
    state, points = 0, {}
    for end, c in enumerate(f".{word}.", 1):
        while state and c not in moves[state]:
            state = back[state]
        state = moves[state].get(c, 0)
        for offset, value in found[state]:
            points[end + offset] = max(points.get(end + offset, 0), value)
    return sorted(p for p, v in points.items() if v % 2)


def _automaton(patterns: DataFrame) -> Callable[[Column], Column]:
    rows = [tuple(r) for r in patterns.select("letters", "at", "value").collect()]
    shared = patterns.sparkSession.sparkContext.broadcast(rows)

    @F.arrow_udf("array<int>")
    def kernel(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = pattern_automaton(shared.value)
        for words in batches:
            yield pa.array([None if w is None else break_points(w, automaton) for w in words.to_pylist()], pa.list_(pa.int32()))

    return kernel


def _joined_breaks(vocabulary: DataFrame, patterns: DataFrame, word: str) -> DataFrame:
    """(word, _breaks) by a join of the patterns with all substrings as long as one."""
    longest = patterns.agg(F.max(F.length("letters")).alias("longest"))
    dotted = vocabulary.where(F.length(word) > 4).select(word, F.concat(F.lit("."), F.lower(word), F.lit(".")).alias("_d"))
    pieces = (
        with_row(dotted, longest)
        .withColumn("_i", F.explode(F.expr("sequence(0, length(_d) - 1)")))
        .withColumn("_n", F.explode(F.expr("sequence(1, least(longest, length(_d) - _i))")))
        .select(word, "_i", F.substring("_d", F.col("_i") + 1, F.col("_n")).alias("letters"))
    )
    points = salted_join(pieces, patterns, ["letters"]).groupBy(word, (F.col("_i") + F.col("at")).alias("_p")).agg(F.max("value").alias("value"))
    return points.where("value % 2 = 1").groupBy(word).agg(F.sort_array(F.collect_list("_p")).alias("_breaks"))


def first_pronunciation(lexicon: DataFrame) -> DataFrame:
    """word, phones as ``@hh@ah``: the first pronunciation without stress digits."""
    phone = lambda p: F.lower(F.concat(F.lit("@"), F.when(p.rlike("[012]"), F.regexp_replace(p, ".$", "")).otherwise(p)))
    return lexicon.select("word", F.array_join(F.transform(F.get("prons", F.lit(0)), phone), "").alias("phones"))


def lookup_pronunciation(words: DataFrame, lexicon: DataFrame, raw: str = "raw_word", clean: str = "word") -> DataFrame:
    """Try the raw word, then the cleaned word, else NULL."""
    lex = first_pronunciation(lexicon)
    by_raw = lex.select(F.col("word").alias(raw), F.col("phones").alias("_raw"))
    by_clean = lex.select(F.col("word").alias(clean), F.col("phones").alias("_clean"))
    out = lookup_join(lookup_join(words, by_raw, [raw]), by_clean, [clean])
    return out.withColumn("phones", F.coalesce("_raw", "_clean")).drop("_raw", "_clean")
