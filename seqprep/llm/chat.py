"""Chat formatting from an event log: streamed deltas, edits and regenerations fold into messages, messages into training text.

A log is a table of events (conversation, sequence number, message id, kind, role, text), in any order of rows:

* ``open``        starts the message with its role and first text
* ``delta``       adds to its text
* ``edit``        replaces its text so far
* ``regenerate``  empties it and discards every message opened between it and this event

Everything is DataFrame functions. Events shuffle by (conversation, message), so the drafts of a long conversation are
folded apart and only final messages meet in its one output row, which must fit a value of Spark. Which messages were
discarded is a running maximum over blocks of sequence numbers, worked out only for conversations with a regeneration.

Results of odd input: events of one sequence number go open, regenerate, edit, delta, then by role and text; a second
``open`` of an id starts another message, so repeated rows are repeated turns; events without an ``open`` begin a
message at the first of them; messages of one sequence number go by id, then by role and text. A null text is empty, a
null role is the empty role, null sequence numbers come first, null conversations are one conversation, null ids one id.
An unknown kind fails the job. An empty log gives no rows. Other columns of the log, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqprep.functions.text import let
from seqprep.operators.blocks import BLOCK, running

KINDS = ["open", "regenerate", "edit", "delta"]
FIRST = -(1 << 63)


@dataclass(frozen=True)
class Template:
    """Marks around the turns of each role, those of any other role with its name between, and the roles under the loss.

    Every mark begins with one of ``[`` and ``<``, which no mark has at a later place, so marks cannot overlap.
    """

    turns: dict = field(default_factory=lambda: {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("[SYS]", "[/SYS]")})
    other: tuple = ("[ROLE]", "[TEXT]", "[/ROLE]")
    loss: tuple = ("assistant",)

    def marks(self) -> list[str]:
        return [m for pair in self.turns.values() for m in pair] + list(self.other)

    def closes(self) -> list[str]:
        return [close for _, close in self.turns.values()] + [self.other[2]]


def _tails(template: Template) -> str:
    return "|".join(re.escape(m[1:]) for m in template.marks())


def escape(text: Column, template: Template) -> Column:
    """One more backslash behind the first character of every mark inside a text, so no mark is left in it."""
    return F.regexp_replace(text, rf"([\[<])(\\*(?:{_tails(template)}))", r"$1\\$2")


def unescape(text: Column, template: Template) -> Column:
    return F.regexp_replace(text, rf"([\[<])\\(\\*(?:{_tails(template)}))", "$1$2")


def _segments(events: Column) -> Column:
    """The events of an id cut before each ``open`` but the first."""
    def cut(e: Column) -> Column:
        starts = F.filter(F.transform(e, lambda x, i: F.when((i == 0) | (x["rank"] == 0), i)), lambda i: i.isNotNull())
        ends = lambda s, i: F.coalesce(F.get(s, i + 1), F.size(e))
        return let(starts, lambda s: F.transform(s, lambda a, i: F.slice(e, a + 1, ends(s, i) - a)))

    return let(F.sort_array(events), cut)


def _text(events: Column) -> Column:
    """Texts from the last edit or regeneration on, joined."""
    resets = F.array_max(F.transform(events, lambda x, i: F.when(x["rank"].isin(1, 2), i).otherwise(F.lit(0))))
    kept = F.slice(events, resets + 1, F.size(events))
    return F.array_join(F.transform(kept, lambda x: F.when(x["rank"] == 1, F.lit("")).otherwise(F.coalesce(x["text"], F.lit("")))), "")


def fold(log: DataFrame, conv: str = "conv_id", seq: str = "seq", message: str = "message", kind: str = "kind", role: str = "role", text: str = "text") -> DataFrame:
    """messages(conv struct, id struct, place, opened, role, text): the messages that are left, one row each."""
    rank = F.coalesce(
        *[F.when(F.col(kind) == k, F.lit(i)) for i, k in enumerate(KINDS)], F.raise_error(F.concat(F.lit("unknown kind of event: "), F.coalesce(kind, F.lit("null")))).cast("int")
    )
    # ids wrapped in structs are never null, so they group and join like any value
    x = log.select(
        F.struct(F.col(conv).alias("v")).alias("conv"), F.struct(F.col(message).alias("v")).alias("id"),
        F.coalesce(F.col(seq).cast("long"), F.lit(FIRST)).alias("seq"), rank.alias("rank"), F.col(role).alias("role"), F.col(text).alias("text"),
    )
    parts = x.groupBy("conv", "id").agg(F.collect_list(F.struct("seq", "rank", "role", "text")).alias("_e"))
    parts = parts.select("conv", "id", F.posexplode(_segments(F.col("_e"))).alias("place", "_e"))
    named = F.get(F.filter("_e", lambda e: e["role"].isNotNull()), F.lit(0))["role"]
    messages = parts.select("conv", "id", "place", F.get("_e", F.lit(0))["seq"].alias("opened"), named.alias("role"), _text(F.col("_e")).alias("text"))
    return messages.join(_discarded(x), ["conv", "id", "place"], "left_anti")


def _discarded(x: DataFrame) -> DataFrame:
    """(conv, id, place) of messages opened after another one and before its regeneration."""
    touched = x.where("rank = 1").select("conv").distinct()
    y = x.join(touched, "conv", "left_semi").groupBy("conv", "id").agg(F.collect_list(F.struct("seq", "rank")).alias("_e"))
    y = y.select("conv", "id", F.posexplode(_segments(F.col("_e"))).alias("place", "_e"))
    again = F.array_max(F.transform(F.filter("_e", lambda e: e["rank"] == 1), lambda e: e["seq"]))
    y = y.select("conv", "id", "place", F.get("_e", F.lit(0))["seq"].alias("opened"), again.alias("again"))
    order = ("opened", "id", "place")
    y = running(y, ["conv"], {"cut": ("max", F.col("again"))}, order, inclusive=False, blk=F.expr(f"opened div {BLOCK}"))
    return y.where("cut > opened").select("conv", "id", "place")


def render(messages: DataFrame, template: Template = Template()) -> DataFrame:
    """messages with ``turn``, the marked and escaped text, and ``start``, ``length`` of its part under the loss in code points (null outside)."""
    name = F.coalesce("role", F.lit(""))
    body = escape(F.col("text"), template)
    a, b, c = template.other
    opening = F.concat(F.lit(a), escape(name, template), F.lit(b))
    closing = F.lit(c)
    for role, (before, after) in template.turns.items():
        opening, closing = F.when(name == role, F.lit(before)).otherwise(opening), F.when(name == role, F.lit(after)).otherwise(closing)
    x = messages.withColumns({"_open": opening, "_body": body, "_close": closing})
    learned = name.isin(*template.loss)
    return x.withColumns({
        "turn": F.concat("_open", "_body", "_close"), "start": F.when(learned, F.char_length("_open")), "length": F.when(learned, F.char_length("_body")),
    }).drop("_open", "_body", "_close")


def format_chats(log: DataFrame, template: Template = Template(), **columns: str) -> DataFrame:
    """(conv_id, turns, loss, formatted) per conversation: its turns in order, the spans (turn, start, length) under the loss, and all turns joined."""
    x = render(fold(log, **columns), template)
    rows = F.sort_array(F.collect_list(F.struct("opened", "id", "place", "role", "turn", "start", "length")))
    x = x.groupBy("conv").agg(rows.alias("_m"))
    spans = F.transform("_m", lambda m, i: F.when(m["start"].isNotNull(), F.struct(i.alias("turn"), m["start"].alias("start"), m["length"].alias("length"))))
    x = x.select(F.col("conv.v").alias(columns.get("conv", "conv_id")), F.col("_m.turn").alias("turns"), F.filter(spans, lambda s: s.isNotNull()).alias("loss"))
    return x.withColumn("formatted", F.array_join("turns", ""))


def read_turns(formatted: Column, template: Template = Template()) -> Column:
    """array of (role, text) parsed from formatted text."""
    pieces = F.split(formatted, "|".join(re.escape(c) for c in template.closes()), -1)
    a, b, _ = template.other

    def turn(p: Column) -> Column:
        rest = F.substr(p, F.lit(len(a) + 1))
        # a role holds no mark, so the first one ends it
        at = F.instr(rest, b)
        role, text = F.substr(rest, F.lit(1), at - 1), F.substr(rest, at + len(b))
        for name, (before, _) in template.turns.items():
            own = F.startswith(p, F.lit(before))
            role, text = F.when(own, F.lit(name)).otherwise(role), F.when(own, F.substr(p, F.lit(len(before) + 1))).otherwise(text)
        return F.struct(unescape(role, template).alias("role"), unescape(text, template).alias("text"))

    return let(pieces, lambda p: F.transform(F.slice(p, F.lit(1), F.size(p) - 1), turn))


def under_loss(turns: Column, loss: Column, template: Template = Template()) -> Column:
    """The unescaped texts under the loss spans, joined."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substr(F.get(turns, s["turn"]), s["start"] + 1, s["length"]), template)), "")


def turn_log(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A log of finished turns: one ``open`` each."""
    return turns.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("seq"), F.col(turn).alias("message"), F.lit("open").alias("kind"), F.col(role).alias("role"), F.col(text).alias("text")
    )
