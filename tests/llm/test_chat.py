"""Chat formatting against a fold that goes through the events one by one."""

import random

import pytest
from pyspark.sql import functions as F

from seqprep.llm.chat import Template, escape, fold, format_chats, read_turns, render, turn_log, under_loss, unescape

SCHEMA = "conv_id long, seq long, message string, kind string, role string, text string, conv string, turn string, _e string"
ORDER = {"open": 0, "regenerate": 1, "edit": 2, "delta": 3}
PIECES = ["", "a", "b ", "</s>", "[INST]", "[/INST]", "\\", "[\\INST]", "<\\\\/s>", "<s", ">", "[ROLE]x[TEXT]", "é\n", "[", "<"]


def one_by_one(events):
    """Final (role, text) of each message of one conversation, in order."""
    live = []
    for seq, _, kind, role, text, message in sorted((s, ORDER[k], k, r or "", t or "", m) for s, m, k, r, t in events):
        mine = [x for x in live if x["id"] == message]
        if kind == "open" or not mine:
            live.append({"id": message, "opened": seq, "role": "", "text": "", "dead": False})
            mine = [live[-1]]
        x = mine[-1]
        x["role"] = x["role"] or role
        if kind == "regenerate":
            x["text"] = ""
            for y in live:
                if (x["opened"], x["id"]) < (y["opened"], y["id"]) and y["opened"] < seq:
                    y["dead"] = True
        else:
            x["text"] = text if kind == "edit" else x["text"] + text
    return [(x["role"], x["text"]) for x in sorted(live, key=lambda x: (x["opened"], x["id"])) if not x["dead"]]


def random_log(seed, n):
    r = random.Random(seed)
    ids, out = [], []
    for seq in range(n):
        kind = r.choices(["open", "delta", "edit", "regenerate"], [3, 5, 1, 1])[0] if ids else "open"
        if kind == "open":
            ids.append(f"m{len(ids):03d}")
        message = ids[-1] if kind == "open" or r.random() < 0.7 else r.choice(ids)
        role = r.choice(["user", "assistant", "system", "tool[TEXT]", "User"]) if kind == "open" else None
        text = None if kind == "regenerate" else "".join(r.choice(PIECES) for _ in range(r.randint(0, 4)))
        out.append((seq, message, kind, role, text))
    return out


def read(spark, rows):
    log = spark.createDataFrame([(c, *e, "x", "y", "z") for c, e in rows], SCHEMA).repartition(5)
    x = format_chats(log)
    got = x.select("conv_id", read_turns(F.col("formatted")).alias("t"), under_loss(F.col("turns"), F.col("loss")).alias("l"), "formatted", "turns").collect()
    assert all("".join(r.turns) == r.formatted for r in got)
    assert len({r.conv_id for r in got}) == len(got)
    return {r.conv_id: ([(t.role, t.text) for t in r.t], r.l) for r in got}


def test_fold_against_events_one_by_one(spark):
    logs = {c: random_log(c, 5 + 12 * c) for c in range(12)}
    got = read(spark, [(c, e) for c, log in logs.items() for e in log])
    for c, log in logs.items():
        want = one_by_one(log)
        assert got[c][0] == want
        assert got[c][1] == "".join(t for r, t in want if r == "assistant")
    assert any(e[2] == "regenerate" for e in logs[11])


def test_odd_rows(spark):
    rows = [
        (None, (0, "a", "open", "user", "null conversation")), (None, (1, "b", "open", "assistant", None)), (None, (2, "a", "regenerate", None, None)),
        (1, (0, None, "open", None, "no id, no role")), (1, (0, None, "open", None, "no id, no role")),
        (2, (None, "b", "open", "user", "no number")), (2, (0, "a", "delta", None, "late")), (3, (4, "a", "open", "assistant", "word " * 200_000)),
    ]
    got = read(spark, rows)
    assert got[None] == ([("user", "")], "")
    assert got[1] == ([("", "no id, no role")] * 2, "")
    assert got[2] == ([("user", "no number"), ("", "late")], "")
    assert got[3] == ([("assistant", "word " * 200_000)], "word " * 200_000)
    assert read(spark, []) == {}


def test_unknown_kind_fails(spark):
    with pytest.raises(Exception, match="unknown kind of event: undo"):
        read(spark, [(1, (0, "a", "undo", None, None))])


def test_one_conversation_holds_most_events(spark):
    log = [(7, e) for e in random_log(99, 4000)] + [(c, (0, "a", "open", "user", "hi")) for c in range(100, 140)]
    got = read(spark, log)
    assert got[7][0] == one_by_one([e for c, e in log if c == 7]) and len(got) == 41


def test_escapes_are_reversible(spark):
    r = random.Random(3)
    texts = ["".join(r.choice(PIECES) for _ in range(r.randint(0, 12))) for _ in range(400)]
    t = Template()
    x = spark.createDataFrame([(s,) for s in texts], "s string").select("s", escape(F.col("s"), t).alias("e")).withColumn("u", unescape(F.col("e"), t))
    for row in x.collect():
        assert row.u == row.s and not any(m in row.e for m in t.marks())


def test_spans_and_own_template(spark):
    t = Template({"user": ("[Q]", "[/Q]"), "assistant": ("[A]", "[/A]")}, ("[O]", "[T]", "[/O]"), ("user", "assistant"))
    turns = spark.createDataFrame([(1, 1, "assistant", "x[A]"), (1, 0, "user", "é"), (1, 2, "none", "y")], "conv_id long, turn long, role string, text string")
    r = format_chats(turn_log(turns), t).first()
    assert r.formatted == "[Q]é[/Q][A]x[\\A][/A][O]none[T]y[/O]"
    assert [tuple(s) for s in r.loss] == [(0, 3, 1), (1, 3, 5)]
    pieces = render(fold(turn_log(turns)), t).orderBy("opened").collect()
    assert [p.turn for p in pieces] == r.turns and pieces[2].start is None
