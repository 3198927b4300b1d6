"""Chat formatting: exact round trips, and the fold of each kind of event."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from lectern.llm.chat_format import Conversation, escape, format_chats, parse, read_back, turn_events, unescape

PIECES = st.lists(st.sampled_from(["<|im_start|>", "<|im_end|>", "<|", "\\", "im_end|>", "a", "\n", "<|\\im_end|>", "é"]), max_size=12).map("".join)


@given(PIECES)
@settings(max_examples=300, deadline=None)
def test_escape_is_reversible(text):
    assert unescape(escape(text)) == text
    assert "<|im_end|>" not in escape(text)
    assert "<|im_start|>" not in escape(text)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "odd\nrole", "<|im_end|>"]), PIECES), max_size=6))
@settings(max_examples=200, deadline=None)
def test_render_round_trip(turns):
    c = Conversation()
    for i, (role, text) in enumerate(turns):
        c.fold("open", str(i), role, None)
        c.fold("delta", str(i), None, text[:2])
        c.fold("delta", str(i), None, text[2:])
    formatted, spans = c.render("assistant")
    assert parse(formatted) == turns
    assert [unescape(formatted[a:b]) for a, b in zip(spans[::2], spans[1::2])] == [t for r, t in turns if r == "assistant"]


def events(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, seq long, kind string, message string, role string, text string, formatted string")


def test_edits_regenerations_and_deletes(spark):
    log = [
        (1, 5, "delta", "b", None, "lo", "x"), (1, 1, "open", "a", "user", "hi", "x"), (1, 3, "open", "b", "assistant", None, "x"), (1, 4, "delta", "b", None, "hel", "x"),
        (1, 2, "edit", "a", None, "hey", "x"), (1, 6, "open", "c", "user", "more", "x"), (1, 7, "regenerate", "b", None, None, "x"), (1, 8, "delta", "b", None, "new", "x"),
        (1, 9, "open", "d", "user", "gone", "x"), (1, 10, "delete", "d", None, None, "x"), (1, 11, "delta", "nobody", None, "lost", "x"), (2, 1, None, "a", "user", "no kind", "x"), (3, 1, "open", "a", None, None, "x"),
    ]
    got = {r["conv_id"]: parse(r["formatted"]) for r in format_chats(events(spark, log)).collect()}
    assert got == {1: [("user", "hey"), ("assistant", "new")], 3: [("", "")]}


def test_turns_with_nulls_ties_and_repeats(spark):
    rows = [(1, 0, "user", None, "z"), (1, 0, "user", None, "z"), (1, 1, "assistant", "a\\b", "z"), (None, None, None, "t", "z"), (2, 3, "assistant", "x" * 30_000, "z")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, message string")
    got = {r["conv_id"]: r for r in read_back(format_chats(turn_events(turns))).collect()}
    assert {k: (r["n_turns"], r["loss_chars"]) for k, r in got.items()} == {1: (3, 3), None: (1, 0), 2: (1, 30_000)}
    assert read_back(format_chats(turn_events(turns.limit(0)))).count() == 0


def test_random_logs_and_parts(spark):
    """Logs of every kind of event, with ties, drops and messages opened again, against a fold in plain Python."""
    rng = random.Random(19)
    rows = [(rng.randrange(6), rng.randrange(40), rng.choice(["open", "delta", "delta", "edit", "regenerate", "delete"]), rng.choice("abcde"), rng.choice(["user", "assistant", None]), rng.choice(["x", "yy", None, "<|im_end|>"]), "z") for _ in range(600)]
    plain = {}
    low = lambda x: (x is not None, x or "")
    for conv, seq, kind, message, role, text, _ in sorted(rows, key=lambda r: (r[0], r[1], r[3], r[2], low(r[4]), low(r[5]))):
        plain.setdefault(conv, Conversation()).fold(kind, message, role, text)
    want = {c: turns for c, p in plain.items() if (turns := parse(p.render("assistant")[0]))}
    for part_chars in (1 << 24, 30):
        got = {}
        for r in format_chats(events(spark, rows), part_chars=part_chars).orderBy("conv_id", "part").collect():
            got.setdefault(r["conv_id"], []).extend(parse(r["formatted"]))
            assert len(r["formatted"]) <= max(part_chars, 80)
        assert got == want
    whole, parted = (sorted(map(tuple, read_back(format_chats(events(spark, rows), part_chars=n)).collect())) for n in (1 << 24, 30))
    assert whole == parted
