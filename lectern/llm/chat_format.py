"""Chat formatting: conversations are rebuilt from an event log and rendered under a template with a loss mask.

The log has one row per event: conv_id, seq (any type with an order), kind, message (a name), role, text.

1. The texts: events are dealt by message, sorted by sequence and folded as they stream past; each message is rendered
   there, so a conversation's bulk is spread over tasks, however long it is.
2. The order: the events that open and drop messages, without their texts, are dealt by conversation and folded in
   sequence, which tells the messages that are left and their places.
3. The rendered messages of a conversation follow each other by place.  They pass through one task as a stream, and a
   conversation of more than ``part_chars`` characters comes in several parts, so no task holds a whole long one.

Kinds: ``open`` starts message ``message`` with a role; ``delta`` appends text to it; ``edit`` replaces its text;
``regenerate`` clears it and drops every later message, as the answer is written anew; ``delete`` drops it.
Messages stand in the order in which they were opened.

Template: each turn is ``<|im_start|>role\\ntext<|im_end|>\\n``.  Inside role and text a backslash becomes two and the two
control strings get a backslash after ``<|``, so a marker in the output is always the template's own and unescaping
gives back every text exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, only
from .words import text_slices

START, END = "<|im_start|>", "<|im_end|>"
_CONTROL = re.compile(r"\\|<\|(?=im_start\|>|im_end\|>)")
_ESCAPED = re.compile(r"\\\\|<\|\\(?=im_start\|>|im_end\|>)")
_TURN = re.compile(re.escape(START) + r"(.*?)\n(.*?)" + re.escape(END) + "\n", re.DOTALL)
_FORMATTED = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("formatted", pa.string()), ("loss_spans", pa.list_(pa.int64()))])
_FORMATTED_DDL = "conv_id long, part long, formatted string, loss_spans array<long>"
_MESSAGES = pa.schema([("conv_id", pa.int64()), ("message", pa.string()), ("piece", pa.string()), ("loss_from", pa.int64()), ("loss_to", pa.int64())])
_MESSAGES_DDL = "conv_id long, message string, piece string, loss_from long, loss_to long"
_PLACES = pa.schema([("conv_id", pa.int64()), ("message", pa.string()), ("place", pa.int64())])
HELD = 1 << 19  # characters that a task gathers before it hands them on


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else "<|\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\\" if m[0] == "\\\\" else "<|", text)


def escape_role(role: str) -> str:
    """Roles stand on one line."""
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return re.sub(r"\\n|\\\\|<\|\\(?=im_start\|>|im_end\|>)", lambda m: {"\\n": "\n", "\\\\": "\\"}.get(m[0], "<|"), role)


class Message:
    """Folds the events of one message: its role and text, whatever becomes of the conversation around it."""

    def __init__(self) -> None:
        self.role: str | None = None
        self.pieces: list[str] = []

    def fold(self, kind: str, role: str | None, text: str | None) -> None:
        if kind == "open":
            self.role, self.pieces = role or "", [text] if text else []
        elif self.role is None:
            return  # an event for a message that was never opened, or is gone
        elif kind == "delta":
            self.pieces.append(text or "")
        elif kind == "edit":
            self.pieces = [text or ""]
        elif kind == "regenerate":
            self.pieces = []
        elif kind == "delete":
            self.role, self.pieces = None, []

    def render(self, learned: str) -> tuple[str, int, int]:
        """The formatted turn, and the code points of it that are under the loss mask."""
        head, body = f"{START}{escape_role(self.role or '')}\n", escape("".join(self.pieces))
        loss = (len(head), len(head) + len(body)) if self.role == learned else (-1, -1)
        return f"{head}{body}{END}\n", *loss


class Order:
    """Folds what happens to the messages of a conversation: which are left, in the order in which they were opened."""

    def __init__(self) -> None:
        self.messages: dict[str, None] = {}

    def fold(self, kind: str, message: str) -> None:
        if kind == "open":
            self.messages[message] = None
        elif message in self.messages and kind == "delete":
            del self.messages[message]
        elif message in self.messages and kind == "regenerate":
            # the later ones go, and each message goes once, so all regenerations together cost a step a message
            while next(reversed(self.messages)) != message:
                self.messages.popitem()


class Conversation:
    """A conversation at hand: its events folded in sequence, for use outside a table."""

    def __init__(self) -> None:
        self.order, self.messages = Order(), {}

    def fold(self, kind: str, message: str, role: str | None, text: str | None) -> None:
        self.order.fold(kind, message)
        self.messages.setdefault(message, Message()).fold(kind, role, text)

    def render(self, learned: str) -> tuple[str, list[int]]:
        """The formatted conversation and the code-point spans (start, end, start, end, ...) under the loss mask."""
        out, spans, at = [], [], 0
        for name in self.order.messages:
            piece, low, high = self.messages[name].render(learned)
            spans += [at + low, at + high] if low >= 0 else []
            out.append(piece)
            at += len(piece)
        return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts read back from a formatted conversation or a part of one."""
    return [(unescape_role(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for f, x in zip(schema, zip(*rows, strict=True), strict=True)], schema=schema)


def _rows(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*(column(batch, c).to_pylist() for c in names), strict=True)


def _texts(learned: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, message, out, held = None, Message(), [], 0
        for batch in batches:
            for part in text_slices(batch):
                for conv_id, name, kind, role, text in _rows(part, "conv_id", "message", "kind", "role", "text"):
                    if (conv_id, name) != current:
                        if current and message.role is not None:
                            out.append((*current, *message.render(learned)))
                            held += len(out[-1][2])
                            if held > HELD:
                                yield _batch(_MESSAGES, out)
                                out, held = [], 0
                        current, message = (conv_id, name), Message()
                    message.fold(kind, role, text)
        if current and message.role is not None:
            out.append((*current, *message.render(learned)))
        if out:
            yield _batch(_MESSAGES, out)

    return run


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current, order = None, None
    for batch in batches:
        out: list[tuple] = []
        for conv_id, kind, message in _rows(batch, "conv_id", "kind", "message"):
            if order is None or conv_id != current:
                if order is not None:
                    out += [(current, m, i) for i, m in enumerate(order.messages)]
                current, order = conv_id, Order()
            order.fold(kind, message)
        if out:
            yield _batch(_PLACES, out)
    if order is not None and order.messages:
        yield _batch(_PLACES, [(current, m, i) for i, m in enumerate(order.messages)])


def _joined(part_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, current, number = False, None, 0
        pieces: list[str] = []
        spans: list[int] = []
        out: list[tuple] = []
        at = held = 0
        for batch in batches:
            for part in text_slices(batch, "piece"):
                for conv_id, piece, low, high in _rows(part, "conv_id", "piece", "loss_from", "loss_to"):
                    fresh = not begun or conv_id != current
                    if begun and (fresh or at + len(piece) > part_chars):
                        out.append((current, number, "".join(pieces), spans))
                        held += at
                        number, pieces, spans, at = number + 1, [], [], 0
                        if held > HELD:
                            yield _batch(_FORMATTED, out)
                            out, held = [], 0
                    if fresh:
                        begun, current, number = True, conv_id, 0
                    if low >= 0:
                        spans += [at + low, at + high]
                    pieces.append(piece)
                    at += len(piece)
        if begun:
            out.append((current, number, "".join(pieces), spans))
        if out:
            yield _batch(_FORMATTED, out)

    return run


def format_chats(events: DataFrame, learned: str = "assistant", part_chars: int = 1 << 24) -> DataFrame:
    """Fold an event log into conversations and render each: conv_id, part, formatted, loss_spans.

    ``learned`` is the role whose texts are under the loss mask; loss_spans are code points (start, end, start, end, ...) of
    the row's own text.  A conversation of up to ``part_chars`` characters is one row (part 0), a longer one is cut between
    messages; its parts stand in one partition, in order.

    Null roles and texts count as empty, null message or kind events are ignored.  Events of a message with equal sequence
    follow (kind, role, text), so ties have one order; repeated rows are folded again.  A null conv_id is a
    conversation of its own; one whose messages are all dropped gives no row.  Extra columns are ignored; an empty log
    gives an empty result.
    """
    log = only(events, "conv_id", "seq", "kind", "message", "role", "text").where("kind is not null and message is not null").withColumn("message", F.col("message").cast("string"))
    by_message = log.repartition("conv_id", "message").sortWithinPartitions("conv_id", "message", "seq", "kind", "role", "text")
    texts = by_message.select("conv_id", "message", "kind", "role", "text").mapInArrow(_texts(learned), _MESSAGES_DDL)
    control = log.where(F.col("kind").isin("open", "regenerate", "delete")).select("conv_id", "seq", "message", "kind")
    places = control.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "message", "kind").select("conv_id", "kind", "message").mapInArrow(_places, "conv_id long, message string, place long")
    left = places.select(F.col("conv_id").alias("c"), F.col("message").alias("m"), "place")
    placed = texts.join(left, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("message") == F.col("m")))
    dealt = placed.select("conv_id", "place", "piece", "loss_from", "loss_to").repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return dealt.mapInArrow(_joined(part_chars), _FORMATTED_DDL)


def turn_events(turns: DataFrame) -> DataFrame:
    """The event log of turns (conv_id, turn, role, text) as a chat service might stream them.

    An assistant's turn is begun with a draft, answered by a hasty follow-up, regenerated (which drops both) and streamed in two
    halves; a user's turn is typed backwards and then edited; any other is streamed in two halves.  Rows that repeat a turn
    are messages of their own, in the order of role and text.  Null texts count as empty.
    """
    copies = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    named = only(turns, "conv_id", "turn", "role", "text").withColumn("copy", F.row_number().over(copies))
    half = (F.length("text") / 2).cast("int")

    def event(step: int, kind: str, text: Column, role: Column | None = None, follow_up: bool = False) -> Column:
        return F.struct(F.lit(step).alias("step"), F.lit(kind).alias("kind"), text.alias("piece"), (F.col("role") if role is None else role).alias("as"), F.lit("/next" if follow_up else "").alias("mark"))

    halves = [event(5, "delta", F.substring("text", F.lit(1), half)), event(6, "delta", F.substring("text", half + 1, F.length("text")))]
    nothing, user = F.lit(""), F.lit("user")
    drafted = F.array(event(0, "open", nothing), event(1, "delta", F.substring("text", 1, 8)), event(2, "open", F.lit("wait"), user, True), event(3, "delta", F.lit("..."), user, True), event(4, "regenerate", nothing), *halves)
    edited = F.array(event(0, "open", nothing), event(1, "delta", F.reverse("text")), event(2, "edit", F.col("text")))
    streamed = F.array(event(0, "open", nothing), *halves)
    steps = F.when(F.col("role") == "assistant", drafted).when(F.col("role") == "user", edited).otherwise(streamed)
    return named.withColumn("event", F.explode(steps)).select(
        "conv_id",
        F.struct("turn", "copy", "event.step").alias("seq"),
        "event.kind",
        F.concat(F.concat_ws("/", F.coalesce(F.col("turn").cast("string"), F.lit("")), "copy"), "event.mark").alias("message"),
        F.col("event.as").alias("role"),
        F.col("event.piece").alias("text"),
    )


_READ = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current, seen = None, False
    turns = chars = loss_chars = 0
    listing, loss = sha256(), sha256()
    for batch in batches:
        rows = []
        for part in text_slices(batch, "formatted"):
            for conv_id, number, formatted, spans in _rows(part, "conv_id", "part", "formatted", "loss_spans"):
                if number == 0:
                    if seen:
                        rows.append((current, turns, listing.hexdigest(), loss_chars, loss.hexdigest(), chars))
                    current, seen, turns, chars, loss_chars, listing, loss = conv_id, True, 0, 0, 0, sha256(), sha256()
                chars += len(formatted)
                for role, text in parse(formatted):
                    turns += 1
                    listing.update(f"{role}\n{text}\n".encode())
                for a, b in zip(spans[::2], spans[1::2], strict=True):
                    text = unescape(formatted[a:b])
                    loss_chars += len(text)
                    loss.update(text.encode())
        if rows:
            yield _batch(_READ, rows)
    if seen:
        yield _batch(_READ, [(current, turns, listing.hexdigest(), loss_chars, loss.hexdigest(), chars)])


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what formatted conversations hold, found by parsing them again, part by part, as ``format_chats`` gives them."""
    ddl = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return only(formatted, "conv_id", "part", "formatted", "loss_spans").mapInArrow(_read_back, ddl)
