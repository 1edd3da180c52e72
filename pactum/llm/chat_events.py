"""Chat transcripts out of event logs: fold, render with a loss mask, read back.

Events (conv_id, seq, message, kind, role, content, at, n) tell how the messages
of a conversation came about:

* ``open``: a message begins, said by ``role``; messages are numbered in the order
  of the transcript;
* ``delta``: ``content`` is streamed to the end of the message;
* ``edit``: ``n`` characters from character ``at`` on are replaced by ``content``;
* ``regenerate``: what the message holds so far is thrown away.

``seq`` orders the events of a conversation; any type that Spark can sort.

A log is dealt by conversation and stretch of ``STRETCH`` message numbers, so a long
conversation is spread over tasks, and sorted by (message, seq).  Tasks fold the
events one after another, keeping one message in memory, and render each finished
message to the end of its part.  A part is one row of bounded size (or one message
that is longer): the formatted text and the spans under the loss mask.  The parts of
a conversation in order are its transcript.

Template: a turn is ``<turn ROLE>``, newline, text, ``</turn>``, newline.  In a text a
backslash precedes every backslash and every ``<`` that begins ``<turn`` or ``</turn``; in
a role also every ``<``, ``>`` and newline.  Reading back drops one backslash before each
escaped character, so every text returns unchanged, control strings included.  The
loss mask covers the escaped texts of assistant turns, without the marks.

Defined results: a NULL role or content is empty; NULL numbers (``message``) come
first; a NULL ``at`` or ``n`` is 0 and both are cut to the message's length; equal
sequence numbers of a message: by kind, then content, and an event repeated in all
of its columns counts once; ``delta``, ``edit`` or ``regenerate`` of a message that
was never opened open it with an empty role; a second ``open`` of a number begins
another message; other kinds are an error; a NULL conv_id is one conversation;
an empty log gives an empty table; columns of other names are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactum.llm.common import arrow_schema

KINDS = ("open", "delta", "edit", "regenerate")
ASSISTANT = "assistant"
#: Neighbouring message numbers handled by one task, as a power of two.
STRETCH_BITS = 6
#: Characters of a part, about; a longer message is a part of its own.
PART_CHARS = 1 << 18

_IN_TEXT = re.compile(r"\\|<(?=/?turn)")
_IN_ROLE = re.compile(r"[\\<>\n]")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"<turn ((?:[^\\<>\n]|\\.)*)>\n((?:[^\\<]|\\.|<(?!/?turn))*)</turn>\n", re.DOTALL)

PART = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("message", T.LongType()), T.StructField("part", T.LongType()),
    T.StructField("n_turns", T.LongType()), T.StructField("formatted", T.StringType()),
    T.StructField("loss", T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "stop")])))])


def escape_text(text: str) -> str:
    return _IN_TEXT.sub(lambda m: "\\" + m.group(), text)


def escape_role(role: str) -> str:
    return _IN_ROLE.sub(lambda m: "\\" + m.group(), role)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def render(role: str, text: str) -> tuple[str, int, int]:
    """One formatted turn, and where its escaped text lies."""
    head, body = f"<turn {escape_role(role)}>\n", escape_text(text)
    return head + body + "</turn>\n", len(head), len(head) + len(body)


def read_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each formatted turn; raises when anything else is found."""
    at = 0
    while at < len(formatted):
        turn = _TURN.match(formatted, at)
        if turn is None:
            raise ValueError(f"no turn at character {at}")
        yield unescape(turn.group(1)), unescape(turn.group(2))
        at = turn.end()


class Message:
    """One message while its events are folded; streamed pieces are joined late."""

    def __init__(self, number: int | None, role: str):
        self.number, self.role, self.pieces = number, role, []

    def text(self) -> str:
        if len(self.pieces) > 1:
            self.pieces = ["".join(self.pieces)]
        return self.pieces[0] if self.pieces else ""

    def apply(self, kind: str, content: str, at: int, n: int) -> None:
        if kind == "delta":
            self.pieces.append(content)
        elif kind == "regenerate":
            self.pieces = []
        elif kind == "edit":
            now = self.text()
            a = min(max(at, 0), len(now))
            self.pieces = [now[:a] + content + now[min(a + max(n, 0), len(now)):]]
        else:
            raise ValueError(f"unknown event {kind!r}")


class Part:
    """Rendered turns of one conversation and stretch, up to ``PART_CHARS``."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.number = conv_id, 0
        self.clear(None)

    def clear(self, message: int | None) -> None:
        self.message, self.turns, self.chars, self.texts, self.loss = message, 0, 0, [], []

    def add(self, message: Message) -> Iterator[dict]:
        text, start, stop = render(message.role, message.text())
        if self.turns and self.chars + len(text) > PART_CHARS:
            yield from self.close()
        if not self.turns:
            self.message = message.number
        if message.role == ASSISTANT:
            self.loss.append({"start": self.chars + start, "stop": self.chars + stop})
        self.texts.append(text)
        self.turns += 1
        self.chars += len(text)

    def close(self) -> Iterator[dict]:
        if self.turns:
            yield {"conv_id": self.conv_id, "message": self.message, "part": self.number, "n_turns": self.turns,
                   "formatted": "".join(self.texts), "loss": self.loss}
            self.number += 1
            self.clear(None)


def fold(events: Iterator[tuple]) -> Iterator[dict]:
    """Sorted events (conv_id, stretch, message, again, kind, role, content, at, n) -> parts."""
    key, part, message = None, None, None
    for conv_id, stretch, number, again, kind, role, content, at, n in events:
        if again:  # the same event, logged twice
            continue
        if part is None or (conv_id, stretch) != key:
            if part is not None:
                yield from part.add(message)
                yield from part.close()
            key, part, message = (conv_id, stretch), Part(conv_id), None
        if message is not None and (kind == "open" or number != message.number):
            yield from part.add(message)
            message = None
        if message is None:
            message = Message(number, (role or "") if kind == "open" else "")
        if kind != "open":
            message.apply(kind, content or "", at or 0, n or 0)
    if part is not None:
        yield from part.add(message)
        yield from part.close()


def batches_of(rows: Iterator[dict], schema: pa.Schema, size: str) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about ``PART_CHARS`` * 16 characters of column ``size``."""
    out, chars = [], 0
    for row in rows:
        out.append(row)
        chars += len(row[size]) + 100
        if chars > PART_CHARS * 16:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
            out, chars = [], 0
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def format_chats(events: DataFrame) -> DataFrame:
    """An event log -> parts: conv_id, message (number of the first one), part, n_turns, formatted,
    loss (spans of characters).  (message, part) orders the parts of a conversation."""
    own = events.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("message").cast("bigint").alias("message"), "seq", "kind",
        F.col("role").cast("string").alias("role"), F.col("content").cast("string").alias("content"),
        F.col("at").cast("bigint").alias("at"), F.col("n").cast("bigint").alias("n"))
    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stretch = F.shiftright("message", STRETCH_BITS)
    order = ["conv_id", "message", "seq", "kind", "content", "role", "at", "n"]
    # An event equal to the one before it, in all columns, was logged twice.
    dealt = own.withColumn("stretch", stretch).repartition(n, "conv_id", "stretch").sortWithinPartitions(*order)
    names = arrow_schema(PART)
    columns = ["conv_id", "stretch", "message", "seq", "kind", "role", "content", "at", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            last = None
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns)):
                    yield (*row[:3], row == last, *row[4:])
                    last = row
        yield from batches_of(fold(rows()), names, "formatted")

    return dealt.select(*columns).mapInArrow(run, PART)


TURN = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("message", T.LongType()), T.StructField("part", T.LongType()),
    T.StructField("place", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])


def read_chats(parts: DataFrame) -> DataFrame:
    """The turns of formatted parts, parsed: conv_id, (message, part, place) for the order, role, text."""
    names = arrow_schema(TURN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for conv_id, message, part, formatted in zip(*(c.to_pylist() for c in batch.columns)):
                    for k, (role, text) in enumerate(read_turns(formatted)):
                        yield {"conv_id": conv_id, "message": message, "part": part, "place": k, "role": role, "text": text}
        yield from batches_of(rows(), names, "text")

    return parts.select("conv_id", "message", "part", "formatted").mapInArrow(run, TURN)


def transcript_digests(parts: DataFrame) -> DataFrame:
    """Read back from formatted parts, per conversation: n_turns, turns_sha256 (role, newline, text, newline of
    each turn), loss_chars and loss_sha256 (all text under the loss mask, unescaped), formatted_chars.

    The digests of a conversation are sequential by their definition: its parts are dealt to one task, which
    streams them in order and keeps only the hash states."""
    schema = T.StructType([
        T.StructField("conv_id", T.LongType()), T.StructField("n_turns", T.LongType()),
        T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()),
        T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())])
    names = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            now, turns = None, None

            def result():
                return dict(zip(schema.names, (now, n_turns, turns.hexdigest(), loss_chars, masked.hexdigest(), chars)))

            for batch in batches:
                for conv_id, formatted, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss"))):
                    if turns is None or conv_id != now:
                        if turns is not None:
                            yield result()
                        now, turns, masked = conv_id, hashlib.sha256(), hashlib.sha256()
                        n_turns = loss_chars = chars = 0
                    for role, text in read_turns(formatted):
                        n_turns += 1
                        turns.update(f"{role}\n{text}\n".encode())
                    for span in loss:
                        text = unescape(formatted[span["start"]: span["stop"]])
                        loss_chars += len(text)
                        masked.update(text.encode())
                    chars += len(formatted)
            if turns is not None:
                yield result()
        yield from batches_of(rows(), names, "turns_sha256")

    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = parts.repartition(n, "conv_id").sortWithinPartitions("conv_id", "message", "part")
    return dealt.select("conv_id", "formatted", "loss").mapInArrow(run, schema)
