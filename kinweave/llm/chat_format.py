r"""Chat formatting: logs of streamed conversations folded into messages and rendered.

A log has one row per event: a message is started, grows by deltas, is edited or generated
anew. The log is partitioned by conversation (a long one by stretches of its turns), sorted by
sequence, and folded as a stream, so that a task holds one message and the part it renders.
Each part of a conversation becomes one row: its text under the template, and the spans of the
text that count for the loss. Parts read in order are the conversation.

The template marks turns as ``[INST] user [/INST]``, `` assistant</s>``,
``<<SYS>>\nsystem\n<</SYS>>\n\n`` and ``[ROLE name]\nanything else [/ROLE]``. A control string
inside a text gets a backslash behind its first character, and one that has some already gets
one more, so that taking one away gives the text back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain, groupby
from operator import itemgetter
from typing import NamedTuple
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Events of a log. A message event and an edit set the text, a delta appends to it, and start
# and regenerate empty it.
MESSAGE, START, DELTA, EDIT, REGENERATE = "message", "start", "delta", "edit", "regenerate"
_SETS = {MESSAGE: True, EDIT: True, START: False, REGENERATE: False}

LEARNED = "assistant"
# Turns of a conversation that are rendered together.
TURNS_PER_PART = 64
# A part of more characters is written in pieces, one row each.
CHARS_PER_ROW = 1 << 21
# Characters of an assistant's text in one delta, where a table of turns is made into a log.
DELTA_CHARS = 256
_BATCH_ROWS, _BATCH_CHARS = 512, 1 << 22

# The marks before and behind a turn's text.
MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": (" ", "</s>"), "system": ("<<SYS>>\n", "\n<</SYS>>\n\n")}
_CONTROL_RESTS = r"s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>|ROLE |/ROLE\]"
_PLAIN = re.compile(rf"([<\[])(\\*)({_CONTROL_RESTS})")
_ESCAPED = re.compile(rf"([<\[])\\(\\*)({_CONTROL_RESTS})")
_TURN = re.compile(
    r"\[INST\] (?P<user>.*?) \[/INST\]"
    r"|<<SYS>>\n(?P<system>.*?)\n<</SYS>>\n\n"
    r"|\[ROLE (?P<name>[^\]\n]*)\]\n(?P<other>.*?) \[/ROLE\]"
    r"| (?P<assistant>.*?)</s>",
    re.DOTALL,
)

LOG = "turn bigint, message bigint, seq bigint, kind string, role string, text string"
_SPAN = T.StructType([T.StructField("start", T.LongType(), False), T.StructField("end", T.LongType(), False)])


class Turn(NamedTuple):
    role: str
    text: str
    start: int  # of the escaped text
    end: int


def escape(text: str) -> str:
    """The text without control strings."""
    return _PLAIN.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn under the template, and where its escaped text starts and ends."""
    before, behind = MARKS.get(role) or (f"[ROLE {quote(role, safe='')}]\n", " [/ROLE]")
    inside = escape(text)
    return before + inside + behind, len(before), len(before) + len(inside)


def parse(formatted: str) -> list[Turn]:
    """The turns of a formatted part; fails where it is not one."""
    turns, at = [], 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if found is None:
            raise ValueError(f"no turn at character {at} of a formatted part")
        group = found.lastgroup
        role = unquote(found["name"]) if group == "other" else group
        turns.append(Turn(role, unescape(found[group]), *found.span(group)))
        at = found.end()
    return turns


def turns_as_log(conversations: DataFrame, message_id: Column | None = None) -> DataFrame:
    """The log that leads to a table (conv_id, turn, role, text) of final turns.

    An assistant's text is drafted, generated anew and streamed in deltas; others are sent
    without their second half and then edited. ``message_id`` tells the rows apart; by default
    they are numbered, so store the log before it is read twice. A null text or role is an
    empty one.
    """
    message_id = F.monotonically_increasing_id() if message_id is None else message_id
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    rows = conversations.select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"), message_id.alias("message"),
        role.alias("role"), text.alias("__text"),
    )
    pieces = F.regexp_extract_all("__text", F.lit(f"(?s).{{1,{DELTA_CHARS}}}"), F.lit(0))

    def event(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.alias("text"))

    streamed = F.concat(
        F.array(event(START, F.lit("")), event(DELTA, F.substring("__text", 1, 16)), event(REGENERATE, F.lit(""))),
        F.transform(pieces, lambda p: event(DELTA, p)),
    )
    half = F.substring(F.col("__text"), F.lit(1), (F.length("__text") / 2).cast("int"))
    sent = F.array(event(MESSAGE, half), event(EDIT, F.col("__text")))
    events = F.when(F.col("role") == LEARNED, streamed).otherwise(sent)
    return rows.select(
        "conv_id", "turn", "message", "role", F.posexplode(events).alias("at", "e")
    ).select("conv_id", "turn", "message", F.col("at").cast("bigint").alias("seq"), "e.kind", "role", "e.text")


def _events(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)


def _peeked(batches: Iterator[pa.RecordBatch]) -> tuple[pa.DataType | None, Iterator[pa.RecordBatch]]:
    """The type of the first column, None if there is no batch, and all batches."""
    first = next(batches, None)
    return (None, batches) if first is None else (first.schema.field(0).type, chain([first], batches))


def fold(events: Iterator[tuple]) -> Iterator[tuple]:
    """``(conversation, part, role, text)`` of each message, from its events in order.

    An event is (conversation, part, turn, message, kind, role, text). A later event changes
    the role if it names one. An unknown kind fails.
    """
    for (conversation, part, _, _), own in groupby(events, key=itemgetter(0, 1, 2, 3)):
        role, pieces = "", []
        for *_, kind, named, text in own:
            role = role if named is None else named
            if kind in _SETS:
                pieces = [text] if _SETS[kind] and text else []
            elif kind != DELTA:
                raise ValueError(f"unknown kind of event: {kind}")
            elif text:
                pieces.append(text)
        yield conversation, part, role, "".join(pieces)


def formatted_rows(messages: Iterator[tuple]) -> Iterator[tuple]:
    """``(conversation, part, piece, turns, formatted, loss)`` of folded messages in order."""
    for (conversation, part), own in groupby(messages, key=itemgetter(0, 1)):
        piece, texts, spans, size = 0, [], [], 0
        for _, _, role, text in own:
            if size > CHARS_PER_ROW:
                yield conversation, part, piece, len(texts), "".join(texts), spans
                piece, texts, spans, size = piece + 1, [], [], 0
            turn, start, end = render(role, text)
            if role == LEARNED:
                spans.append({"start": size + start, "end": size + end})
            texts.append(turn)
            size += len(turn)
        yield conversation, part, piece, len(texts), "".join(texts), spans


def digest_rows(parts: Iterator[tuple]) -> Iterator[tuple]:
    """Digests of each conversation, from its (conversation, formatted, loss) in order."""
    for conversation, own in groupby(parts, key=itemgetter(0)):
        turns, learned, chars = 0, 0, 0
        turns_hash, loss_hash = hashlib.sha256(), hashlib.sha256()
        for _, formatted, loss in own:
            for turn in parse(formatted):
                turns_hash.update(f"{turn.role}\n{turn.text}\n".encode())
                turns += 1
            for span in loss:
                text = unescape(formatted[span["start"] : span["end"]])
                loss_hash.update(text.encode())
                learned += len(text)
            chars += len(formatted)
        yield conversation, turns, turns_hash.hexdigest(), learned, loss_hash.hexdigest(), chars


def _batched(rows: Iterator[tuple], schema: pa.Schema, chars: int | None = None) -> Iterator[pa.RecordBatch]:
    """Rows as batches of a bounded number, and of bounded size by the text in column ``chars``."""
    some: list[tuple] = []
    held = 0
    for row in rows:
        some.append(row)
        held += 0 if chars is None else len(row[chars])
        if len(some) >= _BATCH_ROWS or held > _BATCH_CHARS:
            yield _batch(some, schema)
            some, held = [], 0
    if some:
        yield _batch(some, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_PART = [
    *[(n, pa.int64()) for n in ("part", "piece", "n_turns")],
    ("formatted", pa.string()),
    ("loss", pa.list_(pa.struct([pa.field(n, pa.int64(), False) for n in ("start", "end")]))),
]


def format_log(log: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """Formatted parts ``(conv_id, part, piece, n_turns, formatted, loss)`` of a log.

    ``log`` has the conversation's id and the columns of LOG: ``turn`` places a message in its
    conversation, ``message`` tells messages of one turn apart, ``seq`` orders its events.
    Messages of one turn follow each other by ``message``; a null turn comes first, and null
    ids are one conversation. A text or role that is null is empty. ``loss`` holds the spans,
    in characters of the part, of the assistant's texts. An empty log has no parts. Further
    columns are ignored.

    A hot conversation is spread over tasks by TURNS_PER_PART turns; the messages of one
    turn are streamed by one task, which holds one row of the result at a time.
    """
    part = F.floor(F.col("turn") / F.lit(TURNS_PER_PART)).alias("part")
    events = log.select(F.col(conv_id).alias("conv_id"), part, "turn", "message", "seq", "kind", "role", "text")
    schema = T.StructType(
        [
            T.StructField("conv_id", log.schema[conv_id].dataType),
            *[T.StructField(n, T.LongType()) for n in ("part", "piece", "n_turns")],
            T.StructField("formatted", T.StringType()),
            T.StructField("loss", T.ArrayType(_SPAN, False)),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, batches = _peeked(batches)
        rows = formatted_rows(fold(_events(batches)))
        yield from _batched(rows, pa.schema([("conv_id", kind or pa.null()), *_PART]), chars=4)

    ordered = events.repartition("conv_id", "part").sortWithinPartitions(
        "conv_id", "part", "turn", "message", "seq", "kind", "role", "text"
    )
    return ordered.drop("seq").mapInArrow(run, schema)


def write_formatted(log: DataFrame, path: str, conv_id: str = "conv_id") -> T.StructType:
    """Write the formatted parts of a log as Parquet; gives the schema to read them with."""
    parts = format_log(log, conv_id)
    parts.write.parquet(path)
    return parts.schema


def read_turns(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The turns in formatted files: conv_id, part, piece, position, role, text, learned."""
    turn = T.StructType(
        [
            schema["conv_id"], schema["part"], schema["piece"],
            T.StructField("position", T.LongType()), T.StructField("role", T.StringType()),
            T.StructField("text", T.StringType()), T.StructField("learned", T.BooleanType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_()]
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                _, part, piece, formatted, loss = (c[0].as_py() for c in one.columns)
                spans = {(s["start"], s["end"]) for s in loss}
                turns = parse(formatted)
                rows = [(part, piece, k, t.role, t.text, (t.start, t.end) in spans) for k, t in enumerate(turns)]
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        one.column("conv_id").take(pa.array([0] * len(rows))),
                        *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                    ],
                    turn.names,
                )

    parts = spark.read.schema(schema).parquet(path)
    return parts.select("conv_id", "part", "piece", "formatted", "loss").mapInArrow(run, turn)


def read_digests(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Per conversation in formatted files, digests of what its turns and loss spans hold.

    n_turns, turns_sha256 (role, newline, text, newline of each turn), loss_chars and
    loss_sha256 (of the unescaped text under the loss spans) and formatted_chars. A hash runs
    through a conversation in order, so one task streams its parts, one row at a time.
    """
    numbers = ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    texts = [n.endswith("sha256") for n in numbers]
    out = T.StructType(
        [schema["conv_id"], *[T.StructField(n, T.StringType() if t else T.LongType()) for n, t in zip(numbers, texts)]]
    )
    kinds = [(n, pa.string() if t else pa.int64()) for n, t in zip(numbers, texts)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, batches = _peeked(batches)
        yield from _batched(digest_rows(_events(batches)), pa.schema([("conv_id", kind or pa.null()), *kinds]))

    parts = spark.read.schema(schema).parquet(path)
    ordered = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece")
    return ordered.select("conv_id", "formatted", "loss").mapInArrow(run, out)
